import pytest
from graphs import calls, graph, names, node

from threadloom.operators import coupling, lookup, resolve, traverse
from threadloom.plans.catalogue import QUERIES
from threadloom.plans.star_graph import star_edges
from threadloom.schema import REFS, Graph


def test_callers_come_in_edge_order_with_repeats(spark):
    g, _ = calls(spark, [("caller2", "target"), ("caller1", "target"), ("caller1", "target")])
    assert names(lookup.callers(g, "target")) == ["caller2", "caller1", "caller1"]
    assert names(lookup.callees(g, "caller1")) == ["target", "target"]
    assert names(lookup.callers(g, "target", limit=1)) == ["caller2"]
    assert names(lookup.callers(g, "nobody")) == []


def test_impact_by_depth_and_on_cycles(spark):
    g, ids = calls(spark, [("c3", "c2"), ("c2", "c1"), ("c1", "target")])
    for depth in (1, 2, 3):
        assert {(r.id, r.level) for r in traverse.impact(g, "target", depth).collect()} == {(ids[f"c{i}"], i) for i in range(1, depth + 1)}
    ring, _ = calls(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert traverse.impact(ring, "b", 10).count() == 2
    assert traverse.impact(ring, "missing", 3).count() == 0


def test_impact_counts_the_first_calls_only(spark):
    g, ids = calls(spark, [("x", "t"), ("x", "t"), ("y", "t")])
    assert [r.id for r in traverse.impact(g, "t", 1, fan_in=2).collect()] == [ids["x"]]


def paths(g, ids, start, end, **more):
    back = {i: n for n, i in ids.items()}
    return ["".join(back[i] for i in r.path) for r in sorted(traverse.call_paths(g, start, end, **more).collect(), key=lambda r: r.nth)]


def brute_paths(pairs, start, end, limit=5, longest=10):
    queue, visited, found = [[start]], set(), []
    while queue and len(found) < limit:
        path = queue.pop(0)
        at = path[-1]
        if at == end:
            found.append("".join(path))
            continue
        if at in visited or len(path) > longest:
            continue
        visited.add(at)
        queue += [[*path, b] for a, b in pairs if a == at]
    return found


def test_call_paths_against_a_queue(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("b", "e"), ("e", "a"), ("c", "e"), ("a", "b")]
    g, ids = calls(spark, pairs)
    for start, end in (("a", "e"), ("a", "d"), ("b", "c"), ("d", "d")):
        assert paths(g, ids, start, end) == brute_paths(pairs, start, end)
    assert paths(g, ids, "a", "e", limit=2) == brute_paths(pairs, "a", "e", limit=2)
    assert paths(g, ids, "a", "missing") == []
    chain = list(zip("abcdefghijklm", "bcdefghijklmn", strict=True))
    long, ids = calls(spark, chain)
    assert paths(long, ids, "a", "k") == ["abcdefghijk"]
    assert paths(long, ids, "a", "l") == brute_paths(chain, "a", "l")


def test_call_paths_of_the_whole_star_graph(spark, sf_dir):
    edges = sorted((r.id, r.source_id, r.target_id) for r in star_edges(spark, sf_dir).where("kind = 'calls'").collect())
    assert {i % 16 for i, _, _ in edges} == {1, 2, 3}
    want = brute_paths([(f">{a}", f">{b}") for _, a, b in edges], f">{21 * 8 + 1}", f">{1 * 8 + 1}")
    got = sorted((r.nth, r.path) for r in QUERIES["call_paths_whole_graph"](spark, sf_dir).collect())
    assert got == [(n, ">".join(str(int(x) // 8) for x in p[1:].split(">"))) for n, p in enumerate(want, 1)]
    assert len(got) > 1


def test_subgraph_returns_edges_to_unwanted_nodes(spark):
    g = graph(spark, [node(1, "f"), node(2, "g"), node(3, "S", kind="struct")], [(1, 2, "calls"), (1, 3, "references")])
    roots = g.nodes.where("id = 1").select("id")
    nodes, edges = traverse.subgraph(g, roots, depth=1, node_kinds=("function",))
    assert {r.id for r in nodes.collect()} == {1, 2}
    assert {r.id for r in edges.collect()} == {1, 2}
    assert traverse.subgraph(g, roots, limit=2)[0].count() == 2


def test_related_scores(spark):
    g, ids = calls(spark, [("entry", "helper"), ("other", "entry"), ("entry", "second")])
    got = {r.id: round(r.score, 6) for r in coupling.related_rank(g, g.nodes.where("name = 'entry'").select("id")).collect()}
    assert got == {ids["helper"]: 1.0, ids["second"]: 0.5, ids["other"]: 0.8}


def test_unused_leaves_out_tests_and_generated(spark):
    g, _ = calls(spark, [("caller", "used")], unused={}, test_thing={"is_test": True}, made={"is_generated": True})
    assert sorted(names(lookup.unused_symbols(g))) == ["caller", "unused"]


def test_hierarchy_implementations_and_fields(spark):
    nodes = [node(1, "MyClass", "class"), node(2, "my_method", "method"), node(3, "x", "field"), node(4, "Impl1", "struct"), node(5, "MyTrait", "trait")]
    g = graph(spark, nodes, [(1, 2, "contains"), (1, 3, "contains"), (4, 5, "implements"), (4, 5, "extends")])
    assert sorted(names(lookup.hierarchy(g, "MyClass"))) == ["my_method", "x"]
    assert names(lookup.hierarchy(g, "my_method")) == ["MyClass"]
    assert names(lookup.implementations(g, "MyTrait")) == ["Impl1", "Impl1"]
    assert names(lookup.struct_fields(g, "MyClass")) == ["x"]


def test_diff_impact_splits_direct_and_callers(spark):
    nodes = [node(1, "affected", start=10, end=20), node(2, "caller", start=30, end=40), node(3, "far", file="b.rs", start=15, end=16)]
    g = graph(spark, nodes, [(2, 1, "calls")])
    regions = spark.createDataFrame([("test.rs", 15, 18), ("test.rs", 16, 16)], "file_path string, first int, last int")
    assert {(r["name"], r.direct) for r in lookup.diff_impact(g, regions).collect()} == {("affected", True), ("caller", False)}


def test_references_by_kind_and_dispatch(spark):
    nodes = [node(1, "E", "enum"), node(2, "A", "enum_member"), node(3, "B", "enum_member"), node(4, "f", file="x.rs"), node(5, "g", file="y.rs")]
    g = graph(spark, nodes, [(1, 2, "contains"), (1, 3, "contains"), (4, 2, "references"), (4, 3, "references"), (5, 3, "references"), (5, 3, "accesses")])
    got = {r["kind"]: (r["count"], [x["name"] for x in r.shown]) for r in lookup.references_by_kind(g, "B").collect()}
    assert got == {"contains": (1, ["E"]), "references": (2, ["f", "g"])}
    assert {r.file_path: r.members for r in lookup.dispatch_sites(g, "E").collect()} == {"x.rs": ["A", "B"], "y.rs": ["B"]}


def refs(spark, *rows):
    return spark.createDataFrame([(i, s, n, k, f, 1, 0, None) for i, (s, n, k, f) in enumerate(rows)], REFS)


def test_resolution_prefers_the_file_then_the_lowest_id(spark):
    nodes = [node(1, "helper", file="a.rs"), node(2, "helper", file="b.rs"), node(3, "caller", file="b.rs"), node(4, "t", file="c.rs", is_test=True), node(5, "helper", kind="import", file="c.rs")]
    g = Graph(spark.createDataFrame(nodes, ", ".join(__import__("threadloom.schema", fromlist=["NODES"]).NODES.split(", "))), None, refs(spark, (3, "helper", "calls", "b.rs"), (4, "helper", "calls", "c.rs"), (3, "nothing", "calls", "b.rs"), (3, "helper", "calls", "d.rs")))
    got = sorted((r.ref_id, r.target_id, r.kind) for r in resolve.resolve_references(g).collect())
    assert got == [(0, 2, "calls"), (1, 5, "calls"), (1, 5, "tests"), (3, 1, "calls")]
    assert {(r.ref_id, r.target_id) for r in resolve.resolve_references(g, skip_imports=True).collect()} == {(0, 2), (1, 1), (3, 1)}
    files = spark.createDataFrame([("b.rs",)], "file_path string")
    assert [r.ref_id for r in resolve.resolve_references(g, files).collect()] == [0]


def test_strong_components_against_reachability(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(22)} | {(20, 21), (21, 20), (20, 20)}
        reach = {a: {a} for p in pairs for a in p}
        for _ in reach:
            for a, b in pairs:
                for s in reach.values():
                    if a in s:
                        s.add(b)
        want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if sum(a in reach[b] for b in reach[a]) > 1}
        got = traverse.strong_components(spark.createDataFrame(list(pairs), "a long, b long"))
        rows = {r.node: r.component for r in got.collect()}
        sizes: dict = {}
        for c in rows.values():
            sizes[c] = sizes.get(c, 0) + 1
        assert {n: c for n, c in rows.items() if sizes[c] > 1} == want


def ends(spark, *rows):
    nodes, seen, edges = [], {}, []
    for a, b, kind in rows:
        for f in (a, b):
            if f not in seen:
                seen[f] = len(seen) + 1
                nodes.append(node(seen[f], f"n{seen[f]}", file=f))
        edges.append((seen[a], seen[b], kind))
    return graph(spark, nodes, edges)


def test_module_fold_cycles_and_scores(spark):
    # a hub with three users, two of them in one folder, one user under an index file, and calls within a module
    g = ends(spark, ("web/view.ts", "core/hub.ts", "accesses"), ("web/view.ts", "core/hub.ts", "accesses"), ("web/menu.ts", "core/hub.ts", "mutates"), ("cli/index.ts", "core/hub.ts", "calls"), ("cli/index.ts", "cli/index.ts", "calls"), ("web/view.ts", "web/view.ts", "contains"), ("core/hub.ts", "web/view.ts", "tests"))
    rows = {(r["from"], r["to"]): (r["count"], r.strength, dict(r.by_kind)) for r in coupling.module_edges(g).collect()}
    assert rows == {("web/view", "core/hub"): (2, 2, {"accesses": 2}), ("web/menu", "core/hub"): (1, 3, {"mutates": 1}), ("cli", "core/hub"): (1, 1, {"calls": 1})}
    folded = {(r["from"], r["to"]): (r["count"], r.strength, dict(r.by_kind)) for r in coupling.module_edges(g, "dir").collect()}
    assert folded == {("web", "core"): (3, 3, {"accesses": 2, "mutates": 1}), ("cli", "core"): (1, 1, {"calls": 1})}
    churn = spark.createDataFrame([("core/hub", 5), ("cli", 7)], "module string, churn long")
    fans = {r.module: (r.fan_in, r.fan_out, r.churn) for r in coupling.module_nodes(coupling.module_edges(g), churn).collect()}
    assert fans == {"core/hub": (3, 0, 5), "web/view": (0, 1, None), "web/menu": (0, 1, None), "cli": (0, 1, 7)}
    # strength times distance times the greater churn
    assert {(r["from"], r.impact) for r in coupling.coupling_score(coupling.module_edges(g)).collect()} == {("web/view", 6), ("web/menu", 9), ("cli", 3)}
    assert {(r["from"], r.impact) for r in coupling.coupling_score(coupling.module_edges(g), churn).collect()} == {("web/view", 30), ("web/menu", 45), ("cli", 21)}
    assert coupling.module_cycles(coupling.module_edges(g)).count() == 0
    # two rings that a one-way bridge joins, and a pair beside them
    rings = [("r/a.py", "r/b.py"), ("r/b.py", "r/a.py"), ("r/b.py", "s/p.py"), ("s/p.py", "s/q.py"), ("s/q.py", "s/o.py"), ("s/o.py", "s/p.py"), ("t/x.py", "t/y.py")]
    cycles = coupling.module_cycles(coupling.module_edges(ends(spark, *((a, b, "calls") for a, b in rings))))
    assert sorted(r.cycle for r in cycles.collect()) == [["r/a", "r/b"], ["s/o", "s/p", "s/q"]]


def test_god_structs_share_fields_by_name(spark):
    nodes = [node(1, "S", "struct", file="a.rs"), node(2, "S", "struct", file="b.rs"), node(3, "x", "field", file="a.rs"), node(4, "y", "field", file="a.rs", visibility="private"), node(5, "f", file="c.rs"), node(6, "g", file="d.rs")]
    g = graph(spark, nodes, [(1, 3, "contains"), (1, 4, "contains"), (5, 3, "accesses"), (6, 3, "mutates"), (5, 1, "references"), (6, 4, "accesses")])
    churn = spark.createDataFrame([("a.rs", 3)], "path string, commits long")
    got = [(r.id, r.pub_fields, r.total_fields, r.inbound_refs, r.churn, r.score) for r in coupling.god_structs(g, churn).collect()]
    assert got == [(1, 1, 2, 2, 3, 6), (2, 1, 2, 2, 0, 2)]


def test_impact_breakdown(spark):
    nodes = [node(1, "S", "struct", file="src/s.rs"), node(2, "x", "field", file="src/s.rs"), node(3, "f", file="src/m/mod.rs")]
    g = graph(spark, nodes, [(1, 2, "contains"), (3, 2, "accesses"), (3, 1, "extends"), (3, 2, "accesses")])
    churn = spark.createDataFrame([("src/m/mod.rs", 2), ("src/m/lib.rs", 1)], "path string, commits long")
    got = {(r.section, r["name"]): (r.edges, r.churn) for r in coupling.impact_breakdown(g, "S", churn).collect()}
    assert got == {("kind", "field-read (model)"): (2, None), ("kind", "extends"): (1, None), ("total", "S"): (3, None), ("module", "src/m"): (3, 3)}


def test_strong_components_never_stop_silently(spark):
    chain = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)], "a long, b long")
    with pytest.raises(RuntimeError):
        traverse.strong_components(chain, rounds=1)
    assert {(r.node, r.component) for r in traverse.strong_components(chain).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
