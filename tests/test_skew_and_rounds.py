"""Hot names, many regions of one file, long chains and many rings: same results, bounded groups and rounds."""

import random

import pytest
from graphs import graph, node

from threadloom.operators import components, lookup, ranges, resolve
from threadloom.schema import NODES, REFS, Graph


@pytest.fixture
def rounds(monkeypatch):
    made = []
    plain = components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: made.append(1) or plain(df))
    return made


def tarjan(pairs):
    """Least member of the component of each node on a cycle."""
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, open_, stack, label = {}, {}, set(), [], {}
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        open_.add(root)
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is not None:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    open_.add(w)
                    work.append((w, iter(out[w])))
                elif w in open_:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                at = stack.index(v)
                part, stack[at:] = stack[at:], []
                open_.difference_update(part)
                if len(part) > 1:
                    label.update(dict.fromkeys(part, min(part)))
    return label


def got(spark, pairs, kind="long"):
    return {r.node: r.component for r in components.strong_components(spark.createDataFrame(list(pairs), f"a {kind}, b {kind}")).collect()}


def test_components_of_a_long_chain_and_of_linked_rings(spark, rounds):
    chain = [(i, i + 1) for i in range(4096)]
    assert got(spark, chain) == {}
    assert len(rounds) < 40
    rounds.clear()
    # a thousand rings of three, each with a bridge to the next, least labels upstream
    links = [e for k in range(1000) for e in ((3 * k, 3 * k + 1), (3 * k + 1, 3 * k + 2), (3 * k + 2, 3 * k), (3 * k + 1, 3 * k + 3))]
    assert got(spark, links) == tarjan(links)
    assert len(rounds) < 150


def test_components_of_random_graphs_against_tarjan(spark):
    for seed, (nodes, edges) in enumerate(((30, 34), (30, 60), (12, 80))):
        rng = random.Random(seed)
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
        assert got(spark, pairs) == tarjan(pairs), seed
    words = [("b", "a"), ("a", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "d"), ("d", "d"), (None, "a"), ("a", "c")]
    assert got(spark, words, "string") == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert got(spark, []) == {}


def test_touched_symbols_against_all_pairs(spark):
    rng = random.Random(5)
    for lines in (3, 7, 4096):
        symbols = [(i, rng.choice("xyz"), s, s + rng.choice((0, 1, 4, 30))) for i, s in enumerate(rng.randrange(90) for _ in range(120))]
        regions = [(rng.choice("xyw"), s, s + rng.choice((0, 0, 2, 11)), "more") for s in (rng.randrange(90) for _ in range(25))]
        want = {i for i, f, s, e in symbols if any(f == g and s <= b and e >= a for g, a, b, _ in regions)}
        table = spark.createDataFrame([*symbols, (900, None, 1, 99), (901, "x", None, 99), (902, "x", 1, None)], "id long, file_path string, start_line int, end_line int")
        more = spark.createDataFrame([*regions, (None, 1, 99, ""), ("x", None, 9, ""), ("x", 1, None, "")], "file_path string, first int, last int, id string")
        rows = [r.id for r in ranges.touched(table, more, lines).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    none = spark.createDataFrame([], more.schema)
    assert ranges.touched(table, none).count() == 0


def test_many_regions_and_symbols_of_one_file(spark):
    n = 100_000
    symbols = spark.range(n).selectExpr("id", "'one.rs' AS file_path", "CAST(id * 3 AS int) AS start_line", "CAST(id * 3 + 1 AS int) AS end_line")
    regions = spark.range(n).selectExpr("'one.rs' AS file_path", "CAST(id * 6 AS int) AS first", "CAST(id * 6 AS int) AS last")
    assert ranges.touched(symbols, regions).selectExpr("count(*) AS n", "max(id % 2) AS odd").first().asDict() == {"n": n // 2, "odd": 0}


def test_diff_impact_of_a_file_symbol(spark):
    g = graph(spark, [node(1, "whole.rs", "file", file="whole.rs", start=0, end=90), node(2, "f", file="whole.rs", start=80, end=85), node(3, "g", file="o.rs")], [(3, 2, "calls")])
    regions = spark.createDataFrame([("whole.rs", 85, 200)], "file_path string, first int, last int")
    assert {(r.id, r.direct) for r in lookup.diff_impact(g, regions).collect()} == {(1, True), (2, True), (3, False)}


def test_resolution_with_a_hot_name_and_a_hot_file(spark, monkeypatch):
    nodes = [node(1, "new", file="a.rs"), node(2, "new", file="f3.rs"), node(3, "go", file="b.rs"), node(4, "rare", file="b.rs"), node(5, "rare", file="f7.rs")]
    rows = [("new", f"f{i % 40}.rs") for i in range(400)] + [("go", "one.rs")] * 300 + [("rare", f"f{i}.rs") for i in range(10)] + [("missing", "one.rs")] * 200 + [("new", None)]
    refs = spark.createDataFrame([(i, 9, n, "calls", f, 1, 0, None) for i, (n, f) in enumerate(rows)], REFS)
    g = Graph(spark.createDataFrame(nodes, NODES), None, refs)
    first = {("new", "f3.rs"): 2, ("rare", "f7.rs"): 5}
    anywhere = {"new": 1, "go": 3, "rare": 4}
    want = sorted((i, first.get((n, f), anywhere[n])) for i, (n, f) in enumerate(rows) if n in anywhere)
    for hot in (1000, 4, 1):  # all, some and no places are hot
        monkeypatch.setattr(resolve, "HOT", hot)
        assert sorted((r.ref_id, r.target_id) for r in resolve.resolve_references(g).collect()) == want
