import random

import pytest
from pyspark.sql import functions as F
from test_sources import files

from threadloom.operators.index import Conflict, build_index, current, layers, prune, publish, publish_layer, published, refresh, updated, with_resolved
from threadloom.operators.resolve import references_to, touched_names
from threadloom.operators.search import semantic_search


def tree(rng, n):
    name = lambda: f"f{rng.randrange(12)}"
    return {f"d{i % 3}/m{i}.py": "".join(f"def {name()}():\n    {name()}()\n    {name()}()\n\n" for _ in range(rng.randint(0, 3))) + rng.choice(["", f"def test_{i}():\n    {name()}()\n"]) for i in range(n)}


def listing(spark, contents):
    return files(spark).limit(0) if not contents else files(spark, **contents)


def rows(df, *without):
    return sorted((tuple(str(v) for v in r) for r in df.select(*sorted(c for c in df.columns if c not in without)).collect()))


def same(a, b):
    assert rows(a.nodes) == rows(b.nodes)
    assert rows(a.refs) == rows(b.refs)
    assert rows(a.edges) == rows(b.edges)


def named(g):
    of = {r.id: (r.file_path, r["name"], r.start_line) for r in g.nodes.collect()}
    return sorted((of[r.source_id], of[r.target_id], r.kind, r.line) for r in g.edges.collect())


def symbols_of(g):
    of = {r.id: (r.file_path, r["name"], r.start_line) for r in g.nodes.collect()}
    return sorted(of.values()), sorted((of[r.source_node_id], r.reference_name, r.kind, r.line) for r in g.refs.collect())


def test_updates_as_layers_equal_a_build_at_once(spark, tmp_path):
    rng = random.Random(5)
    folder, contents = f"file://{tmp_path}/index", tree(rng, 8)
    refresh(spark, folder, listing(spark, contents))
    for step in range(2):
        contents |= tree(rng, 10) if step else {"d0/m0.py": "def f3():\n    f4()\n", "new.py": "def f1():\n    pass\n"}
        del contents[sorted(contents)[1]]
        refresh(spark, folder, listing(spark, contents))
        got = current(spark, folder)
        contains = got.edges.where("kind = 'contains'").drop("id")
        same(got, with_resolved(got.nodes, contains, got.refs))  # ids of edges too
        # a build at once numbers files by path, so of equal names in other files another may come first; all else is the same
        assert symbols_of(got) == symbols_of(build_index(listing(spark, contents)))
        assert {r.path: r.content for r in got.sources.collect()} == contents
    assert len(layers(spark, folder, published(spark, folder))) == 3
    whole = publish(got, folder)
    stored = current(spark, folder)
    for q in ("f3", "test 4", "f1 f2"):
        assert semantic_search(got, q).collect() == semantic_search(stored, q).collect()
    assert layers(spark, folder, whole) == [whole]
    assert prune(spark, folder, keep=1) == 3


def test_only_references_to_touched_names_are_resolved_again(spark):
    many = {f"a{i}.py": f"def g{i}():\n    g{(i + 1) % 60}()\n    shared()\n" for i in range(60)}
    g = build_index(listing(spark, many))
    now = many | {"a7.py": "def g7():\n    g9()\n", "b.py": "def other():\n    g1()\n"}
    new, layer = updated(g, listing(spark, now))
    assert sorted(r.file_path for r in layer.replaced.collect()) == ["a7.py", "b.py"]
    # one file calls g7; nobody calls other
    assert sorted(r.file_path for r in layer.renumbered.collect()) == ["a6.py", "a7.py", "b.py"]
    names = touched_names(g.nodes.where("file_path = 'a7.py'"), layer.rows.nodes)
    assert references_to(g.refs.where("file_path <> 'a7.py'"), names).count() == 1
    assert layer.rows.edges.count() == 6
    assert named(new) == named(build_index(listing(spark, now)))


def test_publishers_at_once_lose_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    one = {"a.py": "def a():\n    b()\n"}
    base = publish(build_index(listing(spark, one)), folder)
    first = updated(current(spark, folder), listing(spark, one | {"b.py": "def b():\n    pass\n"}))[1]
    second = updated(current(spark, folder), listing(spark, one | {"c.py": "def c():\n    b()\n"}))[1]
    publish_layer(first, folder, base)
    with pytest.raises(Conflict):
        publish_layer(second, folder, base)
    assert {r.file_path for r in current(spark, folder).nodes.collect()} == {"a.py", "b.py"}
    # what was written for the lost one has no pointer: it may still be in the making
    assert prune(spark, folder, keep=5) == 0
    assert prune(spark, folder, keep=5, grace=-1.0) == 1
    assert prune(spark, folder, keep=5, days=0.0) == 0  # the newest is made of the oldest
    assert current(spark, folder).nodes.where(F.col("name") == "b").count() == 1
