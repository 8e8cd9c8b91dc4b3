import math
import sqlite3

import pytest
from graphs import graph, names, node
from pyspark.sql import functions as F

from threadloom.functions.paths import boundary, distance
from threadloom.functions.text import task_keywords, tokens
from threadloom.operators import search
from threadloom.schema import Graph


@pytest.mark.parametrize(("path", "module", "folder"), [("src/db/mod.rs", "src/db", "src/db"), ("src/mcp/handlers/graph.rs", "src/mcp/handlers/graph", "src/mcp/handlers"), ("a.py", "a", "."), ("main.rs", "main", "."), ("x\\y\\__init__.py", "x/y", "x/y"), (".env", ".env", "."), ("a/.env", "a/.env", "a"), ("a/b.c.d", "a/b.c", "a"), ("/abs.rs", "abs", ""), ("", "", ".")])
def test_boundaries(spark, path, module, folder):
    df = spark.createDataFrame([(path,)], "p string")
    r = df.select(boundary(F.col("p")).alias("m"), boundary(F.col("p"), "dir").alias("d"), boundary(F.col("p"), "file").alias("f"), boundary(F.col("p"), "else").alias("x")).first()
    assert (r.m, r.d, r.f, r.x) == (module, folder, path.replace("\\", "/"), module)


def test_distance(spark):
    df = spark.createDataFrame([("src/a", "src/b", 1), ("src/a/x", "src/b", 2), ("src/a", "lib/b", 3), ("a", "b", 1)], "a string, b string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", distance(F.col("a"), F.col("b"))).collect())


def symbols(spark, *rows):
    return graph(spark, [node(i, n, **more) for i, (n, more) in enumerate(rows, 1)], [(1, 1, "calls")])


def test_name_search(spark):
    g = symbols(spark, ("process_data", {}), ("process_input", {}), ("handle_error", {}), ("MyClass", {"kind": "class"}), ("my_function", {}), ("MyFunction", {"qualified_name": "a::MyFunction"}), ("Café", {}))
    assert names(search.search_names(g, "process")) == ["process_data", "process_input"]
    assert names(search.search_names(g, "handle")) == ["handle_error"]
    assert names(search.search_names(g, "my", kind="function")) == ["MyFunction", "my_function"]
    for q in ("myfunction", "MYFUNCTION"):
        assert names(search.search_names(g, q)) == ["MyFunction"]
    assert names(search.search_names(g, "cafe")) == ["Café"]
    assert names(search.search_names(g, "::")) == []
    assert names(search.search_names(g, "unction")) == []
    assert names(search.search_names(g, "h")) == ["handle_error"]
    assert names(search.search_names(g, 'x"')) == []
    many = symbols(spark, *((f"process_item_{i}", {}) for i in range(20)))
    assert (search.search_names(many, "process", limit=5).count(), search.search_names(many, "process", limit=100).count()) == (5, 20)


def test_semantic_search_finds_docstrings_and_parts(spark):
    g = symbols(spark, ("validate_token", {"docstring": "Verifies a JWT bearer token against the signing key"}), ("renderUserDashboard", {}), ("other", {}))
    assert names(search.semantic_search(g, "jwt bearer")) == ["validate_token"]
    assert names(search.semantic_search(g, "dashboard")) == ["renderUserDashboard"]
    assert names(search.semantic_search(g, "jwt dashboard")) == []
    assert names(search.semantic_search(g, "!!")) == []


def test_bm25_against_sqlite(spark):
    texts = ["the cat sat", "the dog the dog", "a cat and a dog", "bird", "the the the cat", "dog cat dog cat dog"] * 3 + ["long " * 30 + "cat"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    except sqlite3.OperationalError:
        pytest.skip("no fts5 here")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", enumerate(texts))
    table = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", tokens(F.col("t")).alias("tokens"))
    totals = table.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total"))
    for query in ("cat", "dog the", "bird", "long cat", "dog dog"):
        want = dict(db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (query,)))
        got = {r.id: r.score for r in search.bm25(search.postings(table), totals, query.split(), None).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want)


def test_task_keywords(spark):
    df = spark.createDataFrame([("Fix the login_flow in UserService, then add é to it; UserService!",)], "t string")
    assert df.select(task_keywords(F.col("t")).alias("k")).first().k == ["login_flow", "UserService", "UserService"]


def test_context(spark):
    g = symbols(spark, ("login_flow", {"start": 2, "end": 3}), ("UserService", {"kind": "class"}), ("helper", {}))
    from threadloom.schema import EDGES

    edges = spark.createDataFrame([(1, 1, 3, "calls", "test.rs", 1, 0, None)], EDGES)
    sources = spark.createDataFrame([("test.rs", "\n".join(f"line {i}" for i in range(1, 20)))], "path string, content string")
    c = search.build_context(Graph(g.nodes, edges, sources=sources), "Fix the login_flow of UserService", around=1)
    assert names(c["entries"]) == ["login_flow", "UserService"]
    assert names(c["related"]) == ["helper"]
    assert c["edges"].count() == 1
    assert c["code"].first().code == "line 1\nline 2\nline 3\nline 4"
