"""Extraction of many small files: work goes with the files' text, and only what is in them is planned for."""

import os

from pyspark.sql import functions as F

from threadloom.operators.index import ROOM, build_index, extract_nodes, extract_tables, numbered_edges, numbered_files
from threadloom.sources.extract import declared, matched_lines, read_code, references, symbols
from threadloom.sources.lexer import scanned

SMALL = "class Box_{0}(Base):\n    def open_{0}(self):\n        lift_{0}()\n"


def small(spark, n):
    return spark.createDataFrame([(f"b{i}.py", SMALL.format(i), "", "python") for i in range(n)], "path string, content string, content_hash string, language string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_files_share_batches():
    import pyarrow as pa

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            return f

    n = 3000
    columns = {"path": [f"b{i}.py" for i in range(n)], "language": ["python"] * n, "content": [SMALL.format(i) for i in range(n)], "marked": [False] * n}
    got = list(scanned(Frame())([pa.RecordBatch.from_pydict(columns)]))
    assert sum(b.num_rows for b in got) == 4 * n
    assert len(got) <= 5  # and not one for each file
    assert [r["head"] for b in got for r in b.to_pylist() if r["path"] == "b7.py"] == [None, "class Box_7(Base):", "def open_7(self):", "lift_7()"]


def test_only_languages_that_are_there_are_planned_for(spark):
    code = read_code(small(spark, 20))
    assert code.languages == ("python",)
    assert "Join" not in plan(declared(code))  # Python has no rules by what a statement stands in
    rows = symbols(code)
    assert {(r.kind, r.name, r.signature) for r in rows.where("path = 'b3.py'").collect()} == {("class", "Box_3", "class Box_3(Base):"), ("function", "open_3", "def open_3(self):")}
    found = references(code, rows)
    assert "Window" in plan(found)  # Box_3(Base) is a declaration, no call
    assert {(r.kind, r.reference_name) for r in found.where("path = 'b3.py'").collect()} == {("calls", "lift_3")}
    other = read_code(small(spark, 2).withColumn("content", F.regexp_replace("content", r"\(Base\)", "")))
    assert "Window" not in plan(references(other, symbols(other)))


def test_plain_files_say_the_same_as_others(spark):
    """What lines tell of symbols is looked up in files with comments, marks or long lines alone."""
    body = 'def first(a):\n    """About\n\n    it."""\n    return a\nclass Second: pass\n'
    files = {"plain.py": body, "commented.py": body + "# end\n", "marked.py": body + "x = 'an async word'\n", "long.py": body + f"y = {'1' * 2000}\n"}
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    code = read_code(rows)
    assert {(r.path, r.plain) for r in code.lines.select("path", "plain").distinct().collect()} == {(p, p == "plain.py") for p in files}
    got: dict = {p: set() for p in files}
    for r in symbols(code).drop("above", "number").collect():
        got[r.path].add(tuple(r[1:]))
    assert all(x == got["plain.py"] for x in got.values())
    assert {(x[2], x[3]) for x in map(lambda r: (r.kind, r.name, r.signature, r.docstring), symbols(code).where("path = 'long.py'").collect())} == {("def first(a):", '"""About\nit."""'), ("class Second: pass", None)}


def test_graph_of_small_files(spark):
    g = build_index(small(spark, 30))
    ids = {r.id: r for r in g.nodes.collect()}
    assert len(ids) == 90
    edges = g.edges.where("kind = 'contains'").collect()
    assert {(ids[e.source_id].kind, ids[e.target_id].kind) for e in edges} == {("file", "class"), ("class", "function")} and len(edges) == 60
    assert {ids[r.source_node_id].name for r in g.refs.where("reference_name = 'lift_9'").collect()} == {"Box_9", "open_9"}
    assert all(r.id >> 24 == r.source_node_id >> 24 for r in g.refs.collect())


def test_nodes_alone_look_for_no_references(spark):
    files = small(spark, 30).unionByName(small(spark, 1).withColumn("path", F.lit("a.py")))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    nodes = extract_nodes(numbered_files(files))
    got = sorted(map(tuple, nodes.collect()))
    made = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert made == {"round", "code", "symbols"}  # names of calls would be in bare-names
    assert got == sorted(map(tuple, build_index(files).nodes.select(nodes.columns).collect()))


def test_equal_paths_have_one_number(spark):
    files = small(spark, 50)
    got = {}
    for r in numbered_files(files.unionByName(files)).collect():
        got.setdefault(r.path, set()).add(r.seq)
    assert got == {p: {i} for i, p in enumerate(sorted(got))} and len(got) == 50


def test_edges_are_numbered_without_a_join(spark):
    nodes, contains, _ = extract_tables(numbered_files(small(spark, 5)))
    edges = numbered_edges(contains)
    assert "Join" not in plan(edges)
    path = {r.id: r.file_path for r in nodes.collect()}
    first = {r.file_path: r.id for r in nodes.where("kind = 'file'").collect()}
    got = edges.collect()
    assert len({e.id for e in got}) == len(got) == 10
    assert all(path[e.source_id] == e.file_path and first[e.file_path] < e.id < first[e.file_path] + ROOM for e in got)


def test_rules_of_references_run_on_lines_with_their_marks(spark):
    code = read_code(spark.createDataFrame([("m.py", "def f(a):\n    a.b = c.d\n    g(a.e)\n    match a:\n        case K.V:\n            pass\n"), ("m.rs", "fn f() {\n    go!(x);\n    match k {\n        K::V => h(),\n    }\n}\n")], "path string, content string"))
    found = references(code, symbols(code))
    assert "Contains(code#" in plan(found)
    assert "content" not in plan(matched_lines(code)).split("Relation")[0]  # texts aren't cut into lines for references
    assert {(r.path, r.kind, r.reference_name) for r in found.collect()} == {
        ("m.py", "mutates", "b"), ("m.py", "accesses", "d"), ("m.py", "accesses", "e"), ("m.py", "accesses", "V"), ("m.py", "calls", "g"), ("m.py", "references", "V"),
        ("m.rs", "calls", "go"), ("m.rs", "calls", "h"), ("m.rs", "references", "V"),
    }
