"""Small graphs for tests."""

from threadloom.schema import EDGES, NODES, Graph


def node(i, name, kind="function", file="test.rs", start=1, end=10, **more):
    row = {"id": i, "kind": kind, "name": name, "qualified_name": f"test::{name}", "file_path": file, "start_line": start, "end_line": end, "start_column": 0, "end_column": 1, "signature": f"fn {name}()", "visibility": "public", "docstring": None, "is_async": False, "is_static": False, "is_exported": True, "is_test": False, "is_generated": False, "language": "rust"} | more
    return tuple(row[c.split()[0]] for c in NODES.split(", "))


def graph(spark, nodes, edges):
    """nodes: rows of node(); edges: (source, target, kind, ...file)."""
    files = {n[0]: n[4] for n in nodes}
    rows = [(i, e[0], e[1], e[2], e[3] if len(e) > 3 else files[e[0]], 1, 0, None) for i, e in enumerate(edges, 1)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES))


def calls(spark, pairs, **nodes):
    names = sorted({x for p in pairs for x in p} | set(nodes))
    ids = {n: i for i, n in enumerate(names, 1)}
    return graph(spark, [node(ids[n], n, **nodes.get(n, {})) for n in names], [(ids[a], ids[b], "calls") for a, b in pairs]), ids


def names(df):
    return [r["name"] for r in df.collect()]
