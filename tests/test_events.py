from pyspark.sql import functions as F
from test_sources import files

from threadloom.operators.index import current, layers, published
from threadloom.operators.lookup import callers
from threadloom.streaming.events import changes, last_versions, stream_index

VERSIONS = "path string, version long, content_hash string"


def follow(spark, tmp_path, *batches):
    """What each batch of a stream changes; the query is begun anew for each, from its progress."""
    told = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(VERSIONS).parquet(f"{tmp_path}/in")
        q = changes(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/progress").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()
        seen = sorted(tuple(r) for r in spark.read.schema("path string, version long, change string, content_hash string").parquet(f"{tmp_path}/out").collect())
        told.append([r for r in seen if r not in [x for t in told for x in t]])
        assert sum(map(len, told)) == len(seen), i  # nothing is told twice
    return told


def test_changes_of_paths_over_restarts(spark, tmp_path):
    told = follow(
        spark,
        tmp_path,
        [("a", 2, "y"), ("a", 1, "x"), ("b", 1, "x"), ("c", 1, None), (None, 1, "x"), ("d", None, "x")],
        [("a", 2, "z"), ("a", 3, "y"), ("b", 2, None), ("c", 2, "q"), ("e", 1, "w"), ("e", 1, "v"), ("e", 1, None)],
        [("b", 1, "x"), ("b", 3, "x"), ("a", 4, "w"), ("a", 5, "y")],
        [("b", 3, "x"), ("a", 5, "y")],
    )
    assert told == [
        [("a", 1, "added", "x"), ("a", 2, "changed", "y"), ("b", 1, "added", "x")],
        [("b", 2, "removed", None), ("c", 2, "added", "q"), ("e", 1, "added", "v")],
        [("a", 4, "changed", "w"), ("a", 5, "changed", "y"), ("b", 3, "added", "x")],
        [],
    ]


def test_last_versions(spark):
    rows = files(spark, a_dot_py="one").withColumn("version", F.lit(2)).unionByName(files(spark, a_dot_py="two").withColumn("version", F.lit(3))).unionByName(files(spark, a_dot_py="old", b_dot_py="b").withColumn("version", F.lit(1)))
    assert {r.path: r.content for r in last_versions(rows).collect()} == {"a.py": "two", "b.py": "b"}
    assert {r.content for r in last_versions(rows.drop("version").where("path = 'b.py'")).collect()} == {"b"}
    assert last_versions(rows.limit(0)).count() == 0


def test_a_stream_updates_the_index_by_layers(spark, tmp_path):
    index, schema = f"file://{tmp_path}/index", files(spark, x_dot_py="").withColumn("version", F.lit(1)).schema

    def give(version, *gone, **contents):
        rows = files(spark, **contents, **dict.fromkeys(gone, "")).withColumn("version", F.lit(version))
        paths = [p.replace("_dot_", ".") for p in gone]
        rows.withColumn("content", F.when(~F.col("path").isin(paths), F.col("content"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        q = stream_index(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), index, f"file://{tmp_path}/progress")
        q.processAllAvailable()
        q.stop()
        return [r["name"] for r in callers(current(spark, index), "b").collect()]

    give(1, a_dot_py="def a():\n    b()\n", b_dot_py="def b():\n    pass\n")
    assert run() == ["a"]
    give(3, c_dot_py="def c():\n    b()\n")
    give(2, "a_dot_py", c_dot_py="def old():\n    b()\n")
    assert run() == ["c"]
    was = published(spark, index)
    assert len(layers(spark, index, was)) == 2
    give(4, c_dot_py="def c():\n    b()\n")  # as it is
    assert run() == ["c"]
    assert published(spark, index) == was
