"""A deterministic property graph over star-schema tables, so that graph queries can run on any data of that shape.

Customers are classes, orders their fields, suppliers functions, brands enums and parts their members; line items are what
functions do to fields and members. Ids are key * 8 + kind (nodes) and key * 16 + kind (edges), unique at every size.
SQL says the same in one WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slug(c: str):
    return F.lower(F.translate(c, " #", "__"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nationkey, m: the module path of each nation. A table of fixed size."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("nationkey"), F.concat(_slug("r_name"), F.lit("/"), _slug("n_name")).alias("m"))


def _node(kind: str, node_id, name, file, module, visibility, is_test, language: str, keep=()):
    return [node_id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.concat(module, F.lit("::"), name).alias("qualified_name"), file.alias("file_path"), visibility.alias("visibility"), is_test.alias("is_test"), F.lit(language).alias("language"), *keep]


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.broadcast(nations(spark, sf_dir))
    public, no = F.lit("public"), F.lit(False)
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nationkey").join(m, "nationkey")
    supplier = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nationkey").join(m, "nationkey")
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    file_of = F.concat("m", F.lit("/customers.rs"))
    classes = customer.select(_node("class", F.col("c_custkey") * 8 + 1, F.col("c_name"), file_of, F.col("m"), public, F.col("c_mktsegment") == "MACHINERY", "rust"))
    functions = supplier.select(_node("function", F.col("s_suppkey") * 8 + 2, F.col("s_name"), F.concat("m", F.lit("/mod.rs")), F.col("m"), public, no, "rust"))
    brand_file = F.concat(F.lit("parts/"), _slug("p_brand"), F.lit(".ts"))
    members = part.select(_node("enum_member", F.col("p_partkey") * 8 + 3, F.col("p_name"), brand_file, F.col("p_brand"), public, no, "typescript"))
    enums = brands(part).select(_node("enum", F.col("brand_id"), F.col("p_brand"), brand_file, F.lit("parts"), public, no, "typescript"))
    owner = customer.select(F.col("c_custkey").alias("o_custkey"), "m", "c_name")
    fields = orders.join(owner, "o_custkey").select(_node("field", F.col("o_orderkey") * 8 + 5, F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), file_of, F.col("c_name"), F.when(F.col("o_orderstatus") == "O", "public").otherwise("private"), no, "rust"))
    nodes = classes.unionByName(functions).unionByName(members).unionByName(enums).unionByName(fields)
    return nodes.withColumn("is_generated", F.lit(False)).withColumn("docstring", F.lit(None).cast("string"))


def brands(part: DataFrame) -> DataFrame:
    """p_brand, brand_id: a brand is named by its first part."""
    return part.groupBy("p_brand").agg((F.min("p_partkey") * 8 + 4).alias("brand_id"))


def with_lines(nodes: DataFrame) -> DataFrame:
    """Ten lines for each symbol of a file, in id order."""
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("id"))
    return nodes.withColumn("start_line", (nth * 10).cast("int")).withColumn("end_line", (F.col("start_line") + 9).cast("int"))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, part, orders, items = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part", "orders", "lineitem"))
    m = F.broadcast(nations(spark, sf_dir))
    n_c, n_s = customer.count(), supplier.count()
    c = customer.withColumnRenamed("c_nationkey", "nationkey").join(m, "nationkey").select(F.col("c_custkey").alias("k"), F.concat("m", F.lit("/customers.rs")).alias("file_path"), (F.col("c_mktsegment") == "MACHINERY").alias("test"))
    s = supplier.withColumnRenamed("s_nationkey", "nationkey").join(m, "nationkey").select(F.col("s_suppkey").alias("k"), F.concat("m", F.lit("/mod.rs")).alias("file_path"))

    def edge(kind, edge_id, source, target, detail=None):
        return [edge_id.alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), "file_path", F.lit(detail).cast("string").alias("detail")]

    k = F.col("k")
    half, ring = c.where("k >= 2"), (k * 31 + 17) % n_c
    out = half.select(edge("calls", k * 16 + 1, k * 8 + 1, F.floor(k / 2).cast("long") * 8 + 1))
    ringed = c.where("k % 3 <> 0")
    out = out.unionByName(ringed.select(edge("calls", k * 16 + 2, k * 8 + 1, ring * 8 + 1)))
    out = out.unionByName(s.select(edge("calls", k * 16 + 3, k * 8 + 2, ((k * 7 + 3) % n_s) * 8 + 2)))
    out = out.unionByName(half.where("test").select(edge("tests", k * 16 + 6, k * 8 + 1, F.floor(k / 2).cast("long") * 8 + 1)))
    out = out.unionByName(ringed.where("test").select(edge("tests", k * 16 + 7, k * 8 + 1, ring * 8 + 1)))
    o = orders.join(c.select(F.col("k").alias("o_custkey"), "file_path"), "o_custkey").select(F.col("o_orderkey").alias("k"), "o_custkey", "file_path")
    out = out.unionByName(o.select(edge("contains", k * 16 + 4, F.col("o_custkey") * 8 + 1, k * 8 + 5)))
    p = part.join(brands(part), "p_brand").select(F.col("p_partkey").alias("k"), "brand_id", F.concat(F.lit("parts/"), _slug("p_brand"), F.lit(".ts")).alias("file_path"))
    out = out.unionByName(p.select(edge("contains", k * 16 + 5, F.col("brand_id"), k * 8 + 3)))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))
    line = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").withColumn("k", F.col("l_orderkey") * 1024 + nth).join(s.select(F.col("k").alias("l_suppkey"), "file_path"), "l_suppkey")
    source = F.col("l_suppkey") * 8 + 2
    out = out.unionByName(line.select(edge(F.when(F.col("l_returnflag") == "R", "mutates").otherwise("accesses"), k * 16 + 8, source, F.col("l_orderkey") * 8 + 5)))
    return out.unionByName(line.where("l_linestatus = 'O'").select(edge("references", k * 16 + 9, source, F.col("l_partkey") * 8 + 3, "dispatch"))).withColumn("line", F.lit(None).cast("int"))


def star_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call from each part to the name of another; every tenth name is missing."""
    part = table(spark, sf_dir, "part")
    n = part.count()
    names = part.select(F.col("p_partkey").alias("to"), F.col("p_name").alias("to_name"))
    refs = part.withColumn("to", (F.col("p_partkey") * 7 + 1) % n).join(names, "to")
    name = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("missing_"), "to_name")).otherwise(F.col("to_name"))
    null = F.lit(None)
    return refs.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 8 + 3).alias("source_node_id"), name.alias("reference_name"), F.lit("calls").alias("kind"), F.concat(F.lit("parts/"), _slug("p_brand"), F.lit(".ts")).alias("file_path"), null.cast("int").alias("line"), null.cast("int").alias("column"), null.cast("string").alias("detail"))


def star_churn(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """Events of the last days, by nation, as commits to its customers file. Now is the last event."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    recent = events.where(F.col("ts") > F.lit(now) - F.expr(f"INTERVAL {days} DAYS")).groupBy((F.col("user_id") % 25).cast("int").alias("nationkey")).agg(F.count("*").alias("commits"))
    return recent.join(F.broadcast(nations(spark, sf_dir)), "nationkey").select(F.concat("m", F.lit("/customers.rs")).alias("path"), "commits")


def star_graph(spark: SparkSession, sf_dir: str, lines: bool = False) -> Graph:
    """The graph; tables that a query doesn't touch are never read."""
    nodes = star_nodes(spark, sf_dir)
    return Graph(with_lines(nodes) if lines else nodes, star_edges(spark, sf_dir))


SQL = """
nations AS (SELECT n_nationkey AS nationkey, lower(translate(r_name, ' #', '__')) || '/' || lower(translate(n_name, ' #', '__')) AS m FROM nation JOIN region ON n_regionkey = r_regionkey),
brands AS (SELECT p_brand, min(p_partkey) * 8 + 4 AS brand_id, 'parts/' || lower(translate(p_brand, ' #', '__')) || '.ts' AS file_path FROM part GROUP BY p_brand),
nodes0 AS (
  SELECT c_custkey * 8 + 1 AS id, 'class' AS kind, c_name AS name, m || '::' || c_name AS qualified_name, m || '/customers.rs' AS file_path, 'public' AS visibility, c_mktsegment = 'MACHINERY' AS is_test, 'rust' AS language FROM customer JOIN nations ON c_nationkey = nationkey
  UNION ALL SELECT s_suppkey * 8 + 2, 'function', s_name, m || '::' || s_name, m || '/mod.rs', 'public', false, 'rust' FROM supplier JOIN nations ON s_nationkey = nationkey
  UNION ALL SELECT p_partkey * 8 + 3, 'enum_member', p_name, p_brand || '::' || p_name, file_path, 'public', false, 'typescript' FROM part JOIN brands USING (p_brand)
  UNION ALL SELECT brand_id, 'enum', p_brand, 'parts::' || p_brand, file_path, 'public', false, 'typescript' FROM brands
  UNION ALL SELECT o_orderkey * 8 + 5, 'field', 'order_' || o_orderkey, c_name || '::order_' || o_orderkey, m || '/customers.rs', CASE WHEN o_orderstatus = 'O' THEN 'public' ELSE 'private' END, false, 'rust' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nations ON c_nationkey = nationkey),
nodes AS (SELECT *, CAST(10 * row_number() OVER (PARTITION BY file_path ORDER BY id) AS INTEGER) AS start_line, CAST(10 * row_number() OVER (PARTITION BY file_path ORDER BY id) + 9 AS INTEGER) AS end_line FROM nodes0),
c AS (SELECT c_custkey AS k, m || '/customers.rs' AS file_path, c_mktsegment = 'MACHINERY' AS test, (SELECT count(*) FROM customer) AS n FROM customer JOIN nations ON c_nationkey = nationkey),
s AS (SELECT s_suppkey AS k, m || '/mod.rs' AS file_path, (SELECT count(*) FROM supplier) AS n FROM supplier JOIN nations ON s_nationkey = nationkey),
items AS (SELECT *, l_orderkey * 1024 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS i FROM lineitem JOIN s ON l_suppkey = k),
edges AS (
  SELECT k * 16 + 1 AS id, k * 8 + 1 AS source_id, (k // 2) * 8 + 1 AS target_id, 'calls' AS kind, file_path, CAST(NULL AS VARCHAR) AS detail FROM c WHERE k >= 2
  UNION ALL SELECT k * 16 + 2, k * 8 + 1, ((k * 31 + 17) % n) * 8 + 1, 'calls', file_path, NULL FROM c WHERE k % 3 <> 0
  UNION ALL SELECT k * 16 + 3, k * 8 + 2, ((k * 7 + 3) % n) * 8 + 2, 'calls', file_path, NULL FROM s
  UNION ALL SELECT k * 16 + 6, k * 8 + 1, (k // 2) * 8 + 1, 'tests', file_path, NULL FROM c WHERE k >= 2 AND test
  UNION ALL SELECT k * 16 + 7, k * 8 + 1, ((k * 31 + 17) % n) * 8 + 1, 'tests', file_path, NULL FROM c WHERE test AND k % 3 <> 0
  UNION ALL SELECT o_orderkey * 16 + 4, o_custkey * 8 + 1, o_orderkey * 8 + 5, 'contains', file_path, NULL FROM orders JOIN c ON o_custkey = k
  UNION ALL SELECT p_partkey * 16 + 5, brand_id, p_partkey * 8 + 3, 'contains', file_path, NULL FROM part JOIN brands USING (p_brand)
  UNION ALL SELECT i * 16 + 8, l_suppkey * 8 + 2, l_orderkey * 8 + 5, CASE WHEN l_returnflag = 'R' THEN 'mutates' ELSE 'accesses' END, file_path, NULL FROM items
  UNION ALL SELECT i * 16 + 9, l_suppkey * 8 + 2, l_partkey * 8 + 3, 'references', file_path, 'dispatch' FROM items WHERE l_linestatus = 'O'),
refs AS (
  SELECT p.p_partkey AS id, p.p_partkey * 8 + 3 AS source_node_id, CASE WHEN p.p_partkey % 10 = 0 THEN 'missing_' ELSE '' END || t.p_name AS reference_name, 'calls' AS kind, b.file_path
  FROM part p JOIN part t ON t.p_partkey = (p.p_partkey * 7 + 1) % (SELECT count(*) FROM part) JOIN brands b ON p.p_brand = b.p_brand),
churn AS (SELECT m || '/customers.rs' AS path, count(*) AS commits FROM events JOIN nations ON user_id % 25 = nationkey WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 90 DAYS GROUP BY 1),
endpoints AS (SELECT a.file_path AS source_file, b.file_path AS target_file, e.kind, e.detail FROM edges e JOIN nodes0 a ON e.source_id = a.id JOIN nodes0 b ON e.target_id = b.id)
"""
