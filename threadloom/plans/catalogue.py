"""The query catalogue over the star graph: each name with its DataFrame form and the SQL that says the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, task_keywords
from ..operators import changes, coupling, lookup, resolve, search, textindex, traverse
from ..schema import Graph
from ..sources.slices import slice_lines
from .order_sources import order_index, order_nodes
from .star_graph import SQL, star_churn, star_graph, star_nodes, star_refs, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CUSTOMER, SUPPLIER, BRAND, PART = "Customer#000000001", "Supplier#000000003", "Brand#13", "cold widget"
BASIC = ("id", "kind", "name", "file_path")
COLUMNS = "id, kind, name, file_path"


def query(sql: str | None = None, graph: bool = True):
    """Registers a query under its function's name; sql goes after the clauses of the star graph."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {SQL}" if graph else "") + sql
        return f

    return register


@query(", totals AS (SELECT 'total' AS section, 'files' AS name, count(DISTINCT file_path) AS count FROM nodes0 UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes0 UNION ALL SELECT 'total', 'edges', count(*) FROM edges) SELECT * FROM totals UNION ALL SELECT 'kind', kind, count(*) FROM nodes0 GROUP BY kind UNION ALL SELECT 'language', language, count(*) FROM nodes0 GROUP BY language")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.index_status(star_graph(spark, sf_dir))


@query("SELECT id, kind, name, start_line, end_line FROM nodes WHERE file_path = 'parts/brand_13.ts'")
def nodes_by_file(spark, sf_dir):
    return lookup.nodes_by_file(star_graph(spark, sf_dir, lines=True), "parts/brand_13.ts").select("id", "kind", "name", "start_line", "end_line")


@query(f"SELECT {COLUMNS} FROM nodes0 WHERE kind = 'enum'")
def nodes_by_kind(spark, sf_dir):
    return lookup.nodes_by_kind(star_graph(spark, sf_dir), "enum").select(*BASIC)


@query(f"SELECT {COLUMNS} FROM nodes0 WHERE name = '{PART}' ORDER BY id LIMIT 1")
def find_node(spark, sf_dir):
    return lookup.find_node(star_graph(spark, sf_dir), PART).select(*BASIC)


@query(f"SELECT {COLUMNS} FROM nodes0 WHERE name = '{PART}' ORDER BY file_path <> 'parts/brand_5.ts', id LIMIT 1")
def find_node_preferring_file(spark, sf_dir):
    return lookup.find_preferring_file(star_graph(spark, sf_dir), PART, "parts/brand_5.ts").select(*BASIC)


TOKENS = "' ' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT {COLUMNS} FROM nodes0 WHERE contains({TOKENS.format('name')}, ' widg') OR contains({TOKENS.format('qualified_name')}, ' widg') ORDER BY length(name), name, id LIMIT 20")
def name_search(spark, sf_dir):
    return search.search_names(star_graph(spark, sf_dir), "widg").select(*BASIC)


@query(f"SELECT {COLUMNS} FROM nodes0 WHERE kind = 'enum_member' AND lower(name) LIKE 'c%' ORDER BY length(name), name, id LIMIT 20")
def name_search_prefix_like(spark, sf_dir):
    return search.search_names(star_graph(spark, sf_dir), "c", kind="enum_member").select(*BASIC)


@query(
    """
WITH t AS (SELECT doc_id AS id, [x FOR x IN string_split_regex(lower(text), '[^a-z0-9]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n, sum(len(w)) AS total FROM t),
p AS (SELECT id, len(w) AS len, q.token, q.times, len([x FOR x IN w IF x = q.token]) AS tf FROM t, (VALUES ('the', 1), ('thing', 2)) q(token, times)),
f AS (SELECT token, count(*) AS df FROM p WHERE tf > 0 GROUP BY token),
i AS (SELECT token, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM f, n),
s AS (SELECT id, count(*) AS terms, -sum(idf * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / n)))) AS score FROM p JOIN i USING (token), n WHERE tf > 0 GROUP BY id)
SELECT id, round(score, 6) AS score FROM s WHERE terms = 2 ORDER BY round(score, 9), id LIMIT 20""",
    graph=False,
)
def semantic_search_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    texts = docs.select(F.col("doc_id").alias("id"), words.alias("tokens"))
    totals = texts.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total"))
    return search.bm25(search.postings_of(texts, ["the", "thing"]), totals, ["thing", "the", "thing"]).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT {COLUMNS} FROM nodes0 WHERE contains({TOKENS.format('name')}, ' cold widg') OR contains({TOKENS.format('qualified_name')}, ' cold widg') ORDER BY length(name), name, id LIMIT 20")
def name_search_stored(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return search.search_names(replace(g, names=textindex.stored(textindex.name_places(g.nodes), "name-places", "token", "id")), "cold widg").select(*BASIC)


@query(
    """
WITH t AS (SELECT doc_id AS id, [x FOR x IN string_split_regex(lower(text), '[^a-z0-9]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n, sum(len(w)) AS total FROM t WHERE len(w) > 0),
p AS (SELECT id, len(w) AS len, q.token, q.times, len([x FOR x IN w IF x = q.token]) AS tf FROM t, (VALUES ('and', 1), ('of', 2)) q(token, times)),
f AS (SELECT token, count(*) AS df FROM p WHERE tf > 0 GROUP BY token),
i AS (SELECT token, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM f, n),
s AS (SELECT id, count(*) AS terms, -sum(idf * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / n)))) AS score FROM p JOIN i USING (token), n WHERE tf > 0 GROUP BY id)
SELECT id, round(score, 6) AS score FROM s WHERE terms = 2 ORDER BY round(score, 9), id LIMIT 20""",
    graph=False,
)
def semantic_search_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    texts = docs.select(F.col("doc_id").alias("id"), words.alias("tokens"))
    blocks = textindex.stored(textindex.posting_blocks(texts), "posting-blocks", "token", "block")
    return textindex.BlockSearch(blocks, textindex.totals_of(texts), ["of", "and", "of"]).rows().select("id", F.round("score", 6).alias("score"))


# Graphs of source files that are made from orders and customers: see order_sources.


@query(
    """
SELECT 'file' AS kind, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(DISTINCT o_orderpriority) FROM orders) AS count
UNION ALL SELECT 'class', (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer)
UNION ALL SELECT 'function', (SELECT count(*) FROM orders) + (SELECT count(DISTINCT o_orderpriority) FROM orders)""",
    graph=False,
)
def extracted_kinds(spark, sf_dir):
    return order_nodes(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("count"))


@query("SELECT 'Customer_' || o_custkey AS name, 'customers/c' || o_custkey || '.py' AS file_path, 2 * count(*) AS uses FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey", graph=False)
def extracted_owners(spark, sf_dir):
    """A call belongs to the function that holds it and to the class around that."""
    calls = _calls(order_index(spark, sf_dir)).where("file_path LIKE 'customers/%'")
    return calls.groupBy("name", "file_path").agg(F.count("*").alias("uses"))


@query("SELECT 'handle_' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS name, unnest(['settle_' || o_orderkey, 'Order_' || o_orderkey]) AS caller, 3::INT AS line FROM orders", graph=False)
def extracted_callers(spark, sf_dir):
    g = order_index(spark, sf_dir)
    callers_ = g.nodes.select(F.col("id").alias("source_id"), F.col("name").alias("caller"))
    return _calls(g).where("file_path LIKE 'handlers/%'").join(callers_, "source_id").select("name", "caller", "line")


def _calls(g: Graph) -> DataFrame:
    """Calls with name and file of what they lead to."""
    targets = g.nodes.select(F.col("id").alias("target_id"), "name", F.col("file_path"))
    return g.edges.where("kind = 'calls'").select("source_id", "target_id", "line").join(targets, "target_id")


def _neighbours(near: str, far: str, name: str) -> str:
    return f"SELECT e.id AS edge_id, x.id, x.kind, x.name, x.file_path FROM edges e JOIN nodes0 x ON x.id = e.{far} WHERE e.kind = 'calls' AND e.{near} = (SELECT min(id) FROM nodes0 WHERE name = '{name}') ORDER BY e.id LIMIT 20"


@query(_neighbours("target_id", "source_id", SUPPLIER))
def callers(spark, sf_dir):
    return lookup.callers(star_graph(spark, sf_dir), SUPPLIER).select("edge_id", *BASIC)


@query(_neighbours("source_id", "target_id", CUSTOMER))
def callees(spark, sf_dir):
    return lookup.callees(star_graph(spark, sf_dir), CUSTOMER).select("edge_id", *BASIC)


@query(f"SELECT {COLUMNS} FROM nodes0 WHERE id IN (SELECT source_id FROM edges JOIN nodes0 n ON n.id = target_id WHERE edges.kind = 'contains' AND n.name = '{BRAND}' UNION SELECT target_id FROM edges JOIN nodes0 n ON n.id = source_id WHERE edges.kind = 'contains' AND n.name = '{BRAND}')")
def hierarchy(spark, sf_dir):
    return lookup.hierarchy(star_graph(spark, sf_dir), BRAND).select(*BASIC)


@query(f", extends AS (SELECT s_suppkey * 8 + 2 AS source_id, (s_suppkey % 10) * 8 + 1 AS target_id FROM supplier) SELECT x.id, x.kind, x.name, x.file_path FROM extends e JOIN nodes0 t ON t.id = e.target_id JOIN nodes0 x ON x.id = e.source_id WHERE t.name = '{CUSTOMER}'")
def implementations(spark, sf_dir):
    """Over added extends edges: indexing itself makes none."""
    g = star_graph(spark, sf_dir)
    k = F.col("s_suppkey")
    added = table(spark, sf_dir, "supplier").select((k * 16 + 15).alias("id"), (k * 8 + 2).alias("source_id"), ((k % 10) * 8 + 1).alias("target_id"), F.lit("extends").alias("kind"))
    return lookup.implementations(Graph(g.nodes, g.edges.unionByName(added, allowMissingColumns=True)), CUSTOMER).select(*BASIC)


@query(f"SELECT n.id, n.kind, n.name, n.file_path FROM edges e JOIN nodes0 o ON o.id = e.source_id JOIN nodes0 n ON n.id = e.target_id WHERE e.kind = 'contains' AND o.name = '{CUSTOMER}' AND n.kind = 'field'")
def struct_fields(spark, sf_dir):
    return lookup.struct_fields(star_graph(spark, sf_dir), CUSTOMER).select(*BASIC)


@query(f""", hit AS (SELECT e.kind, x.name, row_number() OVER (PARTITION BY e.kind ORDER BY e.id) AS nth FROM edges e JOIN nodes0 x ON x.id = e.source_id WHERE e.target_id = (SELECT min(id) FROM nodes0 WHERE name = '{PART}') AND e.kind IN ('calls', 'imports', 'extends', 'implements', 'contains', 'references', 'exports'))
SELECT kind, count(*) AS count, string_agg(name, ', ' ORDER BY nth) FILTER (nth <= 20) AS shown FROM hit GROUP BY kind""")
def references_by_kind(spark, sf_dir):
    return lookup.references_by_kind(star_graph(spark, sf_dir), PART).select("kind", "count", F.array_join(F.transform("shown", lambda x: x["name"]), ", ").alias("shown"))


@query(f""", walk(id, level) AS (SELECT min(id), 0 FROM nodes0 WHERE name = '{CUSTOMER}' UNION SELECT e.source_id, w.level + 1 FROM walk w JOIN edges e ON e.target_id = w.id AND e.kind = 'calls' WHERE w.level < 3)
SELECT id, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY id HAVING min(level) > 0""")
def impact_bfs(spark, sf_dir):
    return traverse.impact(star_graph(spark, sf_dir), CUSTOMER, depth=3)


MODULE = "CASE WHEN regexp_extract({0}, '([^/]*)$', 1) IN ('mod.rs', 'lib.rs', 'main.rs') THEN regexp_extract({0}, '^(.*)/[^/]*$', 1) ELSE regexp_replace({0}, '\\.[^./]*$', '') END"
LABEL = "CASE e.kind WHEN 'calls' THEN 'method-call (contract)' WHEN 'accesses' THEN 'field-read (model)' WHEN 'mutates' THEN 'field-write (intrusive)' WHEN 'references' THEN 'reference' WHEN 'tests' THEN 'test' ELSE e.kind END"


@query(f""", root AS (SELECT min(id) AS id FROM nodes0 WHERE name = '{CUSTOMER}'),
into_ AS (SELECT {LABEL} AS label, {MODULE.format("e.file_path")} AS module FROM edges e JOIN (SELECT id FROM root UNION ALL SELECT target_id FROM edges JOIN root ON source_id = root.id WHERE kind = 'contains') t ON e.target_id = t.id WHERE e.kind <> 'contains'),
mc AS (SELECT {MODULE.format("path")} AS module, sum(commits) AS churn FROM churn GROUP BY 1)
SELECT 'kind' AS section, label AS name, count(*) AS edges, CAST(NULL AS BIGINT) AS churn FROM into_ GROUP BY label
UNION ALL SELECT 'total', '{CUSTOMER}', count(*), NULL FROM into_
UNION ALL SELECT 'module', module, count(*), CAST(any_value(churn) AS BIGINT) FROM into_ LEFT JOIN mc USING (module) GROUP BY module""")
def impact_breakdown(spark, sf_dir):
    return coupling.impact_breakdown(star_graph(spark, sf_dir), CUSTOMER, star_churn(spark, sf_dir))


@query(""", walk(id, path) AS (SELECT 21 * 8 + 1, '21' UNION ALL SELECT (id // 8 // 2) * 8 + 1, path || '>' || (id // 8 // 2) FROM walk WHERE id // 8 >= 2)
SELECT CAST(1 AS INTEGER) AS nth, path FROM walk WHERE id = 1 * 8 + 1""")
def call_paths(spark, sf_dir):
    """On the tree of calls c -> c / 2 alone, where one path exists."""
    g = star_graph(spark, sf_dir)
    tree = Graph(g.nodes, g.edges.where("id % 16 = 1"))
    return _keys(traverse.call_paths(tree, "Customer#000000021", CUSTOMER))


@query()
def call_paths_whole_graph(spark, sf_dir):
    """On all calls of the star graph. Breadth-first order with one expansion of a node has no SQL; a test has the queue."""
    return _keys(traverse.call_paths(star_graph(spark, sf_dir), "Customer#000000021", CUSTOMER))


def _keys(found: DataFrame) -> DataFrame:
    return found.select("nth", F.array_join(F.transform("path", lambda x: F.floor(x / 8).cast("string")), ">").alias("path"))


@query(f""", calls AS (SELECT source_id AS a, target_id AS b FROM edges WHERE kind = 'calls' UNION ALL SELECT target_id, source_id FROM edges WHERE kind = 'calls'),
walk(id, level) AS (SELECT min(id), 0 FROM nodes0 WHERE name = '{SUPPLIER}' UNION SELECT b, level + 1 FROM walk JOIN calls ON a = id WHERE level < 2)
SELECT id, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY id""")
def subgraph(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return traverse.subgraph(g, lookup.find_node(g, SUPPLIER), edge_kinds=("calls",))[0]


@query(f""", roots AS (SELECT id FROM nodes0 WHERE name IN ('{CUSTOMER}', 'Customer#000000002')),
ranked AS (SELECT source_id AS root, target_id AS id, 1.0 / row_number() OVER (PARTITION BY source_id ORDER BY id) AS score, row_number() OVER (PARTITION BY source_id ORDER BY id) AS nth FROM edges WHERE kind = 'calls' AND source_id IN (SELECT id FROM roots)
 UNION ALL SELECT target_id, source_id, 0.8 / row_number() OVER (PARTITION BY target_id ORDER BY id), row_number() OVER (PARTITION BY target_id ORDER BY id) FROM edges WHERE kind = 'calls' AND target_id IN (SELECT id FROM roots))
SELECT id, round(CAST(sum(score) AS DOUBLE), 6) AS score FROM ranked WHERE nth <= 10 AND id NOT IN (SELECT id FROM roots) GROUP BY id ORDER BY round(CAST(sum(score) AS DOUBLE), 9) DESC, id LIMIT 10""")
def related_rank(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    roots = g.nodes.where(F.col("name").isin(CUSTOMER, "Customer#000000002")).select("id")
    return coupling.related_rank(g, roots).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT {COLUMNS} FROM nodes0 WHERE kind IN ('function', 'method', 'class', 'struct', 'interface') AND NOT is_test AND id NOT IN (SELECT target_id FROM edges WHERE kind IN ('calls', 'references', 'instantiates', 'tests'))")
def unused_symbols(spark, sf_dir):
    g = star_graph(spark, sf_dir, lines=True)
    return lookup.unused_symbols(g).select(*BASIC)


RESOLVED = """, found AS (SELECT r.id AS ref_id, r.source_node_id AS source_id, coalesce((SELECT min(n.id) FROM nodes0 n WHERE n.name = r.reference_name AND n.file_path = r.file_path), (SELECT min(n.id) FROM nodes0 n WHERE n.name = r.reference_name)) AS target_id, r.kind, r.file_path FROM refs r {}),
hits AS (SELECT * FROM found WHERE target_id IS NOT NULL)
SELECT ref_id, source_id, target_id, kind, file_path FROM hits"""


@query(RESOLVED.format(""))
def resolve_refs(spark, sf_dir):
    g = Graph(star_nodes(spark, sf_dir), None, star_refs(spark, sf_dir))
    return resolve.resolve_references(g).select("ref_id", "source_id", "target_id", "kind", "file_path")


@query(RESOLVED.format("WHERE r.file_path IN ('parts/brand_1.ts', 'parts/brand_7.ts')"))
def resolve_refs_scoped(spark, sf_dir):
    g = Graph(star_nodes(spark, sf_dir), None, star_refs(spark, sf_dir))
    files = spark.createDataFrame([("parts/brand_1.ts",), ("parts/brand_7.ts",)], "file_path string")
    return resolve.resolve_references(g, files).select("ref_id", "source_id", "target_id", "kind", "file_path")


@query(""", calls AS (SELECT e.id AS ref_id, e.source_id, t.name, e.file_path, s.is_test FROM edges e JOIN nodes0 s ON s.id = e.source_id JOIN nodes0 t ON t.id = e.target_id WHERE e.kind = 'calls'),
found AS (SELECT c.ref_id, c.source_id, coalesce((SELECT min(n.id) FROM nodes0 n WHERE n.name = c.name AND n.file_path = c.file_path), (SELECT min(n.id) FROM nodes0 n WHERE n.name = c.name)) AS target_id FROM calls c WHERE c.is_test)
SELECT * FROM found""")
def tests_edges(spark, sf_dir):
    """The tests edges that resolution adds, from calls as references by name."""
    g = star_graph(spark, sf_dir)
    named = g.nodes.select(F.col("id").alias("target_id"), F.col("name").alias("reference_name"))
    refs = g.edges.where("kind = 'calls'").join(named, "target_id").select("id", F.col("source_id").alias("source_node_id"), "reference_name", "kind", "file_path", "line", F.lit(None).cast("int").alias("column"), "detail")
    return resolve.resolve_references(Graph(g.nodes, g.edges, refs)).where("kind = 'tests'").select("ref_id", "source_id", "target_id")


@query(""", hit AS (SELECT id FROM nodes WHERE file_path = 'europe/nation_3/customers.rs' AND start_line <= 60 AND end_line >= 25 OR file_path = 'africa/nation_0/mod.rs' AND start_line <= 15 AND end_line >= 12),
calls AS (SELECT e.source_id AS id, row_number() OVER (PARTITION BY e.target_id ORDER BY e.id) AS nth FROM edges e JOIN hit ON e.target_id = hit.id WHERE e.kind = 'calls')
SELECT id, max(direct) AS direct FROM (SELECT id, true AS direct FROM hit UNION ALL SELECT id, false FROM calls WHERE nth <= 100) GROUP BY id""")
def diff_impact(spark, sf_dir):
    regions = spark.createDataFrame([("europe/nation_3/customers.rs", 25, 60), ("africa/nation_0/mod.rs", 12, 15)], "file_path string, first int, last int")
    return lookup.diff_impact(star_graph(spark, sf_dir, lines=True), regions).select("id", "direct")


@query(f"""SELECT s.file_path, string_agg(DISTINCT m.name, ', ' ORDER BY m.name) AS members FROM edges e JOIN nodes0 m ON m.id = e.target_id JOIN edges h ON h.target_id = m.id AND h.kind = 'contains' JOIN nodes0 n ON n.id = h.source_id JOIN nodes0 s ON s.id = e.source_id
WHERE e.kind = 'references' AND m.kind = 'enum_member' AND n.kind = 'enum' AND n.name = '{BRAND}' GROUP BY s.file_path""")
def dispatch_sites(spark, sf_dir):
    return lookup.dispatch_sites(star_graph(spark, sf_dir), BRAND).select("file_path", F.array_join("members", ", ").alias("members"))


@query(""", fields AS (SELECT o.name, f.id, f.visibility FROM edges e JOIN nodes0 o ON o.id = e.source_id AND o.kind IN ('struct', 'class', 'interface', 'trait', 'protocol') JOIN nodes0 f ON f.id = e.target_id AND f.kind IN ('field', 'property') WHERE e.kind = 'contains'),
counts AS (SELECT name, count(*) FILTER (visibility = 'public') AS pub_fields, count(*) AS total_fields FROM fields GROUP BY name),
inb AS (SELECT name, count(DISTINCT file_path) AS inbound_refs FROM (SELECT t.name, e.file_path FROM nodes0 t JOIN edges e ON e.target_id = t.id AND e.kind <> 'contains' WHERE t.kind IN ('class', 'struct') UNION ALL SELECT f.name, e.file_path FROM fields f JOIN edges e ON e.target_id = f.id AND e.kind <> 'contains') GROUP BY name)
SELECT t.id, t.name, t.file_path, coalesce(pub_fields, 0) AS pub_fields, coalesce(total_fields, 0) AS total_fields, coalesce(inbound_refs, 0) AS inbound_refs, coalesce(commits, 0) AS churn,
  greatest(coalesce(pub_fields, 0), 1) * greatest(coalesce(inbound_refs, 0), 1) * greatest(coalesce(commits, 0), 1) AS score
FROM nodes0 t LEFT JOIN counts USING (name) LEFT JOIN inb USING (name) LEFT JOIN churn ON churn.path = t.file_path WHERE t.kind IN ('class', 'struct') ORDER BY score DESC, t.name, t.id LIMIT 20""")
def god_struct(spark, sf_dir):
    return coupling.god_structs(star_graph(spark, sf_dir), star_churn(spark, sf_dir))


@query("SELECT source_file, target_file, kind, detail, count(*) AS n FROM endpoints GROUP BY ALL")
def edge_endpoints(spark, sf_dir):
    return lookup.edge_endpoints(star_graph(spark, sf_dir)).groupBy("source_file", "target_file", "kind", "detail").agg(F.count("*").alias("n"))


FOLDS = {"file": "{0}", "dir": "regexp_extract({0}, '^(.*)/[^/]*$', 1)", "module": MODULE}
FOLDED = """, folded AS (SELECT {a} AS "from", {b} AS "to", kind, count(*) AS n FROM endpoints WHERE kind NOT IN ('contains', 'tests') GROUP BY ALL),
fe AS (SELECT "from", "to", CAST(sum(n) AS BIGINT) AS count, string_agg(kind || ':' || n, ', ' ORDER BY kind) AS by_kind, max(CASE kind WHEN 'calls' THEN 1 WHEN 'accesses' THEN 2 WHEN 'mutates' THEN 3 ELSE 0 END) AS strength FROM folded WHERE "from" <> "to" GROUP BY ALL)"""


def _folded(granularity: str) -> str:
    fold = FOLDS[granularity]
    return FOLDED.format(a=fold.format("source_file"), b=fold.format("target_file"))


def _module_edges(granularity: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = coupling.module_edges(star_graph(spark, sf_dir), granularity)
        return edges.select("from", "to", "count", coupling.as_text(F.col("by_kind")).alias("by_kind"), "strength")

    run.__name__ = f"module_graph_edges_{granularity}"
    return run


for _g in FOLDS:
    query(_folded(_g) + " SELECT * FROM fe")(_module_edges(_g))

MODULE_CHURN = f", mc AS (SELECT {MODULE.format('path')} AS module, CAST(sum(commits) AS BIGINT) AS churn FROM churn GROUP BY 1)"


@query(_folded("module") + MODULE_CHURN + """, ends AS (SELECT "from" AS module, 0 AS i, 1 AS o FROM fe UNION ALL SELECT "to", 1, 0 FROM fe)
SELECT module, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, any_value(churn) AS churn FROM ends LEFT JOIN mc USING (module) GROUP BY module""")
def module_graph_nodes(spark, sf_dir):
    edges = coupling.module_edges(star_graph(spark, sf_dir))
    return coupling.module_nodes(edges, coupling.module_churn(star_churn(spark, sf_dir)))


@query(_folded("dir") + """, reach(a, b) AS (SELECT "from", "to" FROM fe UNION SELECT r.a, f."to" FROM reach r JOIN fe f ON f."from" = r.b),
comp AS (SELECT r.a AS node, min(r.b) AS component FROM reach r JOIN reach back ON back.a = r.b AND back.b = r.a GROUP BY r.a)
SELECT string_agg(node, ', ' ORDER BY node) AS cycle FROM comp GROUP BY component HAVING count(*) > 1""")
def module_cycles(spark, sf_dir):
    edges = coupling.module_edges(star_graph(spark, sf_dir), "dir")
    return coupling.module_cycles(edges).select(F.array_join("cycle", ", ").alias("cycle"))


@query(_folded("module") + MODULE_CHURN + """, scored AS (SELECT fe.*, CASE WHEN regexp_extract("from", '^(.*)/[^/]*$', 1) = regexp_extract("to", '^(.*)/[^/]*$', 1) THEN 1 WHEN split_part("from", '/', 1) = split_part("to", '/', 1) THEN 2 ELSE 3 END AS distance,
  greatest(coalesce(a.churn, 1), coalesce(b.churn, 1), 1) AS volatility FROM fe LEFT JOIN mc a ON a.module = "from" LEFT JOIN mc b ON b.module = "to")
SELECT "from", "to", count, strength, distance, volatility, strength * distance * volatility AS impact FROM scored""")
def coupling_score(spark, sf_dir):
    edges = coupling.module_edges(star_graph(spark, sf_dir))
    scored = coupling.coupling_score(edges, coupling.module_churn(star_churn(spark, sf_dir)))
    return scored.select("from", "to", "count", "strength", "distance", "volatility", "impact").orderBy(F.desc("impact"), "from", "to")


@query("SELECT path, commits FROM churn ORDER BY commits DESC, path LIMIT 30")
def churn_rank(spark, sf_dir):
    return coupling.churn_rank(star_churn(spark, sf_dir))


@query(
    """
WITH old AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT 'doc/' || doc_id AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(new.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' WHEN old.hash = new.hash THEN 'same' ELSE 'changed' END AS state
FROM new FULL JOIN old ON new.path = old.path""",
    graph=False,
)
def changed_files(spark, sf_dir):
    """Two snapshots of the documents: some rows new, some gone, some different."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    old = docs.where("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("content_hash"))
    new = docs.where("doc_id % 13 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return changes.changed_files(new, old).select("path", "state")


@query("SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS count FROM pages GROUP BY 1", graph=False)
def pages_by_host(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host")).agg(F.count("*").alias("count"))


@query(
    """
WITH f AS (SELECT 'd/' || doc_id || '.' || (['py', 'zig', 'PHP', 'md', 'lua', 'CPP', 'json'])[doc_id % 7 + 1] AS path FROM documents)
SELECT lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS ext, count(*) AS count FROM f WHERE lower(regexp_extract(path, '\\.([^.]*)$', 1)) IN ('zig', 'php', 'lua') GROUP BY 1""",
    graph=False,
)
def unsupported_types(spark, sf_dir):
    from ..sources.scan import unsupported_types as report

    exts = F.array(*map(F.lit, ("py", "zig", "PHP", "md", "lua", "CPP", "json")))
    paths = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(exts, (F.col("doc_id") % 7 + 1).cast("int"))).alias("path"))
    return report(paths)


@query(
    """
WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[^\\p{L}\\p{N}_]+')) AS w FROM conversations)
SELECT conv_id, turn, count(*) AS n_keywords, min(w) AS least, max(w) AS most FROM w
WHERE octet_length(encode(w)) > 2 AND lower(w) NOT IN (STOP)
GROUP BY conv_id, turn""".replace("STOP", ", ".join(f"'{w}'" for w in STOP_WORDS)),
    graph=False,
)
def task_keyword_counts(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(task_keywords(F.col("text"))).alias("w"))
    return words.groupBy("conv_id", "turn").agg(F.count("*").alias("n_keywords"), F.min("w").alias("least"), F.max("w").alias("most"))


@query(f""", q(place, q) AS (VALUES (0, ' widget'), (1, ' brand'), (2, ' order_77'), (3, ' supplier')),
names AS (SELECT id, kind, name, {TOKENS.format("name")} AS a, {TOKENS.format("qualified_name")} AS b FROM nodes0),
hit AS (SELECT place, id, kind, row_number() OVER (PARTITION BY place ORDER BY length(name), name, id) AS rank FROM names JOIN q ON contains(a, replace(q.q, '_', ' ')) OR contains(b, replace(q.q, '_', ' '))),
best AS (SELECT id, min((CASE WHEN kind IN ('function', 'method') THEN 0 WHEN kind IN ('class', 'struct') THEN 1 WHEN kind IN ('interface', 'trait') THEN 2 ELSE 3 END) * 1000000 + place * 1000 + rank) AS k FROM hit WHERE rank <= 5 GROUP BY id)
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS nth, id FROM best ORDER BY k LIMIT 10""")
def context_entry_points(spark, sf_dir):
    words = spark.createDataFrame([("please fix the widget brand order_77 supplier",)], "task string").select(F.posexplode(task_keywords(F.col("task"))).alias("place", "keyword"))
    return search.entry_points(star_graph(spark, sf_dir), words.where("keyword <> 'please'"))


@query(
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE i BETWEEN 2 AND 4 GROUP BY doc_id""",
    graph=False,
)
def definition_slice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    spans = docs.select("path", "doc_id", F.lit(3).alias("start_line"), F.lit(3).alias("end_line")).where(F.size(F.split(docs.content, "\n")) >= 2)
    return slice_lines(docs.select("path", "content"), spans, around=1).select("doc_id", "text")


@query(
    """
SELECT 'src/o' || l_orderkey || '.rs' AS file_path, CAST(l_partkey AS INTEGER) AS first, CAST(CASE WHEN l_quantity = 1 THEN l_partkey ELSE l_partkey + l_quantity - 2 END AS INTEGER) AS last
FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_partkey > 0""",
    graph=False,
)
def diff_hunk_parse(spark, sf_dir):
    from ..sources.git import hunk_regions

    # a diff with a file for each order, of which each seventh was deleted, and a hunk for each of its items
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("@@ -1 +"), F.col("l_partkey"), F.lit(","), F.col("l_quantity").cast("int") - 1, F.lit(" @@ fn")).alias("value"))
    names = items.select("l_orderkey").distinct().withColumn("value", F.when(F.col("l_orderkey") % 7 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/src/o"), F.col("l_orderkey"), F.lit(".rs"))))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("header"), "value"))
    lines = names.withColumn("header", F.lit(True)).unionByName(items.withColumn("header", F.lit(False))).withColumn("place", place)
    return hunk_regions(lines.select(F.floor(F.col("l_orderkey") / 1000).alias("part"), (F.col("l_orderkey") * (1 << 24) + F.col("place")).alias("line_no"), "value"))
