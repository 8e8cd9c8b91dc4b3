"""Merkle manifest of a dataset, by blocks of leaves that SQL's higher-order functions collapse.

Every row is a leaf: the sha256 of its fields, each by length and value. Rows of a partition are ranked and cut into blocks of
3**6 leaves, one array each. Inside a block, ``aggregate`` goes up the levels; at each, ``sequence``, ``slice`` and
``transform`` make three successive nodes one. The roots of the blocks are the leaves of the next round, until each partition
has one node, its subroot; subroots, in order of their partitions, go up the same way to the root. The way back down gives
every leaf its path: the siblings to the left and to the right at each level.

Ranks are counted by ranges (``running``), so a partition with a third of all rows is many tasks, and so are its blocks. What
goes through one task is a block, or the number of tasks that hold a partition. Rounds are the logarithm of the rows to
the base 729; each reads the roots of the round before.

Defined cases: null fields are "-"; rows go by key (nulls first), ties by leaf, equal rows in any order, as they are the same leaf;
a null partition is one of its own and the first; an empty text is a field of no bytes; very long texts are hashed whole;
a lone leaf is its subroot and a lone subroot the root, with an empty path; an empty table gives no rows; columns that
aren't asked for are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import named, running, written

ARITY = 3
#: Levels and leaves of a block.
DEPTH = 6
BLOCK = ARITY**DEPTH
#: The fields of a document in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value by its length in bytes and itself, or "-"; no two lists of fields read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def _level_above(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(nodes, r * ARITY + 1, F.lit(ARITY)), "")))


def _climb(items: DataFrame, name: str) -> list[DataFrame]:
    """Blocks by round of items(g, place, total, node, also): g, block, of (blocks of g), also (in order), levels (arrays of nodes, leaves first)."""
    rounds = []
    most = items.agg(F.max("total")).first()[0] or 0
    while most:
        block = F.floor(F.col("place") / BLOCK).alias("block")
        rows = items.groupBy("g", block, F.ceil(F.col("total") / BLOCK).cast("long").alias("of"), "total").agg(F.array_sort(F.collect_list(F.struct("place", "node", "also"))).alias("rows"))
        n = F.size("rows")
        # a block of several goes up all its levels, a lone one until one node remains
        height = F.when(F.col("of") > 1, F.lit(DEPTH)).otherwise(F.size(F.filter(F.array(*(F.lit(ARITY**i) for i in range(DEPTH))), lambda x: x < n)))
        steps = F.slice(F.array(*map(F.lit, range(DEPTH))), F.lit(1), height)
        levels = F.aggregate(steps, F.array(F.transform("rows", lambda r: r["node"])), lambda s, _: F.concat(s, F.array(_level_above(F.element_at(s, -1)))))
        rounds.append(written(rows.select("g", "block", "of", F.transform("rows", lambda r: r["also"]).alias("also"), levels.alias("levels")), name))
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
        items = rounds[-1].where("of > 1").select("g", F.col("block").alias("place"), F.col("of").alias("total"), F.element_at(F.element_at("levels", -1), 1).alias("node"), F.lit(None).cast("int").alias("also"))
    return rounds


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """g, node: what remains of each group."""
    tops = [r.where("of = 1").select("g", F.element_at(F.element_at("levels", -1), 1).alias("node")) for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """g, place, node, also, path and the further columns of above(g, path, ...), for each leaf of the lowest round."""
    further = [c for c in above.columns if c not in ("g", "path")]
    upper = None  # paths of the blocks of this round that are nodes of the next
    for r in reversed(rounds):
        lone = r.where("of = 1").join(above, "g")
        blocks = lone if upper is None else lone.unionByName(r.where("of > 1").join(upper, ["g", "block"]).select(lone.columns))
        height = F.size("levels") - 1
        steps = F.slice(F.array(*(F.struct(F.lit(i).alias("level"), F.lit(ARITY**i).alias("width")) for i in range(DEPTH))), F.lit(1), height)
        leaves = blocks.select("*", F.posexplode(F.element_at("levels", 1)).alias("j", "node"))

        def beside(step: Column, before: bool) -> Column:
            nodes, at = F.get("levels", step["level"]), F.floor(F.col("j") / step["width"]).cast("int")
            run = at - at % ARITY
            return F.concat_ws("", *(F.when((run + i < at) if before else (run + i > at), F.get(nodes, run + i)) for i in range(ARITY)))

        own = F.transform(steps, lambda s: F.struct(beside(s, True).alias("left"), beside(s, False).alias("right")))
        found = leaves.select("g", (F.col("block") * BLOCK + F.col("j")).alias("place"), "node", F.get("also", F.col("j")).alias("also"), F.concat(own, "path").alias("path"), *further)
        upper = found.select("g", F.col("place").alias("block"), "path", *further)
    return found


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, from the leaf to the root."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf gives with these siblings."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def merkle_manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, partition: str = "source", key: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row: key, partition, the columns of also, leaf, place (in its partition), subroot, root, path(left, right)."""
    also = {"_none": F.lit(None).cast("int")} if not also else also
    kept = F.struct(*named([key])[0:1], *named([partition]), *(c.alias(n) for n, c in also.items()))
    slim = rows.select(field(named([partition])[0]).alias("g"), named([partition])[0].alias("by"), named([key])[0].alias("key"), leaf(named(list(fields))).alias("node"), kept.alias("also"))
    slim = written(slim, "merkle-leaves")  # dealing by ranges reads its input twice
    places = running(slim, ["by"], ["key", "node"], {"place": "1"}, "merkle-ranks")
    rounds = _climb(places.withColumnRenamed("place_all", "total"), "merkle-blocks")
    if not rounds:
        return slim.select("also.*", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("place"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))).alias("path")).drop("_none")
    tops = _tops(rounds)
    by = F.when(F.col("g") != "-", F.expr("substring(g, instr(g, ':') + 1)"))
    subroots = written(tops.select(by.alias("by"), F.struct("g").alias("also"), "node", F.lit("").alias("all")), "merkle-subroots")
    over = _climb(running(subroots, ["all"], ["by"], {"place": "1"}, "merkle-ranks").select(F.col("all").alias("g"), "place", F.col("place_all").alias("total"), "node", "also"), "merkle-blocks")
    none = F.slice(F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))), F.lit(1), F.lit(0))
    ways = _descend(over, _tops(over).select("g", none.alias("path"), F.col("node").alias("root"))).select("also.g", "path", F.col("node").alias("subroot"), "root")
    found = _descend(rounds, written(ways, "merkle-ways"))
    return found.select("also.*", F.col("node").alias("leaf"), "place", "subroot", "root", "path").drop("_none")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(tampered))
    rows = merkle_manifest(docs, also={"changed": changed})
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(c: str, value: str | None = None) -> str:
    value = value or f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


_LEAF = "sha256(" + " || ".join(_sql_field(c) for c in FIELDS) + ")"
_CHANGED = "sha256(" + " || ".join(_sql_field(c, "replace(text, chr(10), '')" if c == "text" else None) for c in FIELDS) + ")"

OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF} AS leaf,
    CASE WHEN xor(list_reduce([CAST(unicode(ch) AS BIGINT) FOR ch IN string_split(CAST(doc_id AS VARCHAR), '')],
      lambda c, b: list_reduce(CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 2 = 0
      THEN {_CHANGED} END AS changed
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, coalesce('s' || source, '-') AS g FROM d),
tree(g, level, i, h, n) AS (
  SELECT g, 0, i, leaf, n FROM l
  UNION ALL SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, level, i // 3, n),
subroots AS (SELECT g, level AS height, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, i, h, n) AS (
  SELECT 0, i, h, n FROM subroots
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, i // 3, n),
root AS (SELECT h AS root, level AS height FROM top WHERE n = 1),
steps AS (
  SELECT l.g, l.i, lv.level AS step, l.i // CAST(pow(3, lv.level) AS BIGINT) AS at FROM l JOIN subroots s USING (g), unnest(range(0, s.height)) AS lv(level)),
own AS (SELECT p.g, p.i, p.step, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < p.at), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > p.at), '') AS r
  FROM steps p JOIN tree t ON t.g = p.g AND t.level = p.step AND t.i // 3 = p.at // 3 GROUP BY p.g, p.i, p.step),
up AS (SELECT p.g, p.step, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < p.at), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > p.at), '') AS r
  FROM (SELECT s.g, lv.level AS step, s.i // CAST(pow(3, lv.level) AS BIGINT) AS at FROM subroots s, root, unnest(range(0, root.height)) AS lv(level)) p
  JOIN top t ON t.level = p.step AND t.i // 3 = p.at // 3 GROUP BY p.g, p.step),
ways AS (SELECT g, i, list(struct_pack(l := l, r := r) ORDER BY step) AS path FROM (
  SELECT g, i, step, l, r FROM own UNION ALL SELECT l.g, l.i, 1000 + up.step, up.l, up.r FROM l JOIN up USING (g)) GROUP BY g, i),
out AS (SELECT l.doc_id, l.leaf, s.h AS subroot, root.root, sha256(coalesce(array_to_string([x.l || x.r FOR x IN path], ''), '')) AS proof_sha256,
  list_reduce(coalesce(path, []), lambda a, x: struct_pack(l := sha256(x.l || a.l || x.r), r := ''), struct_pack(l := coalesce(l.changed, l.leaf), r := '')).l AS folded_root
  FROM l JOIN subroots s USING (g) CROSS JOIN root LEFT JOIN ways w ON w.g = l.g AND w.i = l.i)
SELECT *, folded_root = root AS verified FROM out
"""
