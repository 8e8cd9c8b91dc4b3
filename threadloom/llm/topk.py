"""Exact top-k search by inner product: columnar branch and bound.

Vectors are packed into blocks of columns (one row of the block for each dimension). For a block of queries and a block of
candidates, inner products grow one group of dimensions at a time, the groups of most energy first. After each group, the
norms of what remains of query and candidate bound what a candidate can still reach (Cauchy-Schwarz); candidates under the
query's k-th best so far go, and the survivors are compacted. Query blocks meet candidate blocks by an equi-join on
(query block, candidate group); each side is repeated only for the groups of the other, and each task keeps k per query.

Components are integers floor(64 * x). Defined cases: vectors that are null or hold null or non-finite components take no
part, nor do rows without an id, nor vectors whose inner product with themselves exceeds a long (as scores are longs); missing trailing components count as 0 (an empty vector has the score 0 with all);
repeated rows are candidates each; a query's own id is never its candidate; queries repeated word for word count once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, written

LARGEST = 9.2e18  # of the squared length: all inner products and their parts then fit a long
HITS = "query_id long, query_key long, vec_id long, score long"


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 64))
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(length <= LARGEST)


def packed(vectors: DataFrame, block: str, extra: str = "") -> DataFrame:
    """One row for each block: ids, keys and a dimensions x vectors matrix (integers of ``width`` bytes: 4, or 8 where needed) in vertical layout."""

    def pack(key, table):
        import pyarrow as pa

        ids = table["vec_id"].to_numpy()
        lists = table["v"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        d = int(lengths.max(initial=0))
        values = lists.flatten().to_numpy()
        narrow = -(2**31) < values.min(initial=0) and values.max(initial=0) < 2**31
        m = np.zeros((len(ids), d), np.int32 if narrow else np.int64)
        m[np.repeat(np.arange(len(ids)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
        order = np.argsort(ids, kind="stable")
        return pa.table({block: pa.array([key[0].as_py()], pa.int32()), "ids": [ids[order].astype(np.int64).tobytes()], "keys": [table["key"].to_numpy()[order].astype(np.int64).tobytes()], "m": [np.ascontiguousarray(m[order].T).tobytes()], "width": pa.array([m.itemsize], pa.int32())}, pa.schema([(block, pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("m", pa.binary()), ("width", pa.int32())]))

    return vectors.groupBy(block).applyInArrow(pack, f"{block} int, ids binary, keys binary, m binary, width int")


class BlockSearch:
    """The k best of one block of queries over the candidate blocks given so far."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, q: np.ndarray, k: int, step: int):
        self.ids, self.keys, self.q, self.k, self.step = ids, keys, q, k, step
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        d = max(len(c), self.q.shape[1])
        c = np.vstack([c, np.zeros((d - len(c), c.shape[1]), c.dtype)])
        q = np.hstack([self.q, np.zeros((len(self.q), d - self.q.shape[1]), self.q.dtype)])
        exact = d * float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**52  # else sums of longs
        kind = np.float64 if exact else np.int64
        order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        c, q = c[order].astype(kind), q[:, order].astype(kind)
        cuts = list(range(0, d, self.step)) or [0]
        rest = lambda x: [np.sqrt((x[..., a + self.step :].astype(np.float64) ** 2).sum(axis=-1)) for a in cuts]
        rest_q, rest_c = rest(q), rest(np.ascontiguousarray(c.T))
        for lo in range(0, len(q), 128):
            # the first group of dimensions for many queries at once
            first = q[lo : lo + 128, : self.step] @ c[: self.step]
            for i in range(lo, min(lo + 128, len(q))):
                self._search(i, ids, c, q[i], first[i - lo], cuts, rest_q, rest_c)

    def _search(self, i, ids, c, q, score, cuts, rest_q, rest_c) -> None:
        had_ids, had = self.best[i]
        least = had[-1] if len(had) == self.k else None
        alive = None  # all
        own = np.flatnonzero(ids == self.ids[i])
        if len(own):  # rows of the query's id are no candidates, so they set no bound either
            alive = np.delete(np.arange(len(ids)), own)
            score = score[alive]
        for g, a in enumerate(cuts):
            if g:
                rows = c[a : a + self.step]
                score = score + q[a : a + self.step] @ (rows if alive is None else rows[:, alive])
            if g == len(cuts) - 1:
                break
            bound = rest_q[g][i] * (rest_c[g] if alive is None else rest_c[g][alive])
            slack = 1e-6 * (1.0 + np.abs(bound))  # the norms are rounded, scores aren't
            if score.dtype == np.int64:  # but they are when bounds are added
                slack += 1e-14 * np.abs(score)
            low = least
            if len(score) > self.k:  # k candidates reach at least this much
                sure = np.partition(score - bound - slack, -self.k)[-self.k]
                low = sure if low is None else max(low, sure)
            if low is not None:
                keep = np.flatnonzero(score + bound + slack >= low)
                if len(keep) < 0.8 * len(score):
                    score, alive = score[keep], keep if alive is None else alive[keep]
        found = ids if alive is None else ids[alive]
        found, score = np.concatenate([had_ids, found]), np.concatenate([had, score.astype(np.int64)])
        if len(score) > 4 * self.k:
            keep = np.flatnonzero(score >= np.partition(score, -self.k)[-self.k])
            found, score = found[keep], score[keep]
        top = np.lexsort((found, -score))[: self.k]
        self.best[i] = found[top], score[top]

    def rows(self):
        import pyarrow as pa

        n = [len(x) for x, _ in self.best]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.repeat(self.keys, n)), pa.array(np.concatenate([x for x, _ in self.best])), pa.array(np.concatenate([s for _, s in self.best]).astype(np.int64))], names=["query_id", "query_key", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, is_query, k: int = 20, query_block: int = 1024, block: int = 4096, step: int = 8) -> DataFrame:
    """The k best candidates of every query: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    vectors: see integer_vectors; is_query: a column that picks the queries.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.withColumn("key", F.xxhash64("vec_id", "v")), "topk-vectors")
    queries = vectors.where(is_query).dropDuplicates(["vec_id", "key"])
    n_q, n_c = queries.count(), vectors.count()
    q_blocks, c_blocks = max(1, -(-n_q // query_block)), max(1, -(-n_c // block))
    groups = max(1, min(c_blocks, -(-2 * shuffle_partitions(spark) // q_blocks)))
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", "key", F.monotonically_increasing_id() if salt else F.lit(3)), F.lit(n)).cast("int")
    qs = packed(queries.withColumn("qb", part(q_blocks, False)), "qb").withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # equal rows are spread too, so that no block is made of one vector alone
    cs = packed(vectors.withColumn("cb", part(c_blocks, True)), "cb").select(F.pmod("cb", F.lit(groups)).cast("int").alias("cg"), F.col("ids").alias("c_ids"), F.col("m").alias("c"), F.col("width").alias("c_width"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def search(record_batches):
        at, state = None, None
        for rb in record_batches:
            cols = {n: rb.column(n) for n in ("qb", "cg", "ids", "keys", "m", "width", "c_ids", "c", "c_width")}
            for r in range(rb.num_rows):
                here = cols["qb"][r].as_py(), cols["cg"][r].as_py()
                if here != at:
                    if state is not None:
                        yield state.rows()
                    ids, keys = (np.frombuffer(cols[n][r].as_py(), np.int64) for n in ("ids", "keys"))
                    m = np.frombuffer(cols["m"][r].as_py(), f"i{cols['width'][r].as_py()}")
                    at, state = here, BlockSearch(ids, keys, m.reshape(-1, len(ids)).T, k, step)
                ids = np.frombuffer(cols["c_ids"][r].as_py(), np.int64)
                state.add(ids, np.frombuffer(cols["c"][r].as_py(), f"i{cols['c_width'][r].as_py()}").reshape(-1, len(ids)))
        if state is not None:
            yield state.rows()

    hits = cs.join(qs, ["qb", "cg"]).select("qb", "cg", "ids", "keys", "m", "width", "c_ids", "c", "c_width").mapInArrow(search, HITS)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_columnar_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_top_k(vectors, F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT r, vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
queries AS (SELECT min(r) AS r, vec_id FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, e),
dots AS (
  SELECT q.r AS qr, c.r AS cr, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM queries JOIN parts q USING (r) JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  GROUP BY ALL),
scores AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(score, 0) AS score
  FROM queries q JOIN v c ON q.vec_id <> c.vec_id LEFT JOIN dots ON dots.qr = q.r AND dots.cr = c.r),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
