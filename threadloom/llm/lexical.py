"""Ranked lexical search over a forward index with block maxima.

Indexing cuts the documents, as they are read, into blocks of successive ones, a row each. A block has its own dictionary of
terms, for each term the number of its documents and its best pairs (frequency, length) of which no other is at least as good
in both, and, in further columns, the terms and frequencies of every document: the forward index. As Parquet, the light columns are read
without the forward ones. A term's part of a score grows with its frequency and falls with the document's length, so
the pairs give the exact maximum of a block for whatever the corpus adds up to.

A search (1) sums the frequencies of the query terms over the light columns, (2) takes each query's blocks with the greatest
bounds, the sum of the maxima of its terms, (3) scores their documents, which gives each query a threshold, and (4) scores,
of all other blocks, those whose bound reaches the threshold of a query, for these queries alone. A document scoring as
much as the last of the best can still go before it by its id, so only a bound below the threshold drops a block.
In a task thresholds rise as blocks are scored.

Queries are packed into groups of at most ``group_items`` items and about ``group_bytes`` of text (a longer item is a group of its own) and sent to
the tasks, group by group. A task sends on at most k rows of each query, and, in step 2, ``first`` blocks.

Defined cases: null and empty texts, and texts without terms, are not in the index and not counted; items without terms get
no rows; repeated rows of documents are documents each, repeated rows of items count once; a document with a null id goes
after all others at ties (the greatest long stands for null); an empty table gives an empty one; columns that aren't asked for are left out,
whatever their names; a very long text is a block of its own, held by one worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_rows, batches, release, split_words, spread, written

NO_ID = 2**63 - 1
#: Bytes of a text to those of its terms: A-Z lower-cased, other ASCII than letters and digits to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LIGHT = "block long, n_docs long, n_terms long, terms binary, df binary, best_counts binary, best_tf binary, best_n binary"
FORWARD = "ids binary, lengths binary, doc_terms binary, term_at binary, tf binary"
#: Blocks are wide, so few go in a row group: writers and readers hold a row group at a time. No two alike need a dictionary.
WIDE_ROWS = {"parquet.block.row.count.limit": 16, "parquet.enable.dictionary": False}


def packed(a: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes each that hold them all, after a byte that tells how many."""
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype("u1")
    return bytes([kind.itemsize]) + a.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def packed_block(block: int, docs: list[tuple[int | None, bytes]]) -> tuple | None:
    """A row of LIGHT and FORWARD for documents (id, folded text)."""
    number, words, counts = split_words([t for _, t in docs])
    has = counts > 0
    if not has.any():
        return None
    ids = np.array([NO_ID if i is None else i for i, _ in docs], np.int64)[has]
    lengths = counts[has]
    pairs, tf = np.unique(spread(lengths) * len(words) + number, return_counts=True)
    doc, term = pairs // len(words), pairs % len(words)
    n = lengths[doc]
    order = np.lexsort((-tf, n, term))
    # of a term's documents, shortest first, those with a greater frequency than all before
    top = (term[order].astype(np.uint64) << np.uint64(40)) | tf[order].astype(np.uint64)
    best = order[np.r_[True, top[1:] > np.maximum.accumulate(top)[:-1]]]
    light = (block, int(has.sum()), int(lengths.sum()), b" ".join(w for w in words.cast("large_binary").to_pylist()), packed(np.bincount(term, minlength=len(words))), packed(np.bincount(term[best], minlength=len(words))), packed(tf[best]), packed(n[best]))
    return (*light, ids.tobytes(), packed(lengths), packed(np.bincount(doc)), packed(term), packed(tf))


def index_documents(docs: DataFrame, block_docs: int = 128, block_bytes: int = 1 << 20) -> DataFrame:
    """The index of docs(doc_id, text), written: a row of LIGHT and FORWARD for each block."""

    def run(record_batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        names, kinds = zip(*(c.split() for c in f"{LIGHT}, {FORWARD}".split(", ")), strict=True)
        types = [pa.int64() if k == "long" else pa.binary() for k in kinds]
        rows = ((i, (t or b"").translate(FOLD)) for i, t in arrow_rows(record_batches, "doc_id", "text"))
        for part in batches(rows, lambda r: max(len(r[1]), block_bytes // block_docs), block_bytes):
            if row := packed_block(block, part):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=list(names))
            block += 1

    return written(docs.select("doc_id", "text").mapInArrow(run, f"{LIGHT}, {FORWARD}"), "lexical-index", **WIDE_ROWS)


@dataclass
class Queries:
    """A group of items: their ids, all distinct terms, and of each item the terms (numbers) and their repeats, in a row."""

    ids: list
    terms: list[bytes]
    offsets: np.ndarray
    term: np.ndarray
    repeats: np.ndarray
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    @classmethod
    def of(cls, items: list[tuple[int | None, bytes]]) -> Queries | None:
        number, words, counts = split_words([t for _, t in items])
        has = counts > 0
        if not has.any():
            return None
        pairs, repeats = np.unique(spread(counts[has]) * len(words) + number, return_counts=True)
        offsets = np.r_[0, np.cumsum(np.bincount(pairs // len(words)))]
        return cls([i for (i, _), h in zip(items, has, strict=True) if h], words.cast("large_binary").to_pylist(), offsets, pairs % len(words), repeats)

    def weigh(self, df: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def parts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term adds to a score for each of its weight."""
        m = 75 + (25 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    def bounds(self, known: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of each item; most: the greatest part of each of the known terms in a block."""
        part = np.zeros(len(self.terms), np.int64)
        part[known] = most
        return np.add.reduceat(self.repeats * (self.weights * part)[self.term], self.offsets[:-1])


class Block:
    """A row of the index, read for a group of queries."""

    def __init__(self, row: dict, q: Queries, here: np.ndarray):
        self.row, self.q = row, q
        self.at = np.flatnonzero(here >= 0)
        self.known = here[self.at]

    def df(self) -> np.ndarray:
        return unpacked(self.row["df"])[self.at]

    def bounds(self) -> np.ndarray:
        counts = unpacked(self.row["best_counts"])
        parts = self.q.parts(unpacked(self.row["best_tf"]), unpacked(self.row["best_n"]))
        return self.q.bounds(self.known, np.maximum.reduceat(parts, np.r_[0, np.cumsum(counts)[:-1]])[self.at])

    def scores(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents, and their scores: a row for each of the items."""
        q, ids, lengths = self.q, np.frombuffer(self.row["ids"], np.int64), unpacked(self.row["lengths"])
        counts, term = unpacked(self.row["doc_terms"]), unpacked(self.row["term_at"])
        place = np.full(int(term.max()) + 1, -1)
        place[self.at] = np.arange(len(self.at))
        hit = np.flatnonzero(place[term] >= 0)
        doc = spread(counts)[hit]
        part = np.zeros((len(self.at), len(ids)), np.int64)
        part[place[term[hit]], doc] = q.parts(unpacked(self.row["tf"])[hit], lengths[doc])
        local = np.full(len(q.terms), -1)
        local[self.known] = np.arange(len(self.at))
        out = np.zeros((len(items), len(ids)), np.int64)
        for row, item in enumerate(items):
            span = slice(q.offsets[item], q.offsets[item + 1])
            mine = local[q.term[span]]
            there = mine >= 0
            out[row] = (q.repeats[span] * q.weights[q.term[span]])[there] @ part[mine[there]]
        return ids, out


def _read(record_batches, q: Queries, columns: list[str]) -> Iterator[Block]:
    """Blocks, with the numbers of the query terms in their dictionaries."""
    import pyarrow as pa
    import pyarrow.compute as pc

    release()  # what indexing left in the process
    wanted = pa.array(q.terms, pa.large_binary())
    for rb in record_batches:
        for row in pa.Table.from_batches([rb]).select(columns).to_batches(max_chunksize=8):
            rows = row.to_pylist()
            words = [pc.ascii_split_whitespace(pa.array([r["terms"]], pa.large_binary()).view(pa.large_string())).values.view(pa.large_binary()) for r in rows]
            for r, w in zip(rows, words, strict=True):
                yield Block(r, q, pc.fill_null(pc.index_in(w, value_set=wanted), -1).to_numpy(zero_copy_only=False))


_LIGHT = [c.split()[0] for c in LIGHT.split(", ")]
_FORWARD = [c.split()[0] for c in FORWARD.split(", ")]


class Best:
    """The k best (score, id) of each item so far in a task, and the score that the next must reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.held = k, least.copy(), {}

    def add(self, block: Block, items: np.ndarray) -> None:
        ids, scores = block.scores(items)
        for item, row in zip(items.tolist(), scores, strict=True):
            fit = np.flatnonzero((row > 0) & (row >= self.least[item]))
            if not len(fit):
                continue
            s, i = self.held.get(item, (np.empty(0, np.int64), np.empty(0, np.int64)))
            s, i = np.r_[s, row[fit]], np.r_[i, ids[fit]]
            order = np.lexsort((i, -s))[: self.k]
            self.held[item] = s[order], i[order]
            if len(order) == self.k:
                self.least[item] = max(self.least[item], s[order[-1]])

    def batch(self):
        import pyarrow as pa

        items = [item for item, (s, _) in self.held.items() for _ in s]
        s, i = (np.concatenate([x[j] for x in self.held.values()]) if self.held else np.empty(0, np.int64) for j in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])


def _search_group(index: DataFrame, q: Queries, k: int, first: int) -> DataFrame:
    """item (its place in the group), doc_id, score: at least the k best of each item."""
    spark = index.sparkSession

    def sums(record_batches):
        import pyarrow as pa

        df, n_docs, n_terms = np.zeros(len(plain.value.terms), np.int64), 0, 0
        for b in _read(record_batches, plain.value, ["n_docs", "n_terms", "terms", "df"]):
            np.add.at(df, b.known, b.df())
            n_docs, n_terms = n_docs + b.row["n_docs"], n_terms + b.row["n_terms"]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2], pa.int64()), pa.array(np.r_[df[at], n_docs, n_terms], pa.int64())], names=["term", "n"])

    plain = spark.sparkContext.broadcast(q)  # a group of queries, bounded by group_items and group_bytes
    found = dict(index.select("n_docs", "n_terms", "terms", "df").mapInArrow(sums, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row for each query term
    df = np.zeros(len(q.terms), np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    if not found.get(-2):
        return spark.createDataFrame([], "item int, doc_id long, score long")
    q.weigh(df, found[-1], found[-2])
    shared = spark.sparkContext.broadcast(q)

    def greatest(record_batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for b in _read(record_batches, shared.value, _LIGHT):
            bounds = b.bounds()
            for item in np.flatnonzero(bounds > 0).tolist():
                mine = held.setdefault(item, [])
                mine.append((-int(bounds[item]), b.row["block"]))
                if len(mine) >= 4 * first:
                    mine[:] = sorted(mine)[:first]
        rows = [(item, block, -bound) for item, mine in held.items() for bound, block in sorted(mine)[:first]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "block", "bound"])

    tops = index.select(*_LIGHT).mapInArrow(greatest, "item int, block long, bound long")
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))
    tops = tops.withColumn("nth", nth).where(F.col("nth") <= first).collect()  # first rows of each query of the group
    asked: dict[int, list[int]] = {}
    for r in tops:
        asked.setdefault(r.block, []).append(r.item)
    chosen = spark.sparkContext.broadcast({b: np.array(sorted(x)) for b, x in asked.items()})

    def score_chosen(record_batches):
        best = Best(k, np.zeros(len(shared.value.ids), np.int64))
        for b in _read(record_batches, shared.value, ["block", "terms", *_FORWARD]):
            best.add(b, chosen.value[b.row["block"]])
        yield best.batch()

    kind = "item int, doc_id long, score long"
    begun = written(index.where(F.col("block").isin(list(asked))).select("block", "terms", *_FORWARD).mapInArrow(score_chosen, kind), "lexical-first")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    least = np.zeros(len(q.ids), np.int64)
    for item, score in begun.withColumn("nth", rank).where(F.col("nth") == k).select("item", "score").collect():  # a row for each query
        least[item] = score
    floor = spark.sparkContext.broadcast(least)

    def score_rest(record_batches):
        best = Best(k, floor.value)
        none = np.empty(0, np.int64)
        for b in _read(record_batches, shared.value, [*_LIGHT, *_FORWARD]):
            bounds = b.bounds()
            items = np.flatnonzero((bounds > 0) & (bounds >= best.least))
            items = items[~np.isin(items, chosen.value.get(b.row["block"], none))]
            if len(items):
                best.add(b, items)
        yield best.batch()

    return begun.unionByName(written(index.mapInArrow(score_rest, kind), "lexical-rest"))


def query_groups(queries: DataFrame, group_items: int, group_bytes: int) -> Iterator[Queries]:
    """Distinct rows of queries(item_id, text), a group at a time on the driver."""
    items = ((r.item_id, r.text.encode().translate(FOLD)) for r in queries.where("text IS NOT NULL").select("item_id", "text").distinct().toLocalIterator())
    for part in batches(items, lambda r: max(len(r[1]), group_bytes // group_items), group_bytes, caching=True):
        if q := Queries.of(part):
            yield q


def search(index: DataFrame, queries: DataFrame, k: int = 20, first: int = 8, group_items: int = 1024, group_bytes: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of an index for each of queries(item_id, text), scores above 0."""
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")).cast("int")
    out = index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for q in query_groups(queries, group_items, group_bytes):
        names = index.sparkSession.createDataFrame([(n, i) for n, i in enumerate(q.ids)], "item int, item_id long")
        rows = _search_group(index, q, k, first).withColumn("rank", nth).where(F.col("rank") <= k)
        out = out.unionByName(rows.join(names, "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    return out


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS ts FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) FILTER (len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, text, term, count(*) AS k FROM (SELECT item_id, text, unnest({_TERMS.format("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total WHERE term IN (SELECT term FROM q) GROUP BY term, n),
s AS (
  SELECT q.item_id, q.text, d.doc_id, tf.r, CAST(sum(q.k * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * len(d.ts) * total.n) // total.l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
