"""Best-fit packing by exact-complement hashing.

Lengths are at most the capacity, so their histogram is a table of fixed size. The packing is planned on it: hashes of the
sums of one, two and three available lengths give combinations that fill the gap beside a length exactly; they are
consumed as often as the available counts allow; what stays is placed by best fit. The plan says how often each
combination of lengths occurs. Pieces then get their place by their rank among the pieces of the same length, which Spark
counts in salted buckets, so neither pieces nor a hot length meet in one task or on the driver.

Defined cases: null text counts as empty (one end id); repeated rows are packed as separate pieces; an empty table gives an
empty result; a longer document is cut into pieces of the capacity, the first of which may be shorter; a very long text is
held by one worker with its ids; ties of length go by doc_id, piece and start; other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import arrow_rows, batches, release, shuffle_partitions, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of text that are encoded at a time; the encoder's arrays take about twenty times as much.
PART_BYTES = 1 << 20


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), covering exactly the given counts.

    Short pieces in exact fills spare gaps now and are missing for gaps later, which tells where pieces are few. So plans
    are made that leave parts below several lengths to the best fit; the one with the fewest sequences is returned, among
    equal ones that with most exact fills.

    >>> plan_packing({6: 2, 4: 1, 3: 1, 1: 1}, 10)
    [((6, 4), 1), ((6, 3, 1), 1)]
    """
    if any(n > capacity or n < 1 for n, c in counts.items() if c):
        raise ValueError("a length is not between 1 and the capacity")
    plans = [_plan(counts, capacity, least) for least in sorted({max(1, capacity * i // 32) for i in range(17)})]
    return min(plans, key=lambda p: (sum(times for _, times in p[0]), -p[1]))[0]


def _plan(counts: dict[int, int], capacity: int, least: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """A plan and how many of its sequences are exact fills; parts below least fill no gap together with others.

    The sums of one, then two, then three available lengths are looked up for the gap beside each length, longest first.
    Of equal sums that with the longest smaller parts is taken, as short parts fit everywhere.
    """
    left = {n: c for n, c in counts.items() if c}
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(*combination: int) -> None:
        times = min(left[n] // combination.count(n) for n in combination)
        if times:
            plan.append((combination, times))
            for n in combination:
                left[n] -= times

    def lengths(low: int = 1) -> list[int]:
        return sorted((n for n, c in left.items() if c and n >= low), reverse=True)

    for n in lengths():  # sums of one length: the counts are their index
        if n == capacity:
            take(n)
        elif left[n] and n >= capacity - n and left.get(capacity - n):
            take(n, capacity - n)
    pairs = _pair_sums(lengths(least), capacity)
    for n in lengths():
        for a, b in pairs.get(capacity - n, ()):
            if not left[n]:
                break
            if a <= n and left[a] and left[b]:
                take(n, a, b)
    pairs = _pair_sums(lengths(least), capacity)
    for n in lengths():  # sums of three: those of two and one more
        for c in reversed(lengths(least)):
            if not left[n] or 3 * c > capacity - n:
                break
            for a, b in pairs.get(capacity - n - c, ()):
                if not left[n] or not left[c]:
                    break
                if b >= c and a <= n and left[a] and left[b]:
                    take(n, a, b, c)
    exact = sum(times for _, times in plan)
    return plan + _best_fit(left, lengths(), capacity), exact


def _pair_sums(lengths: list[int], capacity: int) -> dict[int, list[tuple[int, int]]]:
    """Sum -> pairs of available lengths with it, most alike first. A pair may be one length twice."""
    sums: dict[int, list[tuple[int, int]]] = {}
    for i, a in enumerate(reversed(lengths)):  # ascending, so that later pairs of a sum are less alike
        for b in lengths[len(lengths) - 1 - i :]:
            if a + b < capacity:
                sums.setdefault(a + b, []).append((a, b))
    return sums


def _best_fit(left: dict[int, int], order: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on counts: sequences of equal content are handled together."""
    gaps: list[int] = []  # of open sequences, ascending
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if times:
            if gap not in opened:
                opened[gap] = []
                insort(gaps, gap)
            opened[gap].append((lengths, times))

    for n in order:
        while left[n]:
            i = bisect_left(gaps, n)
            if i < len(gaps):
                gap = gaps[i]
                lengths, times = opened[gap].pop()
                if not opened[gap]:
                    del opened[gap], gaps[i]
            else:
                gap, lengths, times = capacity, (), left[n]
            # as many of this length to each sequence as fit, then one sequence with what is left over
            each = min(gap // n, max(1, left[n] // times))
            if not lengths:
                each = min(capacity // n, left[n])
                times = left[n] // each
            used = min(times, left[n] // each)
            put(gap - each * n, lengths + (n,) * each, used)
            if lengths:
                put(gap, lengths, times - used)
            left[n] -= each * used
    return [x for xs in opened.values() for x in xs]


def cut_texts(record_batches, tokenizer: str, mode: str, end_id: int, capacity: int):
    """Record batches of PIECES, each of about PART_BYTES of text."""
    import pyarrow as pa

    release(caches=False)  # what other stages left in the process; the encoder's cache stays
    for part in batches(arrow_rows(record_batches, "doc_id", "text"), lambda r: len(r[1] or b""), PART_BYTES, caching=True):
        encode = encoder(tokenizer, mode)
        out: list[tuple] = []
        for (doc_id, _), ids in zip(part, encode([r[1] for r in part]), strict=True):
            ids = np.concatenate([ids.astype("<u4"), np.array([end_id], "<u4")])
            start, piece = 0, 0
            while start < len(ids):
                n = (len(ids) - start) % capacity or capacity
                out.append((doc_id, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                start, piece = start + n, piece + 1
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer: str, mode: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most capacity ids of docs(doc_id, text): PIECES. The first piece of a long document may be shorter."""

    def cut(record_batches):
        return cut_texts(record_batches, tokenizer, mode, end_id, capacity)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a table with a length column) and sequence_id, offset: gapless from 0 within each sequence.

    The driver sees at most capacity counts. Ranks: random buckets, kept in the written table, spread a hot length and
    repeated rows; buckets are counted first.
    """
    spark = pieces.sparkSession
    buckets = max(64, 4 * shuffle_partitions(spark))
    key = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    salted = written(pieces.withColumn("_bucket", F.floor(F.rand() * buckets).cast("int")), "token-pieces")
    by_bucket = salted.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    counts = {int(r[0]): int(r[1]) for r in salted.groupBy("length").count().collect()}  # at most capacity rows
    slots, sequence = [], 0
    used: dict[int, int] = {}
    for lengths, times in plan_packing(counts, capacity):
        offset = 0
        for n, k in _runs(lengths):
            # k places of one length in each of these sequences: ranks used[n] ... used[n] + k * times - 1
            first = used.get(n, 0)
            slots.append((n, first, k, sequence, offset))
            used[n] = first + k * times
            offset += n * k
        sequence += times
    # the plan has a bounded number of rows: a few for each of at most capacity lengths
    plan = spark.sparkContext.broadcast(np.array(sorted(slots), np.int64).reshape(-1, 5))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*key)) - 1).join(base, ["length", "_bucket"]).select(*pieces.columns, (F.col("_rank") + F.col("_base")).alias("_rank"))

    names = pieces.columns

    def place(record_batches):
        import pyarrow as pa

        lengths, firsts, each, sequences, offsets = plan.value.T
        begins = np.searchsorted(lengths, np.arange(capacity + 2))
        for rb in record_batches:
            n, rank = (rb.column(rb.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            slot = np.empty(len(n), np.int64)
            for one in np.unique(n).tolist():
                mine = n == one
                slot[mine] = begins[one] + np.searchsorted(firsts[begins[one] : begins[one + 1]], rank[mine], "right") - 1
            nth = rank - firsts[slot]
            cols = [rb.column(rb.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequences[slot] + nth // each[slot]), pa.array(offsets[slot] + nth % each[slot] * n)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def _runs(lengths: tuple[int, ...]):
    """(6, 6, 3) -> (6, 2), (3, 1)"""
    out: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        if out and out[-1][0] == n:
            out[-1][1] += 1
        else:
            out.append([n, 1])
    return out


def pack_documents(docs: DataFrame, tokenizer: str, mode: str = "whole", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    return pack_pieces(token_pieces(docs, tokenizer, mode, end_id, capacity), capacity)


def op10_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by byte_bpe_50k in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), "spaces")
