"""Helpers of the training-data operators: the shared folder, written tables, words and text hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, written  # noqa: F401  the operators take written from here

#: Odd 64-bit multipliers of the rolling hash, one for each place in a window.
MULTIPLIERS = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front where a table has a column of that name."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def by_place(df: DataFrame) -> DataFrame:
    """df with columns named c0, c1, ... by their places; mapInArrow takes no names with dots, nor two alike."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Caches that operators keep in a worker process, with cache_info and cache_clear.
CACHES: list = []


def release(caches: bool = True) -> None:
    """Gives memory back to the system: caches of other operators' earlier tasks, if asked for, and what the allocators hold unused."""
    import ctypes

    import pyarrow as pa

    for c in CACHES if caches else ():
        c.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def split_words(texts: list[bytes | None]):
    """Words of all texts (runs of bytes other than space and \\x09-\\x0D; null: none), without an object for each.

    (number of each word in the dictionary, the distinct words as an Arrow array, number of words of each text)
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string()))
    words, ends = lists.values, lists.offsets.to_numpy()
    filled = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty string
    before = np.r_[0, np.cumsum(filled)]
    coded = words.filter(pa.array(filled)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.diff(before[ends])


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, which depends on the word alone; and the number of words of each text."""
    import pyarrow as pa
    import xxhash

    number, words, counts = split_words(texts)
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words.view(pa.large_binary()).to_pylist()], np.uint64)[number], counts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that any bits of the result can pick a slot."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(ids: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every window of k successive words: a sum of products by odd constants modulo 2**64, mixed."""
    m = len(ids) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = ids[:m] * MULTIPLIERS[salt]
    for j in range(1, k):
        out += ids[j : j + m] * MULTIPLIERS[salt + j]
    return mix(out)


def spread(counts: np.ndarray) -> np.ndarray:
    """[2, 0, 3] -> [0, 0, 2, 2, 2]: the number of the part that each item belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


def batches(rows, size_of, limit: int, caching: bool = False):
    """Lists of successive rows with a total size of about limit; a single row may be larger.

    Before the first, a task that isn't caching itself releases what others left in the process.
    """
    if not caching:
        release()
    held, total = [], 0
    for row in rows:
        n = size_of(row)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held


def sliced(record_batches, rows: int = 1024):
    """The record batches in parts of at most so many rows, so that few of their texts exist twice at a time."""
    for rb in record_batches:
        for at in range(0, rb.num_rows, rows):
            yield rb.slice(at, rows)


def arrow_rows(record_batches, *names: str):
    """Tuples of the named columns; strings arrive as bytes, so words can be cut without decoding."""
    import pyarrow as pa

    for rb in sliced(record_batches):
        cols = []
        for n in names:
            c = rb.column(rb.schema.get_field_index(n))
            cols.append((c.cast(pa.large_binary()) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c).to_pylist())
        yield from zip(*cols, strict=True)


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """df with running sums: for each (name, column) in sums, name = the column's sum over the rows of the group that go before,
    and name_all = its sum over the whole group; the column "1" counts rows.

    Rows are dealt by ranges of group and order, so that a group may fill any number of tasks; a window then spans what one
    task holds of a group, and sums of tasks bring in the rest. Rows alike in group and order go in any order.
    """
    part, at = fresh(df.columns, "_part", "_at")
    value = lambda c: F.lit(1) if c == "1" else F.col(c)
    dealt = written(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), name)
    tasks = dealt.groupBy(part, *group).agg(*(F.sum(value(c)).alias(n) for n, c in sums.items()))
    whole, ahead = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(F.col(part).alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_before_{n}") for n in sums), *(F.sum(n).over(whole).alias(f"{n}_all") for n in sums))
    within = Window.partitionBy(part, *group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("*", *(F.coalesce(F.sum(value(c)).over(within), F.lit(0)).alias(f"_within_{n}") for n, c in sums.items()))
    same = F.col(part) == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return dealt.join(tasks, same).select(*named(df.columns), *((F.col(f"_before_{n}") + F.col(f"_within_{n}")).alias(n) for n in sums), *(F.col(f"{n}_all") for n in sums))
