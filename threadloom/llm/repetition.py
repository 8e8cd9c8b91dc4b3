"""Quality rules by repetition coverage.

Words are runs of bytes other than space and \\x09-\\x0D. For several n-gram lengths, rolling hashes over a batch of whole
documents find n-grams that occur more than once in a text; the rules measure how many characters of words lie in
repeated occurrences (all but an n-gram's first) and in repeated lines. Equal hashes are compared word by word.

Defined cases: null text has no words; base rules fail it as too short; repeated rows are judged each; extra columns are
left out of the result of ``measure`` and kept by ``keep_good``, whatever their names; an empty table gives an empty one; a
very long text is measured whole by one worker, in memory of some 300 bytes a word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import MULTIPLIERS, arrow_rows, batches, by_place, mix, sliced, split_words, spread

#: n-gram length -> largest share of characters in repeated n-grams (published web-text rules).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"
LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in LONGS) + ", " + ", ".join(f"dup_{k}gram_chars long" for k in NGRAM_LIMITS)


def repeated_windows(ids: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of k ids that occur more than once in their document; and whether each is a later occurrence.

    ids: those of all documents of a batch; counts: ids of each document.
    """
    lasting = np.maximum(counts - k + 1, 0)
    if not lasting.sum():
        return np.empty(0, np.int64), np.empty(0, bool)
    starts = np.repeat(np.r_[0, np.cumsum(counts)[:-1]] - np.r_[0, np.cumsum(lasting)[:-1]], lasting) + np.arange(lasting.sum())
    doc = spread(lasting)
    h = np.zeros(len(ids) - k + 1, np.uint64)
    hashed = mix(ids.astype(np.uint64) + np.uint64(1))
    for j in range(k):
        h += hashed[j : j + len(h)] * MULTIPLIERS[j]
    h = mix(h[starts] + doc.astype(np.uint64) * MULTIPLIERS[k])
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    same = np.flatnonzero(sorted_h[1:] == sorted_h[:-1])
    if not len(same):
        return np.empty(0, np.int64), np.empty(0, bool)
    a, b = starts[order[same]], starts[order[same + 1]]
    if not all((ids[a + j] == ids[b + j]).all() for j in range(k)) or (doc[order[same]] != doc[order[same + 1]]).any():
        # different windows met in one hash: group these by the words themselves
        table = np.column_stack([doc, *(ids[starts + j] for j in range(k))])
        _, inverse = np.unique(table, axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        same = np.flatnonzero(np.diff(inverse.ravel()[order]) == 0)
    hit, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    hit[order[same]] = hit[order[same + 1]] = True
    later[order[same + 1]] = True
    return starts[hit], later[hit]


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge[:-1]) > 0


def measure_texts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    import pyarrow.compute as pc

    symbols, dup_lines, dup_line_chars = [], [], []
    for text in texts:
        text = text or b""
        symbols.append(sum(text.count(c) for c in SYMBOLS))
        seen, n, chars = set(), 0, 0
        if b"\n" in text:
            for line in text.split(b"\n"):
                if line in seen:
                    n += 1
                    chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
                elif line.strip():
                    seen.add(line)
        dup_lines.append(n)
        dup_line_chars.append(chars)
    ids, words, n_words = split_words(texts)
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64)[ids]
    doc, n_docs = spread(n_words), len(texts)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=n_docs).astype(np.int64)
    out = {"n_words": n_words, "word_chars": per_doc(sizes), "n_symbols": np.array(symbols), "n_dup_lines": np.array(dup_lines), "dup_line_chars": np.array(dup_line_chars)}
    for k in NGRAM_LIMITS:
        starts, later = repeated_windows(ids, n_words, k)
        if k == 5:
            out["n_repeat_words"] = per_doc(covered(len(ids), starts, k))
        out[f"dup_{k}gram_chars"] = per_doc(sizes * covered(len(ids), starts[later], k))
    return out


def measure(docs: DataFrame) -> DataFrame:
    """The counts of SCHEMA for each row of docs(doc_id, text)."""

    def run(record_batches):
        import pyarrow as pa

        for part in batches(arrow_rows(record_batches, "doc_id", "text"), lambda r: len(r[1] or b""), 4 << 20):
            found = measure_texts([r[1] for r in part])
            names = ["doc_id", *LONGS, *(f"dup_{k}gram_chars" for k in NGRAM_LIMITS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), *(pa.array(found[n], pa.int64()) for n in names[1:])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def bad_shares(counts, line_limit: float, ngram_limits: dict[int, float]):
    """Whether too much is repeated; counts: name -> column or array."""
    bad = counts("dup_line_chars") > line_limit * counts("word_chars")
    for k, limit in ngram_limits.items():
        bad = bad | (counts(f"dup_{k}gram_chars") > limit * counts("word_chars"))
    return bad


def base_fails(counts):
    return (counts("n_words") < 10) | (100 * counts("n_repeat_words") > 20 * counts("n_words"))


def judged(measured: DataFrame, line_limit: float = LINE_LIMIT, ngram_limits: dict[int, float] = NGRAM_LIMITS) -> DataFrame:
    """Adds base_failed and kept."""
    return measured.withColumn("base_failed", base_fails(F.col)).withColumn("kept", ~F.col("base_failed") & ~bad_shares(F.col, line_limit, ngram_limits))


def keep_good(docs: DataFrame, line_limit: float = LINE_LIMIT, ngram_limits: dict[int, float] = NGRAM_LIMITS) -> DataFrame:
    """The rows of docs that the rules of ``judged`` keep, with all their columns, in one pass."""

    plain, text = by_place(docs), f"c{docs.columns.index('text')}"

    def run(record_batches):
        import pyarrow as pa

        caching = False  # what other operators left is released once a task
        for rb in sliced(record_batches):
            table = pa.Table.from_batches([rb])
            for part in batches(arrow_rows([rb], text), lambda r: len(r[0] or b""), 4 << 20, caching):
                counts = measure_texts([r[0] for r in part]).__getitem__
                bad = base_fails(counts) | bad_shares(counts, line_limit, ngram_limits)
                yield from table.slice(0, len(part)).filter(pa.array(~bad)).to_batches()
                table = table.slice(len(part))
            caching = True

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(measure(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_CHARS = ", ".join(f"CAST(coalesce(sum(chars) FILTER (k = {k} AND later), 0) AS BIGINT) AS dup_{k}gram_chars" for k in NGRAM_LIMITS)
_BAD = " OR ".join(f"dup_{k}gram_chars > {limit} * word_chars" for k, limit in NGRAM_LIMITS.items())
_NGRAMS = ", ".join(f"coalesce(dup_{k}gram_chars, 0) AS dup_{k}gram_chars" for k in NGRAM_LIMITS)

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
per_doc AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM words GROUP BY doc_id),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS BIGINT) AS dup_line_chars FROM lines WHERE nth > 1 GROUP BY doc_id),
win AS (SELECT doc_id, k, t.i, array_to_string(ws[t.i : t.i + k - 1], ' ') AS g FROM (SELECT *, unnest([{", ".join(map(str, NGRAM_LIMITS))}]) AS k FROM w), unnest(range(1, len(ws) - k + 2)) AS t(i)),
rep AS (SELECT doc_id, k, i, row_number() OVER (PARTITION BY doc_id, k, g ORDER BY i) > 1 AS later, count(*) OVER (PARTITION BY doc_id, k, g) AS n FROM win),
cover AS (SELECT doc_id, k, i, bool_or(later) AS later FROM (SELECT doc_id, k, later, unnest(range(i, i + k)) AS i FROM rep WHERE n > 1) GROUP BY doc_id, k, i),
grams AS (SELECT doc_id, count(*) FILTER (k = 5) AS n_repeat_words, {_CHARS} FROM (SELECT cover.*, length(word) AS chars FROM cover JOIN words USING (doc_id, i)) GROUP BY doc_id),
m AS (SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {_NGRAMS}
  FROM w LEFT JOIN per_doc USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN grams USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (dup_line_chars > {LINE_LIMIT} * word_chars OR {_BAD}) AS kept FROM b
"""
