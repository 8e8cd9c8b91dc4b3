"""Substring deduplication with a count-min prefilter.

A window is k successive words of one document. A word goes if a window over it also starts in a document of smaller
doc_id. Three passes over the texts:

1. Each partition counts its windows in sketch rows. A window is counted under its minimizer, the least hash among its
   ``gram``-word parts, so neighbouring windows share an entry and a count can be too high but never too low. The cells
   of all partitions are merged by Spark, slice by slice; of the merged sketch one bit a cell (count >= 2) is broadcast:
   depth * 2**width_bits / 8 bytes, whatever the size of the input.
2. Only windows with all bits set go on. In a batch the least doc_id of a window is known at once; later documents'
   windows are decided there, and one entry for the least document goes to the exact grouping by window hash. So a
   window in a third of all documents sends one entry a batch.
3. The decided positions join their document's text.

Windows are told apart by 128 bits of hashes, built from 64-bit hashes of whole words. Groups are as many as the input is
large, so that one worker holds a bounded part of the hashes and answers.

Defined cases: null text has no words; a null doc_id counts as greater than any other; equal doc_ids never remove each
other's words; repeated rows get equal results; an empty table gives an empty one; a very long text is worked on whole by
one worker; other columns stay as they are, whatever their names, but for those that the report replaces.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import MULTIPLIERS, arrow_rows, batches, by_place, fresh, hashed_words, mix, named, shuffle_partitions, sliced, spread, windows
from .sketch import may_hold, merged_sketch

NO_ID = 2**63 - 1
#: Columns that remove_repeats adds.
REPORT = ("n_words", "n_removed", "kept_sha256")
#: Bytes of text for each group of windows.
GROUP_BYTES = 32 << 20


class BatchWindows:
    """Windows of a batch of whole texts: start (place in the batch's words), document, and minimizer of each."""

    def __init__(self, texts: list[bytes | None], k: int, gram: int):
        self.ids, counts = hashed_words(texts)
        self.first = np.cumsum(counts) - counts
        n = np.maximum(counts - k + 1, 0)
        self.doc = spread(n)
        self.start = np.repeat(self.first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if n.sum() else np.empty(0, np.int64)
        self.position = self.start - self.first[self.doc]
        grams = windows(self.ids, gram, salt=32)
        span = k - gram + 1
        least = grams[: max(len(grams) - span + 1, 0)].copy()
        for j in range(1, span):
            np.minimum(least, grams[j : j + len(least)], out=least)
        self.minimizer = least[self.start] if len(self.start) else np.empty(0, np.uint64)
        self.k = k

    def hashes(self, chosen: np.ndarray) -> np.ndarray:
        """Two hashes of each chosen window, as columns."""
        at = self.start[chosen]
        out = np.zeros((len(at), 2), np.uint64)
        for j in range(self.k):
            ids = self.ids[at + j]
            out[:, 0] += ids * MULTIPLIERS[j]
            out[:, 1] += ids * MULTIPLIERS[63 - j]
        return mix(out)

    def anchors(self) -> np.ndarray:
        """Minimizers, one for each run of windows of a document that share it."""
        if not len(self.minimizer):
            return self.minimizer
        new = np.r_[True, (self.minimizer[1:] != self.minimizer[:-1]) | (self.doc[1:] != self.doc[:-1])]
        return self.minimizer[new]


def count_min(docs: DataFrame, k: int, gram: int, depth: int, width_bits: int):
    """The merged sketch of all windows' minimizers: whether each cell counts 2 or more."""

    def anchors(record_batches):
        for part in batches(arrow_rows(record_batches, "text"), lambda r: len(r[0] or b""), 4 << 20):
            yield BatchWindows([r[0] for r in part], k, gram).anchors()

    return merged_sketch(docs.select("text"), anchors, depth, width_bits)


def heads(h: np.ndarray) -> np.ndarray:
    """Where another window begins in sorted rows of hashes."""
    return np.r_[True, (h[1:] != h[:-1]).any(axis=1)][: len(h)]


def bits_of(positions: np.ndarray) -> bytes:
    """Ascending positions as steps, which compress well."""
    return np.diff(positions, prepend=np.uint32(0)).astype(np.uint32).tobytes()


def repeated_positions(docs: DataFrame, k: int, gram: int, sketch, width_bits: int) -> DataFrame:
    """(_id, _key, _at): starts of the document's windows that also start in a document of smaller _id, exactly."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-size // GROUP_BYTES))
    schema = "part int, hashes binary, docs binary, counts binary, positions binary"

    def packed(to, doc, positions, hashes, ids, keys):
        """Rows of the schema by part, sorted by document and place."""
        order = np.lexsort((positions, doc, to))
        to, doc, positions = to[order], doc[order], positions[order]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ds, counts = np.unique(doc[a:b], return_counts=True)
            # what is decided already needs no hash and goes to any part
            open_ = hashes is not None and to[a] >= 0
            p = int(to[a]) if to[a] >= 0 else int(ids[ds[0]] % n)
            yield p, hashes[order[a:b]].tobytes() if open_ else b"", np.stack([ids[ds], keys[ds]]).tobytes(), counts.astype(np.uint32).tobytes(), bits_of(positions[a:b])

    def batch_of(rows):
        import pyarrow as pa

        cols = list(zip(*rows, strict=True)) or [()] * 5
        return [pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(cols)], ["part", "hashes", "docs", "counts", "positions"]

    def find(record_batches):
        import pyarrow as pa

        bits = sketch.value
        for part in batches(arrow_rows(record_batches, "_id", "_key", "text"), lambda r: len(r[2] or b""), 4 << 20):
            part.sort(key=lambda r: r[0])
            w = BatchWindows([r[2] for r in part], k, gram)
            chosen = np.flatnonzero(may_hold(bits, w.minimizer, width_bits))
            if not len(chosen):
                continue
            h, doc, position = w.hashes(chosen), w.doc[chosen], w.position[chosen].astype(np.uint32)
            row_id, row_key = (np.array([r[i] for r in part], np.int64) for i in (0, 1))
            order = np.lexsort((doc, h[:, 1], h[:, 0]))
            sid, head = row_id[doc[order]], heads(h[order])
            here = np.zeros(len(h), bool)
            here[order] = sid > sid[np.flatnonzero(head)][np.cumsum(head) - 1]
            to = np.where(here, -1, (h[:, 0] % np.uint64(n)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(*batch_of(packed(to, doc, position, h, row_id, row_key)))

    def unpack(table):
        """Documents (ids, keys), the document of each position, the positions, whether each is open, and the hashes of these."""
        docs, doc, positions, open_, hashes, at = [], [], [], [], [], 0
        for h, d, c, p in zip(*(table[x].to_pylist() for x in ("hashes", "docs", "counts", "positions")), strict=True):
            docs.append(np.frombuffer(d, np.int64).reshape(2, -1))
            doc.append(spread(np.frombuffer(c, np.uint32)) + at)
            positions.append(np.cumsum(np.frombuffer(p, np.uint32), dtype=np.uint32))
            open_.append(np.full(len(positions[-1]), bool(h)))
            hashes.append(np.frombuffer(h, np.uint64).reshape(-1, 2))
            at += docs[-1].shape[1]
        return np.concatenate(docs, axis=1), np.concatenate(doc), np.concatenate(positions), np.concatenate(open_), np.concatenate(hashes)

    def decide(table):
        """Exact groups by window. What is decided goes on by buckets of documents, packed."""
        import pyarrow as pa

        (ids, keys), doc, positions, open_, h = unpack(table)
        at = np.flatnonzero(open_)
        order = np.lexsort((ids[doc[at]], h[:, 1], h[:, 0]))
        sid, head = ids[doc[at[order]]], heads(h[order])
        least = sid[np.flatnonzero(head)][np.cumsum(head) - 1]
        gone = np.r_[np.flatnonzero(~open_), at[order[sid > least]]]
        doc, positions = doc[gone], positions[gone]
        to = (mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)[doc]
        arrays, names = batch_of(packed(to, doc, positions, None, ids, keys))
        return pa.table(arrays, names=names)

    def gather(table):
        """One row for each document of a bucket."""
        import pyarrow as pa

        (ids, keys), doc, positions, _, _ = unpack(table)
        order = np.lexsort((keys[doc], ids[doc]))
        i, k, positions = ids[doc[order]], keys[doc[order]], positions[order]
        cuts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1]), True]) if len(i) else np.zeros(1, np.int64)
        return pa.table({"_id": pa.array(i[cuts[:-1]]), "_key": pa.array(k[cuts[:-1]]), "_at": pa.array([positions[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    found = docs.select("_id", "_key", "text").mapInArrow(find, schema)
    return found.groupBy("part").applyInArrow(decide, schema).groupBy("part").applyInArrow(gather, "_id long, _key long, _at binary")


def remove_repeats(docs: DataFrame, k: int = 13, gram: int = 5, depth: int = 2, width_bits: int = 27, report: tuple[str, ...] = REPORT) -> DataFrame:
    """docs(doc_id, text, ...) with text replaced by the kept words, joined by one space, where any word goes.

    Adds the columns that report names: number of words and of removed words (long), sha256 of the kept words joined by one space.
    """
    taken = {c.lower() for c in report}
    kept = [c for c in docs.columns if c.lower() not in taken]
    id_, key, at_ = fresh(docs.columns, "_id", "_key", "_at")
    keyed = docs.select(*named(kept), F.coalesce("doc_id", F.lit(NO_ID)).alias(id_), F.xxhash64("text").alias(key))
    sketch = count_min(docs, k, gram, depth, width_bits)
    at = repeated_positions(keyed.select(F.col(id_).alias("_id"), F.col(key).alias("_key"), "text"), k, gram, sketch, width_bits).toDF(id_, key, at_)
    kinds = (LongType(), LongType(), StringType())
    rows = by_place(keyed.join(at, [id_, key], "left").select(*named([*kept, at_])))
    text_at, at_at = f"c{kept.index('text')}", f"c{len(kept)}"
    schema = StructType([*rows.schema.fields[:-1], *(StructField(f"r{i}", t) for i, t in enumerate(kinds))])

    def cut(record_batches):
        import pyarrow as pa

        for rb in sliced(record_batches):
            texts, n_words, n_removed, digests = [], [], [], []
            for text, at in arrow_rows([rb], text_at, at_at):
                words = (text or b"").split()
                n_words.append(len(words))
                if at:
                    gone = np.zeros(len(words) + 1, np.int32)
                    starts = np.frombuffer(at, np.uint32).astype(np.int64)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, np.minimum(starts + k, len(words)), -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    text = b" ".join(words)
                    n_removed.append(int(gone.sum()))
                else:
                    n_removed.append(0)
                texts.append(text)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            cols = [pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts], pa.string()) if i == kept.index("text") else rb.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=[f.name for f in schema])

    return rows.mapInArrow(cut, schema).toDF(*kept, *report)


def op6_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, t.i, array_to_string(ws[t.i : t.i + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
least AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN least USING (g) WHERE d < doc_id),
kept AS (SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (g.i IS NULL) AS t FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
