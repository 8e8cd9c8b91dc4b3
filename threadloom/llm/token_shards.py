"""Token-id shards: blocks of ids transposed into bit or byte planes, each plane compressed by zstandard, with a chunk index.

A shard holds the documents of one range of doc_id in ascending order (null doc_ids first, ties by the text's first 64
characters and then in any order, so that many rows with one doc_id, or none, can go to several shards).
Layout: MAGIC, then for each block its compressed planes one after another, then the footer, then the footer's length
(8 bytes, little-endian) and MAGIC again. Footer (zstandard): a JSON header with width, planes, block size and counts, then
the chunk index (int64: offset of each block and length of each plane) and the document index (doc_id, null flag, ids).

Defined cases: a null or empty text has only the end id; repeated rows are kept; an empty table gives no shards; a very long
text is encoded whole by one worker; other columns are left out, whatever their names.
A task names its file by its attempt, and only the files that the manifest lists count, so lost and repeated tasks do no harm.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import arrow_rows, batches, new_path, shuffle_partitions, written

MAGIC = b"TPLANES1"
MANIFEST = "shard int, file string, n_docs long, n_tokens long, n_bytes long"


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The planes of a block, least significant first: 8 * width bit planes or width byte planes."""
    raw = np.ascontiguousarray(ids, dtype=f"<u{width}").view(np.uint8).reshape(-1, width)
    if not bits:
        return [raw[:, j].tobytes() for j in range(width)]
    return [np.packbits((raw[:, j] >> b) & 1).tobytes() for j in range(width) for b in range(8)]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    raw = np.zeros((n, width), np.uint8)
    for j, plane in enumerate(planes):
        if bits:
            raw[:, j // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (j % 8)
        else:
            raw[:, j] = np.frombuffer(plane, np.uint8)
    return raw.reshape(-1).view(f"<u{width}")


class ShardWriter:
    """Writes one shard as a stream; holds one block of ids and the document index."""

    def __init__(self, out, width: int, bits: bool, block: int, level: int):
        import zstandard

        self.out, self.width, self.bits, self.block = out, width, bits, block
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.chunks, self.n_tokens = [], 0
        self.docs = array("q")  # of each document: doc_id, null flag, ids
        out.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.extend((doc_id or 0, doc_id is None, len(ids)))
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(ids[i : i + self.block])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.compress(p) for p in to_planes(ids, self.width, self.bits)]
        self.chunks.append([self.at, *map(len, planes)])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        head = json.dumps({"width": self.width, "bits": self.bits, "block": self.block, "chunks": len(self.chunks), "docs": len(self.docs) // 3, "tokens": self.n_tokens}).encode()
        docs = np.frombuffer(self.docs, np.int64).reshape(-1, 3).T if self.docs else np.empty((3, 0), np.int64)
        body = struct.pack("<q", len(head)) + head + np.array(self.chunks, "<i8").tobytes() + docs.astype("<i8").tobytes()
        footer = self.compress(body)
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        self.out.close()
        return self.at + len(footer) + 8 + len(MAGIC)


class ShardReader:
    """Reads a shard's indexes first, then its documents as a stream, one block at a time."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompress = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        source.seek(size - len(MAGIC) - 8)
        (n,) = struct.unpack("<q", source.read(8))
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token shard, or one whose writing was cut short")
        source.seek(size - len(MAGIC) - 8 - n)
        body = self.decompress(source.read(n))
        (h,) = struct.unpack("<q", body[:8])
        self.head = json.loads(body[8 : 8 + h])
        planes, chunks, docs = self.head["width"] * (8 if self.head["bits"] else 1), self.head["chunks"], self.head["docs"]
        rest = np.frombuffer(body[8 + h :], "<i8")
        self.chunks = rest[: chunks * (planes + 1)].reshape(chunks, planes + 1)
        self.doc_ids, self.null, self.counts = rest[chunks * (planes + 1) :].reshape(3, docs)

    def chunk(self, k: int) -> np.ndarray:
        at, *lengths = self.chunks[k].tolist()
        self.source.seek(at)
        raw, planes, i = self.source.read(sum(lengths)), [], 0
        for n in lengths:
            planes.append(self.decompress(raw[i : i + n]))
            i += n
        n = min(self.head["block"], self.head["tokens"] - k * self.head["block"])
        return from_planes(planes, n, self.head["width"], self.head["bits"])

    def documents(self):
        """(doc_id, number of ids before it in this shard, list of arrays of ids)"""
        k, left, start = -1, np.empty(0, "<u2"), 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.counts.tolist(), strict=True):
            need, parts = n, []
            while need:
                if not len(left):
                    k += 1
                    left = self.chunk(k)
                parts.append(left[:need])
                left = left[need:]
                need -= len(parts[-1])
            yield (None if null else doc_id), start, parts
            start += n


def opened(uri: str) -> str:
    """The URI by which pyarrow knows a store."""
    return "s3" + uri[3:] if uri.startswith(("s3a:", "s3n:")) else uri


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, mode: str = "whole", end_id: int | None = 2, shards: int | None = None, shard_bytes: int = 1 << 30, bits: bool = False, block: int = 1 << 16, level: int = 3) -> DataFrame:
    """Writes the ids of docs(doc_id, text) to shards under folder (a URI that pyarrow's file systems open; s3a counts as s3).

    Returns the manifest, itself written there: one row per shard, in doc_id order. mode: see encoding.py. shards: as many as
    there are shuffle partitions, or more where one would hold over shard_bytes of text.
    """
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(shuffle_partitions(docs.sparkSession), -(-size // shard_bytes))

    def write(record_batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        rows = arrow_rows(record_batches, "doc_id", "text")
        writer = None
        for part in batches(rows, lambda r: len(r[1] or b""), 8 << 20, caching=True):
            if writer is None:
                encode = encoder(tokenizer, mode)
                width = max(encode.type.itemsize, 4 if (end_id or 0) >= 1 << 16 else 2)
                store, base = pafs.FileSystem.from_uri(opened(folder))
                shard = TaskContext.get().partitionId()
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tpl"
                store.create_dir(base, recursive=True)
                writer = ShardWriter(store.open_output_stream(f"{base}/{name}"), width, bits, block, level)
            tail = [] if end_id is None else [end_id]
            for (doc_id, _), ids in zip(part, encode([r[1] for r in part]), strict=True):
                writer.add(doc_id, np.concatenate([ids, np.array(tail, f"<u{width}")]))
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": f"{folder}/{name}", "n_docs": len(writer.docs) // 3, "n_tokens": writer.n_tokens, "n_bytes": size}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    tie = F.substring("text", 1, 64)
    ranged = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id", tie, F.monotonically_increasing_id()).sortWithinPartitions("doc_id", tie)
    return written(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Reads the shards of a manifest: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32), shard.

    The running sum of n_tokens goes over the manifest, which has one row per shard.
    """

    def read(record_batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        for rb in record_batches:
            for row in rb.to_pylist():
                store, path = pafs.FileSystem.from_uri(opened(row["file"]))
                with store.open_input_file(path) as source:
                    for part in batches(ShardReader(source).documents(), lambda d: 1 + sum(map(len, d[2])), 1 << 20):
                        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                        for doc_id, start, ids in part:
                            crc = 0
                            for x in ids:
                                crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
                            for k, v in zip(out, (doc_id, row["base"] + start, sum(map(len, ids)), crc), strict=True):
                                out[k].append(v)
                        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()} | {"shard": pa.array([row["shard"]] * len(part), pa.int32())})

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())
    return files.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op1_bit_plane_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through word_bpe_49k shards and back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_shards(docs, new_path(spark, "token-shards"), public_tokenizers.path("word_bpe_49k.json"), "words", end_id=2)
    return read_token_shards(manifest)
