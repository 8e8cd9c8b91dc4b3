"""Streams of file versions: what they change, by a state for each path, and the index that follows them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import refresh
from ..schema import Graph

CHANGES = "path string, version long, change string, content_hash string"
_STATE = "version long, content_hash string"


def changes(versions: DataFrame) -> DataFrame:
    """path, version, change (added, changed, removed), content_hash of a stream of file versions(path, version, content_hash).

    A null content_hash says that the file is gone. Versions of a path are taken in their order, in a batch as over batches:
    what is not newer than the state, or says the same, changes nothing, so a batch that runs again adds nothing. The state
    of a path is its last version and hash; of removed files it stays, so that late versions don't bring them back. Of
    versions with equal numbers the one with the smallest hash counts, null last. Rows without path or version are left out.
    """
    rows = versions.where("path IS NOT NULL AND version IS NOT NULL").select("path", F.col("version").cast("long").alias("version"), "content_hash")
    return rows.groupBy("path").applyInPandasWithState(_follow, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def _follow(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    path, (seen, known) = key[0], state.get if state.exists else (None, None)
    told = []
    rows = sorted(((int(v), h is None, h) for b in batches for v, h in zip(b["version"], b["content_hash"].astype(object).where(b["content_hash"].notna(), None), strict=True)), key=lambda r: (r[0], r[1], r[2] or ""))
    for version, gone, hash_ in rows:
        if seen is not None and version <= seen:
            continue
        if hash_ != known:
            told.append((path, version, "removed" if gone else "added" if known is None else "changed", hash_))
        seen, known = version, hash_
    if seen is not None:
        state.update((seen, known))
    yield pd.DataFrame(told, columns=["path", "version", "change", "content_hash"])


def last_versions(files: DataFrame) -> DataFrame:
    """Of files(path, content, content_hash, language, version?) the last of each path: the greatest version, then the smallest hash."""
    shown = ("path", "content", "content_hash", "language")
    version = F.col("version") if "version" in files.columns else F.lit(0)
    best = files.groupBy("path").agg(F.min_by(F.struct("content", "content_hash", "language"), F.struct(-version, F.col("content_hash").isNull(), "content_hash")).alias("best"))
    return best.select("path", "best.*").select(*shown)


def with_versions(g: Graph | None, files: DataFrame) -> DataFrame:
    """The listing of a graph after these files: each in place of the one with its path; without content it is gone."""
    shown = ("path", "content", "content_hash", "language")
    there = files.where("content IS NOT NULL").select(*shown)
    if g is None:
        return there
    known = g.nodes.where("kind = 'file'").select(F.col("file_path").alias("path"), "language")
    return g.sources.join(files.select("path"), "path", "left_anti").join(known, "path").select(*shown).unionByName(there)


def stream_index(files: DataFrame, folder: str, checkpoint: str):
    """Indexes a stream of files(path, content, language, content_hash, version?): the last of each path in a batch replaces what
    the index has of it, null contents take it out. A batch is published as a layer; one that runs again changes nothing.

    Batches come in the order of the stream; versions order the files of a batch.
    """

    def batch(new: DataFrame, number: int) -> None:
        spark: SparkSession = new.sparkSession
        latest = last_versions(new).persist()
        try:
            refresh(spark, folder, lambda g: with_versions(g, latest))
        finally:
            latest.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
