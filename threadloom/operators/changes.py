"""Incremental maintenance: what changed between two listings, and tables without what is gone."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Graph


def changed_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """path, state (added, changed, same, removed) for listings (path, content_hash)."""
    a, b = new.select("path", F.col("content_hash").alias("_new")).withColumn("_a", F.lit(True)), old.select("path", F.col("content_hash").alias("_old")).withColumn("_b", F.lit(True))
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_new").eqNullSafe(F.col("_old")), "same").otherwise("changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def without_files(g: Graph, paths: DataFrame) -> Graph:
    """The graph without the symbols of these files, edges at either of their ends, and their references."""
    gone = g.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    ends = lambda c: gone.withColumnRenamed("id", c)
    edges = g.edges.join(ends("source_id"), "source_id", "left_anti").join(ends("target_id"), "target_id", "left_anti")
    refs = g.refs.join(ends("source_node_id"), "source_node_id", "left_anti") if g.refs is not None else None
    sources = g.sources.join(paths.select("path"), "path", "left_anti") if g.sources is not None else None
    return replace(g, nodes=g.nodes.join(gone, "id", "left_anti"), edges=edges, refs=refs, sources=sources)
