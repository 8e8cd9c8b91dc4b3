"""Slices of source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_lines(sources: DataFrame, spans: DataFrame, around: int = 3) -> DataFrame:
    """spans(path, start_line, end_line, ...) with text: these lines (from 1) of the source and some around."""
    lines = F.split("content", "\n")
    first = F.greatest(F.col("start_line") - around, F.lit(1))
    last = F.least(F.col("end_line") + around, F.size(lines))
    text = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    return spans.join(sources.select("path", "content"), "path").withColumn("text", text).drop("content")
