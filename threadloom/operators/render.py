"""Results as JSON lines or as markdown, for people and tools. Meant for the bounded results of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """value: one JSON object for each row, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def as_markdown(df: DataFrame, limit: int = 30) -> str:
    """A table of the first rows, and a line that says if there are more."""
    rows = df.limit(limit + 1).collect()
    if not rows:
        return "No results."

    def cell(x) -> str:
        return "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:limit]]
    return "\n".join(lines + ([f"... and more than {limit} rows"] if len(rows) > limit else []))
