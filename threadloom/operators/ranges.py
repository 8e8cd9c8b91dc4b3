"""Which symbols the regions of a diff touch, by one sweep over ends and beginnings instead of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Lines of a file that one group of the sweep covers.
LINES = 4096


def touched(symbols: DataFrame, regions: DataFrame, lines: int = LINES) -> DataFrame:
    """id, once each, of symbols(id, file_path, start_line, end_line) whose lines meet one of regions(file_path, first, last).

    Of the regions that begin no later than a symbol ends, the one that reaches farthest decides: the symbol is met exactly if
    that isn't before its start. So a row for each line on which something begins or ends is enough, and no region meets a
    symbol that isn't asked. A group of the sweep holds at most ``lines`` rows however many regions or symbols a file has; how
    far the groups before it reach is a row for each group. Rows with a null in one of these columns meet nothing; other
    columns, of any names, have no effect.
    """
    parts = regions.where("first IS NOT NULL AND last IS NOT NULL").groupBy("file_path", F.col("first").cast("long").alias("at")).agg(F.max("last").cast("long").alias("reach"))
    near = symbols.select("id", "file_path", F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("at"))
    # read twice below: symbols of the regions' files alone
    near = written(near.join(parts.select("file_path").distinct(), "file_path", "left_semi"), "near")
    asked = near.where("at IS NOT NULL").select("file_path", "at", F.lit(None).cast("long").alias("reach"))
    group = F.floor(F.col("at") / lines)
    points = parts.unionByName(asked).groupBy("file_path", "at").agg(F.max("reach").alias("reach")).withColumn("part", group)
    before = F.max("most").over(Window.partitionBy("file_path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    groups = points.groupBy("file_path", "part").agg(F.max("reach").alias("most")).select("file_path", "part", before.alias("before"))
    within = F.max("reach").over(Window.partitionBy("file_path", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    reaches = points.withColumn("reach", within).join(groups, ["file_path", "part"]).select("file_path", "at", F.greatest("reach", "before").alias("reach"))
    return near.join(reaches, ["file_path", "at"]).where("start <= reach").select("id").distinct()
