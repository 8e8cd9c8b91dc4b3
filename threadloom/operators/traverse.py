"""Graph traversals as loops of joins: impact, paths and subgraphs; strong components are in components.

Each round's frontier is written to a table in the shared folder, so that lineage doesn't grow and lost executors cost a
round at most. Frontiers meet the edges in joins; nothing but row counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Graph
from ..session import written
from .components import strong_components  # noqa: F401
from .lookup import find_node


def checkpointed(df: DataFrame) -> DataFrame:
    return written(df, "round")


def impact(g: Graph, name: str, depth: int = 2, fan_in: int = 100) -> DataFrame:
    """Callers of callers: id and level (1 is direct) of what reaches the first symbol of this name over calls.

    Of the calls to one symbol, the first fan_in by id count.
    """
    first = Window.partitionBy("target_id").orderBy("id")
    calls = g.edges.where("kind = 'calls'").select("id", "source_id", "target_id")
    seen = checkpointed(find_node(g, name).select("id", F.lit(0).alias("level")))
    for level in range(1, depth + 1):
        frontier = seen.where(F.col("level") == level - 1).select(F.col("id").alias("target_id"))
        step = calls.join(frontier, "target_id").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= fan_in)
        new = step.select(F.col("source_id").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level))
        new = checkpointed(new)
        if not new.take(1):
            break
        seen = seen.unionByName(new)
    return seen.where("level > 0")


def call_paths(g: Graph, start: str, end: str, limit: int = 5, longest: int = 10, fan_out: int = 100) -> DataFrame:
    """Paths of calls between two symbols in breadth-first order: nth, path (array of ids).

    A node is expanded once, by the first path that reaches it; a path of more than ``longest`` nodes isn't expanded; of the
    calls of a symbol, the first fan_out by id count.
    """
    calls = g.edges.where("kind = 'calls'").select("id", "source_id", "target_id")
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("id"))
    target = find_node(g, end).select(F.col("id").alias("end_id"))
    # order: the places in the queues of all rounds so far, compared as an array
    queue = checkpointed(find_node(g, start).select(F.array("id").alias("path"), F.array(F.lit(0).cast("long")).alias("place")).join(F.broadcast(target)))
    found, expanded = None, None
    for _ in range(longest + 1):
        at = F.element_at("path", -1)
        hits = queue.where(at == F.col("end_id")).select("path", "place")
        found = checkpointed(hits) if found is None else checkpointed(found.unionByName(hits))
        if found.count() >= limit:
            break
        once = Window.partitionBy("source_id").orderBy("place")
        open_ = queue.where((at != F.col("end_id")) & (F.size("path") <= longest)).withColumn("source_id", at)
        if expanded is not None:
            open_ = open_.join(expanded, "source_id", "left_anti")
        open_ = checkpointed(open_.withColumn("turn", F.row_number().over(once)).where("turn = 1").drop("turn"))
        new = open_.select("source_id")
        expanded = new if expanded is None else checkpointed(expanded.unionByName(new))
        out = calls.join(new, "source_id", "left_semi").withColumn("nth", nth).where(F.col("nth") <= fan_out)
        queue = checkpointed(open_.join(out, "source_id").select(F.array_append("path", F.col("target_id")).alias("path"), F.array_append("place", F.col("nth").cast("long")).alias("place"), "end_id"))
        if not queue.take(1):
            break
    order = Window.orderBy(F.size("path"), "place")
    # at most a few paths of bounded length are ranked here
    return found.orderBy(F.size("path"), "place").limit(limit).withColumn("nth", F.row_number().over(order)).select("nth", "path")


def subgraph(g: Graph, roots: DataFrame, depth: int = 2, limit: int = 50, node_kinds: tuple[str, ...] = (), edge_kinds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Undirected neighbourhood of roots(id): nodes (id, level) up to a limit, by level and id; and edge ids met on the way.

    An edge to a node of a kind that isn't wanted is returned, the node is not.
    """
    edges = g.edges.where(F.col("kind").isin(*edge_kinds)) if edge_kinds else g.edges
    ends = edges.select("id", F.col("source_id").alias("near"), F.col("target_id").alias("far")).unionByName(edges.select("id", F.col("target_id").alias("near"), F.col("source_id").alias("far")))
    wanted = g.nodes.where(F.col("kind").isin(*node_kinds)).select(F.col("id").alias("far")) if node_kinds else g.nodes.select(F.col("id").alias("far"))
    seen = checkpointed(g.nodes.select("id").join(roots.select("id").distinct(), "id", "left_semi").withColumn("level", F.lit(0)).orderBy("id").limit(limit))
    met = None
    for level in range(1, depth + 1):
        step = checkpointed(ends.join(seen.where(F.col("level") == level - 1).select(F.col("id").alias("near")), "near", "left_semi"))
        met = step.select("id").distinct() if met is None else met.unionByName(step.select("id")).distinct()
        room = limit - seen.count()
        new = step.select("far").distinct().join(wanted, "far", "left_semi").select(F.col("far").alias("id")).join(seen.select("id"), "id", "left_anti").orderBy("id").limit(max(room, 0)).withColumn("level", F.lit(level))
        new = checkpointed(new)
        if not new.take(1):
            break
        seen = seen.unionByName(new)
    return seen, met
