"""Lookups, neighbours and relations of symbols, set at a time.

"First" always means lowest id; edges come in id order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONTAINERS, DEAD_KINDS, USES, Graph
from .ranges import touched


def node_by_id(g: Graph, node_id: int) -> DataFrame:
    return g.nodes.where(F.col("id") == node_id)


def find_node(g: Graph, name: str) -> DataFrame:
    """The first symbol of exactly this name."""
    return g.nodes.where(F.col("name") == name).orderBy("id").limit(1)


def find_preferring_file(g: Graph, name: str, file_path: str) -> DataFrame:
    return g.nodes.where(F.col("name") == name).orderBy((F.col("file_path") == file_path).desc(), "id").limit(1)


def nodes_by_file(g: Graph, file_path: str) -> DataFrame:
    return g.nodes.where(F.col("file_path") == file_path).orderBy("start_line", "id")


def nodes_by_kind(g: Graph, kind: str) -> DataFrame:
    return g.nodes.where(F.col("kind") == kind).orderBy("name", "id")


def edges_of(g: Graph, node_id: int, incoming: bool = True) -> DataFrame:
    return g.edges.where(F.col("target_id" if incoming else "source_id") == node_id).orderBy("id")


def overlaps(start: int, end: int) -> Column:
    """Whether a symbol's lines meet [start, end]."""
    return (F.col("start_line") <= end) & (F.col("end_line") >= start)


def _of_first(g: Graph, name: str, near: str, far: str, kind: str) -> DataFrame:
    root = find_node(g, name).select(F.col("id").alias(near))
    # the looked-up side is one row
    hits = g.edges.where(F.col("kind") == kind).join(F.broadcast(root), near, "left_semi").select(F.col("id").alias("edge_id"), F.col(far).alias("id"))
    return hits.join(g.nodes, "id")


def callers(g: Graph, name: str, limit: int = 20) -> DataFrame:
    """Sources of calls to the first symbol of this name: a row per call."""
    return _of_first(g, name, "target_id", "source_id", "calls").orderBy("edge_id").limit(limit)


def callees(g: Graph, name: str, limit: int = 20) -> DataFrame:
    return _of_first(g, name, "source_id", "target_id", "calls").orderBy("edge_id").limit(limit)


def _related(g: Graph, kinds: tuple[str, ...], near: str, far: str, near_where: Column) -> DataFrame:
    """Nodes at the far end of edges whose near end satisfies a condition; a row per edge."""
    ids = g.nodes.where(near_where).select(F.col("id").alias(near))
    return g.edges.where(F.col("kind").isin(*kinds)).join(ids, near, "left_semi").select(F.col(far).alias("id")).join(g.nodes, "id")


def hierarchy(g: Graph, name: str) -> DataFrame:
    """Parents and children over contains of all symbols of this name, once each."""
    named = F.col("name") == name
    return _related(g, ("contains",), "target_id", "source_id", named).unionByName(_related(g, ("contains",), "source_id", "target_id", named)).distinct()


def implementations(g: Graph, name: str) -> DataFrame:
    """Symbols that implement or extend one of this name; a row per edge."""
    return _related(g, ("implements", "extends"), "target_id", "source_id", F.col("name") == name)


def struct_fields(g: Graph, name: str) -> DataFrame:
    """Fields contained in containers of this name."""
    return _related(g, ("contains",), "source_id", "target_id", (F.col("name") == name) & F.col("kind").isin(*CONTAINERS)).where(F.col("kind").isin("field", "property"))


def unused_symbols(g: Graph) -> DataFrame:
    """Functions, methods and types that are neither tests nor generated and that nothing calls, references or tests."""
    used = g.edges.where(F.col("kind").isin(*USES)).select(F.col("target_id").alias("id"))
    return g.nodes.where(F.col("kind").isin(*DEAD_KINDS) & ~F.col("is_test") & ~F.col("is_generated")).join(used, "id", "left_anti").orderBy("file_path", "start_line", "id")


def edge_endpoints(g: Graph) -> DataFrame:
    """source_file, target_file, kind, detail of every edge."""
    source = g.nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file"))
    target = g.nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("target_file"))
    return g.edges.join(source, "source_id").join(target, "target_id").select("source_file", "target_file", "kind", "detail")


def diff_impact(g: Graph, regions: DataFrame, callers_each: int = 100) -> DataFrame:
    """Symbols that regions(file_path, first, last) touch (direct) and the callers of those; once each.

    Calls to one symbol count up to callers_each, in id order.
    """
    direct = touched(g.nodes, regions)
    calls = g.edges.where("kind = 'calls'").join(direct.withColumnRenamed("id", "target_id"), "target_id")
    nth = F.row_number().over(Window.partitionBy("target_id").orderBy("id"))
    indirect = calls.withColumn("nth", nth).where(F.col("nth") <= callers_each).select(F.col("source_id").alias("id"))
    hit = direct.withColumn("direct", F.lit(True)).unionByName(indirect.withColumn("direct", F.lit(False)))
    return hit.groupBy("id").agg(F.max("direct").alias("direct")).join(g.nodes, "id")


def dispatch_sites(g: Graph, enum_name: str) -> DataFrame:
    """Files that match on members of the enum: file_path and the sorted member names."""
    enum = g.nodes.where((F.col("name") == enum_name) & (F.col("kind") == "enum")).select(F.col("id").alias("source_id"))
    members = g.edges.where("kind = 'contains'").join(enum, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    named = g.nodes.where("kind = 'enum_member'").join(members, "id", "left_semi").select(F.col("id").alias("target_id"), F.col("name").alias("member"))
    sites = g.edges.where("kind = 'references'").join(named, "target_id").select("source_id", "member").join(g.nodes.select(F.col("id").alias("source_id"), "file_path"), "source_id")
    return sites.groupBy("file_path").agg(F.array_sort(F.collect_set("member")).alias("members"))


def references_by_kind(g: Graph, name: str, shown: int = 20, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Incoming edges of the first symbol of this name by kind: kind, count and the first sources.

    kinds: those that are reported, in this order (the seven of the reference set by default).
    """
    from ..schema import REFERENCE_ORDER

    order = kinds or REFERENCE_ORDER
    root = find_node(g, name).select(F.col("id").alias("target_id"))
    hits = g.edges.where(F.col("kind").isin(*order)).join(F.broadcast(root), "target_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    source = g.nodes.select(F.col("id").alias("source_id"), "name", F.col("kind").alias("source_kind"), F.col("file_path").alias("file"))
    first = hits.withColumn("nth", nth).where(F.col("nth") <= shown).join(source, "source_id")
    items = first.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("nth", "name", "source_kind", "file", "line"))).alias("shown"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind")).alias("rank")
    return hits.groupBy("kind").agg(F.count("*").alias("count")).join(items, "kind").select(rank, "kind", "count", "shown").orderBy("rank")


def index_status(g: Graph) -> DataFrame:
    """Counts of the index: section (total, kind or language), name, count."""
    total = lambda t, name: t.agg(F.count("*").alias("count")).select(F.lit("total").alias("section"), F.lit(name).alias("name"), "count")
    by = lambda c: g.nodes.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("count")).select(F.lit(c).alias("section"), "name", "count")
    files = g.nodes.select("file_path").distinct()
    return total(files, "files").unionByName(total(g.nodes, "nodes")).unionByName(total(g.edges, "edges")).unionByName(by("kind")).unionByName(by("language"))
