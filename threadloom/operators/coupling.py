"""Module graph, cycles, coupling scores, oversized types and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import boundary, distance
from ..schema import COUPLING_LABELS, STRENGTH, Graph
from .lookup import find_node
from .components import strong_components


def strength(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in STRENGTH.items()), F.lit(0))


def label(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in COUPLING_LABELS.items()), kind)


def counted(table: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Per keys: count; by_kind, a map sorted by kind; and the greatest strength."""
    each = table.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(kind), F.col("n"))))
    return each.groupBy(*keys).agg(F.sum("n").alias("count"), F.map_from_entries(entries).alias("by_kind"), F.max(strength(F.col(kind))).alias("strength"))


def as_text(by_kind: Column) -> Column:
    """A map of counts as 'kind:n, kind:n'."""
    return F.array_join(F.transform(F.map_entries(by_kind), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")


def module_edges(g: Graph, granularity: str = "module") -> DataFrame:
    """from, to, count, by_kind, strength of edges between different modules, without contains and tests."""
    # boundaries belong to nodes: worked out below the joins, they aren't repeated for every edge
    end = lambda column, name: g.nodes.select(F.col("id").alias(column), boundary(F.col("file_path"), granularity).alias(name))
    edges = g.edges.where(~F.col("kind").isin("contains", "tests")).select("source_id", "target_id", "kind")
    folded = edges.join(end("source_id", "from"), "source_id").join(end("target_id", "to"), "target_id").where(F.col("from") != F.col("to"))
    return counted(folded, ["from", "to"])


def module_churn(churn: DataFrame, granularity: str = "module") -> DataFrame:
    return churn.groupBy(boundary(F.col("path"), granularity).alias("module")).agg(F.sum("commits").alias("churn"))


def module_nodes(edges: DataFrame, churn: DataFrame | None = None) -> DataFrame:
    """module, fan_in, fan_out and churn (null where unknown) of the modules that module_edges names."""
    ends = edges.select(F.col("from").alias("module"), F.lit(0).alias("fan_in"), F.lit(1).alias("fan_out")).unionByName(edges.select(F.col("to").alias("module"), F.lit(1).alias("fan_in"), F.lit(0).alias("fan_out")))
    fans = ends.groupBy("module").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))
    if churn is None:
        return fans.withColumn("churn", F.lit(None).cast("long"))
    return fans.join(churn, "module", "left")


def module_cycles(edges: DataFrame) -> DataFrame:
    """cycle: sorted members of each strong component of more than one module."""
    scc = strong_components(edges.select(F.col("from").alias("a"), F.col("to").alias("b")))
    return scc.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("cycle")).where(F.size("cycle") > 1).select("cycle")


def coupling_score(edges: DataFrame, churn: DataFrame | None = None) -> DataFrame:
    """edges with distance, volatility and impact = strength * distance * volatility."""
    out = edges.withColumn("distance", distance(F.col("from"), F.col("to")))
    if churn is None:
        out = out.withColumn("volatility", F.lit(1).cast("long"))
    else:
        a, b = (churn.select(F.col("module").alias(end), F.col("churn").alias(f"{end}_churn")) for end in ("from", "to"))
        out = out.join(a, "from", "left").join(b, "to", "left").withColumn("volatility", F.greatest(F.col("from_churn"), F.col("to_churn"), F.lit(1))).drop("from_churn", "to_churn")
    return out.withColumn("impact", F.col("strength") * F.col("distance") * F.col("volatility"))


def impact_breakdown(g: Graph, name: str, churn: DataFrame | None = None) -> DataFrame:
    """How dependents couple to the first symbol of this name and its direct members.

    section (kind, module or total), name, edges, churn (of modules; null where there is none).
    """
    root = find_node(g, name).select("id")
    members = g.edges.where("kind = 'contains'").join(F.broadcast(root.withColumnRenamed("id", "source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    # a member that is contained twice counts twice
    into = g.edges.where("kind <> 'contains'").join(root.unionAll(members).withColumnRenamed("id", "target_id"), "target_id").select("kind", "file_path")
    kinds = into.groupBy(label(F.col("kind")).alias("name")).agg(F.count("*").alias("edges")).select(F.lit("kind").alias("section"), "name", "edges", F.lit(None).cast("long").alias("churn"))
    total = into.agg(F.count("*").alias("edges")).select(F.lit("total").alias("section"), F.lit(name).alias("name"), "edges", F.lit(None).cast("long").alias("churn"))
    modules = into.where(F.col("file_path").isNotNull()).groupBy(boundary(F.col("file_path")).alias("name")).agg(F.count("*").alias("edges"))
    if churn is not None:
        known = module_churn(churn).where("churn > 0").withColumnRenamed("module", "name")
        modules = modules.join(known, "name", "left")
    else:
        modules = modules.withColumn("churn", F.lit(None).cast("long"))
    return kinds.unionByName(total).unionByName(modules.select(F.lit("module").alias("section"), "name", "edges", "churn"))


def god_structs(g: Graph, churn: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """Structs and classes by public fields, inbound files and churn.

    id, name, file_path, pub_fields, total_fields, inbound_refs, churn, score; fields are those of containers of the name.
    """
    types = g.nodes.where(F.col("kind").isin("struct", "class")).select("id", "name", "file_path")
    from ..schema import CONTAINERS

    holders = g.nodes.where(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("source_id"), F.col("name").alias("owner"))
    parts = g.nodes.where(F.col("kind").isin("field", "property")).select(F.col("id").alias("target_id"), (F.col("visibility") == "public").alias("public"))
    fields = g.edges.where("kind = 'contains'").select("source_id", "target_id").join(holders, "source_id").join(parts, "target_id").select("owner", F.col("target_id").alias("field_id"), "public")
    counts = fields.groupBy(F.col("owner").alias("name")).agg(F.count_if("public").alias("pub_fields"), F.count("*").alias("total_fields"))
    # files with an edge to a type or one of its fields
    inbound = g.edges.where((F.col("kind") != "contains") & F.col("file_path").isNotNull()).select("target_id", F.col("file_path").alias("from_file")).distinct()
    to_type = types.select(F.col("id").alias("target_id"), "id").join(inbound, "target_id").select("id", "from_file")
    by_name = fields.select("owner", F.col("field_id").alias("target_id")).distinct().join(inbound, "target_id").select(F.col("owner").alias("name"), "from_file").distinct()
    to_field = types.select("id", "name").join(by_name, "name").select("id", "from_file")
    refs = to_type.unionByName(to_field).groupBy("id").agg(F.countDistinct("from_file").alias("inbound_refs"))
    out = types.join(counts, "name", "left").join(refs, "id", "left").fillna(0, ["pub_fields", "total_fields", "inbound_refs"])
    if churn is None:
        out = out.withColumn("churn", F.lit(0).cast("long"))
    else:
        out = out.join(churn.select(F.col("path").alias("file_path"), F.col("commits").alias("churn")), "file_path", "left").fillna(0, ["churn"])
    one = F.lit(1).cast("long")
    out = out.withColumn("score", F.greatest("pub_fields", one) * F.greatest("inbound_refs", one) * F.greatest("churn", one)).select("id", "name", "file_path", "pub_fields", "total_fields", "inbound_refs", "churn", "score")
    return out.orderBy(F.desc("score"), "name", "id").limit(limit) if limit else out


def churn_rank(churn: DataFrame, limit: int = 30) -> DataFrame:
    return churn.orderBy(F.desc("commits"), "path").limit(limit)


def related_rank(g: Graph, entries: DataFrame, limit: int = 10, each: int = 10) -> DataFrame:
    """Nodes near entries(id): 1/(rank+1) for each of the first callees, 0.8/(rank+1) for each of the first callers.

    id, score; entries themselves are left out but take a rank.
    """

    def side(near: str, far: str, weight: float) -> DataFrame:
        calls = g.edges.where("kind = 'calls'").join(entries.select(F.col("id").alias(near)), near, "left_semi")
        rank = F.row_number().over(Window.partitionBy(near).orderBy("id"))
        return calls.select(F.col(far).alias("id"), (rank - 1).alias("rank")).where(F.col("rank") < each).select("id", (F.lit(weight) / (F.col("rank") + 1)).alias("score"))

    both = side("source_id", "target_id", 1.0).unionByName(side("target_id", "source_id", 0.8))
    return both.join(entries.select("id"), "id", "left_anti").groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(limit)
