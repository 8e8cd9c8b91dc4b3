"""Resolution of references by name: the same file first, then the lowest id anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from ..session import written


#: A name, or a name in a file, with more than one in HOT of all references goes by broadcast: there are fewer than HOT of them.
HOT = 1000


def targets_by_place(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """reference_name, file_path, n (references), target_id (null: none) for each name in each file that refers to it.

    The name's first symbol in the file, else anywhere. Names of many files get the latter by broadcast, so that no task has
    them all.
    """
    asked = written(refs.where("reference_name IS NOT NULL").groupBy("reference_name", "file_path").agg(F.count("*").alias("n")), "asked")
    wanted = targets.select(F.col("name").alias("reference_name"), "file_path", "id")
    per_file = wanted.groupBy("reference_name", "file_path").agg(F.min("id").alias("local"))
    anywhere = wanted.groupBy("reference_name").agg(F.min("id").alias("global"))
    files = asked.groupBy("reference_name").agg(F.count("*").alias("files"))
    hot = F.broadcast(files.where(F.col("files") * HOT > asked.count()).join(anywhere, "reference_name", "left").select("reference_name", "global"))
    local = asked.join(per_file, ["reference_name", "file_path"], "left")
    wide = local.join(hot, "reference_name")
    rest = local.join(hot.select("reference_name"), "reference_name", "left_anti").join(anywhere, "reference_name", "left")
    return written(wide.unionByName(rest).select("reference_name", "file_path", "n", F.coalesce("local", "global").alias("target_id")), "targets")


def resolve_references(g: Graph, files: DataFrame | None = None, skip_imports: bool = False) -> DataFrame:
    """Edges for the references that resolve: ref_id, source_id, target_id, kind, file_path, line, column, detail.

    A call from a test gives a tests edge too. files(file_path): only references of these files. skip_imports: import
    symbols are no targets. Each name in a file is looked up once, and references meet those targets by join, the frequent ones by
    broadcast; so a name on a third of all references burdens no single task. References stay in their table, so a later resolution over more symbols repairs nothing by hand.
    """
    refs = g.refs if files is None else g.refs.join(files.select("file_path"), "file_path", "left_semi")
    targets = g.nodes.where(F.col("kind") != "import") if skip_imports else g.nodes
    known = targets_by_place(refs, targets)
    total = known.agg(F.sum("n")).first()[0] or 0
    # fewer than HOT places can hold more than that share of the references each
    hot = F.col("n") * HOT > total
    same = (F.col("reference_name") == F.col("name_")) & F.col("file_path").eqNullSafe(F.col("file_"))
    at = lambda rows: rows.select(F.col("reference_name").alias("name_"), F.col("file_path").alias("file_"), "target_id")
    often = F.broadcast(at(known.where(hot)))
    few = refs.join(often.select("name_", "file_"), same, "left_anti").join(at(known.where(~hot)), same)
    found = refs.join(often, same).unionByName(few).where("target_id IS NOT NULL")
    columns = [F.col("id").alias("ref_id"), F.col("source_node_id").alias("source_id"), "target_id", "kind", "file_path", "line", "column", "detail"]
    edges = found.select(*columns)
    testers = g.nodes.where("is_test").select(F.col("id").alias("source_id"))
    tests = edges.where("kind = 'calls'").join(testers, "source_id", "left_semi").withColumn("kind", F.lit("tests"))
    return edges.unionByName(tests)


def touched_names(*symbols: DataFrame) -> DataFrame:
    """name: all names of symbols(name, ...) that came, went or changed; references to other names resolve as before."""
    out = symbols[0].select("name")
    for more in symbols[1:]:
        out = out.union(more.select("name"))
    return out.distinct()


def references_to(refs: DataFrame, names: DataFrame) -> DataFrame:
    return refs.join(names.select(F.col("name").alias("reference_name")), "reference_name", "left_semi")


def resolve_some(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """As resolve_references, for a few references: of the symbols only those of their names take part."""
    asked = refs.select(F.col("reference_name").alias("name")).distinct()
    testers = nodes.where("is_test").join(refs.select(F.col("source_node_id").alias("id")).distinct(), "id", "left_semi")
    targets = nodes.join(asked, "name", "left_semi")
    return resolve_references(Graph(targets.unionByName(testers.join(asked, "name", "left_anti")), refs, refs))
