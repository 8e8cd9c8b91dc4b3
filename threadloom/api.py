"""The query catalogue over one index, as methods that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import coupling, index, lookup, search, traverse
from .schema import Graph
from .sources import git
from .sources.paths import relative_path
from .sources.scan import indexed, scan_tree
from .sources.slices import slice_lines


class CodeIndex:
    """root: the working tree, for history; churn is then taken from git."""

    def __init__(self, graph: Graph, root: str | None = None, counted: Observation | None = None, folder: str | None = None):
        self.graph, self.root, self.spark, self.counted, self.folder = graph, root, graph.nodes.sparkSession, counted, folder

    @classmethod
    def build(cls, spark: SparkSession, root: str) -> CodeIndex:
        counted = Observation()
        return cls(index.build_index(scan_tree(spark, root, wanted=indexed(F.col("path"))), counted), root, counted)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, root: str | None = None) -> CodeIndex:
        return cls(index.current(spark, folder), root, folder=folder)

    def reindex(self, files: list[str] | None = None) -> CodeIndex:
        """After changes below root: only what changed is read again, or only the files given (relative paths)."""
        listed = scan_tree(self.spark, self.root, wanted=indexed(F.col("path")))
        counted = Observation()
        if files is None:
            return CodeIndex(index.update_index(self.graph, listed, counted), self.root, counted)
        return CodeIndex(index.update_files(self.graph, listed, [relative_path(f) for f in files], counted), self.root, counted)

    def counters(self) -> DataFrame:
        """What the run did that made this index; not known of a stored one."""
        if self.counted is None:
            raise ValueError("this index was not made by a run here")
        return index.run_counters(self.graph, self.counted)

    def _churn(self, wanted: bool, days: int) -> DataFrame | None:
        if self.graph.churn is not None:
            return self.graph.churn if wanted else None
        return git.file_churn(self.spark, self.root, days) if wanted and self.root else None

    def context(self, task: str) -> dict[str, DataFrame]:
        return search.build_context(self.graph, task)

    def search(self, query: str, semantic: bool = False, kind: str | None = None, limit: int = 10) -> DataFrame:
        return search.semantic_search(self.graph, query, limit) if semantic else search.search_names(self.graph, query, kind, limit)

    def callers(self, symbol: str) -> DataFrame:
        return lookup.callers(self.graph, symbol)

    def callees(self, symbol: str) -> DataFrame:
        return lookup.callees(self.graph, symbol)

    def impact(self, symbol: str, depth: int = 2) -> DataFrame:
        return traverse.impact(self.graph, symbol, depth).join(self.graph.nodes, "id").orderBy("level", "id")

    def impact_breakdown(self, symbol: str, churn: bool = False, days: int = 90) -> DataFrame:
        return coupling.impact_breakdown(self.graph, symbol, self._churn(churn, days))

    def node(self, symbol: str) -> DataFrame:
        return lookup.find_node(self.graph, symbol)

    def definition(self, symbol: str, context_lines: int = 3) -> DataFrame:
        spans = lookup.find_node(self.graph, symbol).select("id", "name", F.col("file_path").alias("path"), "start_line", "end_line")
        return slice_lines(self.graph.sources, spans, context_lines)

    def references(self, symbol: str) -> DataFrame:
        return lookup.references_by_kind(self.graph, symbol)

    def file(self, path: str) -> DataFrame:
        return lookup.nodes_by_file(self.graph, path)

    def hierarchy(self, symbol: str) -> DataFrame:
        return lookup.hierarchy(self.graph, symbol)

    def implementations(self, symbol: str) -> DataFrame:
        return lookup.implementations(self.graph, symbol)

    def path(self, start: str, end: str) -> DataFrame:
        return traverse.call_paths(self.graph, start, end)

    def unused(self) -> DataFrame:
        return lookup.unused_symbols(self.graph)

    def diff_impact(self, regions: DataFrame | None = None, git_ref: str = "HEAD") -> DataFrame:
        """For regions(file_path, first, last), or what differs from a revision."""
        return lookup.diff_impact(self.graph, git.changed_regions(self.spark, self.root, git_ref) if regions is None else regions)

    def blame(self, symbol: str) -> str:
        n = lookup.find_node(self.graph, symbol).first()
        return "" if n is None else git.blame(self.root, n.file_path, n.start_line, n.end_line)

    def churn(self, path: str | None = None, days: int = 90) -> DataFrame:
        return coupling.churn_rank(git.file_churn(self.spark, self.root, days, path))

    def module_graph(self, granularity: str = "module", churn: bool = False, days: int = 90) -> dict[str, DataFrame]:
        edges, known = coupling.module_edges(self.graph, granularity), self._churn(churn, days)
        nodes = coupling.module_nodes(edges, None if known is None else coupling.module_churn(known, granularity))
        return {"edges": edges.orderBy(F.desc("count"), "from", "to"), "nodes": nodes.orderBy(F.desc("fan_in"), F.desc("fan_out"), "module"), "cycles": coupling.module_cycles(edges)}

    def coupling_score(self, granularity: str = "module", churn: bool = True, days: int = 90) -> DataFrame:
        known = self._churn(churn, days)
        scored = coupling.coupling_score(coupling.module_edges(self.graph, granularity), None if known is None else coupling.module_churn(known, granularity))
        return scored.orderBy(F.desc("impact"), "from", "to")

    def god_struct(self, churn: bool = False, days: int = 90, limit: int = 20) -> DataFrame:
        return coupling.god_structs(self.graph, self._churn(churn, days), limit)

    def dispatch_sites(self, symbol: str) -> DataFrame:
        return lookup.dispatch_sites(self.graph, symbol).orderBy("file_path")

    def status(self) -> DataFrame:
        """Numbers of files, symbols and edges; of a stored index its size in bytes too."""
        found = lookup.index_status(self.graph)
        if self.folder is None:
            return found
        size = self.spark.createDataFrame([("total", "bytes", index.stored_bytes(self.spark, self.folder))], "section string, name string, count long")
        return found.unionByName(size)
