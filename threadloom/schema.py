"""Table schemas and closed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

FILES = "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int"
NODES = (
    "id long, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, start_column int, end_column int, "
    "signature string, visibility string, docstring string, is_async boolean, is_static boolean, is_exported boolean, is_test boolean, is_generated boolean, language string"
)
EDGES = "id long, source_id long, target_id long, kind string, file_path string, line int, column int, detail string"
REFS = "id long, source_node_id long, reference_name string, kind string, file_path string, line int, column int, detail string"
CHURN = "path string, commits long"
SOURCES = "path string, content string"

# Vocabularies as stored, and what results depend on.
NODE_KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component".split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates accesses mutates tests".split()
STRENGTH = {"calls": 1, "implements": 1, "overrides": 1, "accesses": 2, "imports": 2, "type_of": 2, "returns": 2, "mutates": 3}
REFERENCE_ORDER = ("calls", "imports", "extends", "implements", "contains", "references", "exports")
COUPLING_LABELS = {
    "calls": "method-call (contract)",
    "accesses": "field-read (model)",
    "mutates": "field-write (intrusive)",
    "imports": "import (model)",
    "implements": "implements (contract)",
    "overrides": "implements (contract)",
    "references": "reference",
    "tests": "test",
}
CONTAINERS = ("struct", "class", "interface", "trait", "protocol")
DEAD_KINDS = ("function", "method", "class", "struct", "interface")
USES = ("calls", "references", "instantiates", "tests")
INDEX_STEMS = ("mod", "lib", "main", "index", "__init__")
GRANULARITIES = ("file", "dir", "module")


@dataclass(frozen=True)
class Graph:
    """The property graph; every operator is a function of these tables."""

    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame | None = None
    sources: DataFrame | None = None
    churn: DataFrame | None = None
    postings: DataFrame | None = None
    totals: DataFrame | None = None
    names: DataFrame | None = None
