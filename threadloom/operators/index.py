"""Indexing: from files(path, content, ...) to the tables of the graph; full, incremental, and published as snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import NODES, REFS, Graph
from ..sources.extract import Code, generated, is_test_path, read_code, references, symbols
from ..sources.manifest import manifest_symbols
from .changes import changed_files
from .resolve import references_to, resolve_references, resolve_some, touched_names
from .search import semantic_index
from .textindex import BLOCK, name_places, write_sorted
from ..session import written
from .traverse import checkpointed

#: What a version holds.
TABLES = ("nodes", "edges", "refs", "sources", "postings", "totals", "names")
#: Tables that are stored in order.
SORTED = {"postings": ("token", "block"), "names": ("token", "id")}
#: Symbols, references and edges that a file has room for in the numbering each.
ROOM = 1 << 24


def _roomy(place: Column) -> Column:
    return F.when(place < ROOM, place).otherwise(F.raise_error(F.lit(f"a file has {ROOM} symbols, references or edges, or more")))


def numbered_files(files: DataFrame, first: int = 0) -> DataFrame:
    """files with seq: their rank by path, counted by partition, from first on."""
    # equal paths meet in a range, so distinct deals out nothing anew
    ranged = checkpointed(files.select("path").repartitionByRange("path").distinct().sortWithinPartitions("path").select("path", F.monotonically_increasing_id().alias("_m")))
    part, place = F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    seq = ranged.select("path", part, place).join(F.broadcast(before), "_part").select("path", (F.col("_before") + F.col("_place") + first).alias("seq"))
    return files.join(seq, "path")


def extract_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, contains edges and refs of files(path, content, language, seq), from written tables."""
    code = read_code(files)
    numbered = numbered_symbols(files, code)
    found = checkpointed(nested(numbered, references(code, numbered)))
    every = checkpointed(placed_nodes(files, numbered, found.where("id IS NOT NULL")))
    contains = every.where(F.col("id").bitwiseAND(F.lit(ROOM - 1)) > 0).select(F.coalesce(F.col("outer"), _file_number("id") * ROOM).alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("kind"), "file_path", F.col("start_line").alias("line"), F.lit(0).alias("column"), F.lit(None).cast("string").alias("detail"))
    site = lambda source: [source.alias("source_node_id"), "reference_name", "kind", F.col("path").alias("file_path"), "line", "detail"]
    sites = found.where("id IS NULL")
    outside = sites.where("outer IS NULL").join(files.select("path", "seq"), "path")
    sites = sites.where("outer IS NOT NULL").select(site(F.col("outer"))).unionByName(outside.select(site(F.col("seq") * ROOM)))
    once = sites.where(~F.col("kind").isin("calls", "imports")).groupBy("source_node_id", "reference_name", "kind", "file_path").agg(F.min("line").alias("line"), F.min("detail").alias("detail"))
    imports = sites.where("kind = 'imports'").distinct()
    all_refs = sites.where("kind = 'calls'").unionByName(once).unionByName(imports).withColumn("column", F.lit(0))
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("line", "kind", "reference_name", "source_node_id"))
    all_refs = all_refs.withColumn("id", _file_number("source_node_id") * ROOM + _roomy(nth))
    return every.drop("outer"), contains, checkpointed(all_refs.select([c.split()[0] for c in REFS.split(", ")]))


def extract_nodes(files: DataFrame) -> DataFrame:
    """The nodes of extract_tables alone: references aren't looked for."""
    numbered = numbered_symbols(files, read_code(files))
    return placed_nodes(files, numbered, nested(numbered)).drop("outer")


def _file_number(node_id: str) -> Column:
    """The number of the file that a node stands in."""
    return F.shiftright(node_id, ROOM.bit_length() - 1)


def numbered_symbols(files: DataFrame, code: Code) -> DataFrame:
    """The symbols of code and manifests with their ids, written."""
    made = manifest_symbols(files).select("path", "kind", "name", "signature", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit("public").alias("visibility"), F.lit(True).alias("is_exported"))
    both = symbols(code).unionByName(made, allowMissingColumns=True).fillna(False, ["is_async", "is_static", "is_test", "is_exported"])
    head = files.select("path", "seq", F.col("language").alias("file_language"), generated(F.col("path"), F.col("content")).alias("is_generated"))
    order = Window.partitionBy("path").orderBy("start_line", "start_column", "kind", "name")
    numbered = both.withColumn("ordinal", F.row_number().over(order)).join(head, "path")
    return checkpointed(numbered.withColumn("id", F.col("seq") * ROOM + _roomy(F.col("ordinal"))))


def placed_nodes(files: DataFrame, numbered: DataFrame, places: DataFrame) -> DataFrame:
    """The nodes of files and symbols, and of the latter the symbol around it (outer); places(id, outer, qualified_name)."""
    placed = numbered.join(places.select("id", "outer", "qualified_name"), "id")
    nodes = placed.select("id", "outer", "kind", "name", "qualified_name", F.col("path").alias("file_path"), "start_line", "end_line", F.coalesce("start_column", F.lit(0)).alias("start_column"), F.lit(0).alias("end_column"), "signature", "visibility", "docstring", "is_async", "is_static", "is_exported", "is_test", "is_generated", F.coalesce("language", "file_language").alias("language"))
    none, zero, false, path = F.lit(None).cast("string"), F.lit(0), F.lit(False), F.col("path")
    file_nodes = files.select((F.col("seq") * ROOM).alias("id"), F.lit(None).cast("long").alias("outer"), F.lit("file").alias("kind"), F.substring_index("path", "/", -1).alias("name"), none.alias("qualified_name"), path.alias("file_path"), zero.alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), zero.alias("start_column"), zero.alias("end_column"), none.alias("signature"), F.lit("public").alias("visibility"), none.alias("docstring"), false.alias("is_async"), false.alias("is_static"), false.alias("is_exported"), is_test_path(path).alias("is_test"), generated(path, F.col("content")).alias("is_generated"), "language")
    return file_nodes.unionByName(nodes)


def nested(found: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """For each symbol (id) the innermost one around it and its qualified name; for each reference, if given, one row by symbol around it.

    An import belongs to the innermost symbol or to the file (outer is null). One pass in line order over the files of a
    partition, with the open symbols on a stack.
    """
    none = lambda kind: F.lit(None).cast(kind)
    opens = found.select("path", F.col("start_line").alias("line"), "end_line", "ordinal", "id", "name", F.when(F.col("kind") == "import", 0).when(F.col("kind").isin("field", "enum_member", "constant", "type_alias") & (F.col("start_line") == F.col("end_line")), 1).otherwise(2).alias("holds"), none("string").alias("reference_name"), none("string").alias("kind"), none("string").alias("detail"), "number", "above")
    if refs is not None:
        opens = opens.unionByName(refs.select("path", "line", none("int").alias("end_line"), none("int").alias("ordinal"), none("long").alias("id"), none("string").alias("name"), F.when(F.col("kind") == "imports", -1).otherwise(0).alias("holds"), "reference_name", "kind", "detail", none("int").alias("number"), none("array<int>").alias("above")))
    rows = opens.repartition("path").sortWithinPartitions("path", "line", F.desc_nulls_last("end_line"), "ordinal").drop("ordinal")
    same = ("path", "line", "reference_name", "kind", "detail")

    def walk(record_batches):
        import pyarrow as pa

        here, stack = None, []  # of (last line, id, name, number of its statement, holds)
        for rb in record_batches:
            found = []  # of (row of the batch, id, outer, qualified name)
            read = (rb.column(n).to_pylist() for n in ("path", "line", "end_line", "id", "name", "holds", "number", "above"))
            for at, (path, line, end, id_, name, holds, number, above) in enumerate(zip(*read, strict=True)):
                if path != here:
                    here, stack = path, []
                while stack and stack[-1][0] < line:
                    stack.pop()
                around = [x for x in stack if x[0] >= (line if end is None else end)]
                if id_ is not None:
                    # several on one line stand beside each other or within
                    around = [x for x in around if x[4] == 2] if above is None else [x for x in stack if x[3] in above]
                    found.append((at, id_, around[-1][1] if around else None, "::".join([*(x[2] for x in around), name])))
                    if holds:
                        stack.append((end, id_, name, number, holds))
                elif holds < 0:
                    found.append((at, None, around[-1][1] if around else None, None))
                else:
                    found += [(at, None, x[1], None) for x in around]
            if found:
                at, ids, outer, names = (pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True))
                out = {n: rb.column(n).take(at) for n in same} | {"id": ids, "outer": outer, "qualified_name": names}
                yield pa.RecordBatch.from_pydict({n: out[n] for n in ("path", "line", "id", "outer", "qualified_name", "reference_name", "kind", "detail")})

    return rows.mapInArrow(walk, "path string, line int, id long, outer long, qualified_name string, reference_name string, kind string, detail string")


def numbered_edges(edges: DataFrame) -> DataFrame:
    """Edges with ids by the file they stand in, which is that of their source."""
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("line", "kind", "source_id", "target_id"))
    return edges.withColumn("id", _file_number("source_id") * ROOM + _roomy(nth))


def with_resolved(nodes: DataFrame, contains: DataFrame, refs: DataFrame, sources: DataFrame | None = None) -> Graph:
    """The graph of these tables: contained and resolved edges."""
    edges = contains.unionByName(resolve_references(Graph(nodes, contains, refs)).drop("ref_id"))
    return Graph(nodes.select([c.split()[0] for c in NODES.split(", ")]), numbered_edges(edges), refs, sources)


@dataclass(frozen=True)
class Layer:
    """What an update changes: the files (file_path, seq) whose symbols, references and texts are replaced, those whose edges are, and the rows in their place."""

    replaced: DataFrame
    renumbered: DataFrame
    rows: Graph


def read_once(files: DataFrame, known: DataFrame | None = None, counted: Observation | None = None) -> DataFrame:
    """path, content, content_hash, language of a listing's files with text, written: a tree is read once, whatever follows.

    known(path, content_hash): of files with the hash known here no content is kept. counted observes on the way how many files
    were listed, were errors (without text) and were read anew.
    """
    files = files.select("path", "content", "content_hash", "language")
    anew = F.col("content").isNotNull()
    if known is not None:
        files = files.join(known.select("path", F.col("content_hash").alias("_was"), F.lit(True).alias("_known")), "path", "left")
        anew &= F.col("_known").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_was"))
    files = files.select("path", F.when(anew, F.col("content")).alias("content"), "content_hash", "language", F.col("content").isNull().alias("error"), anew.alias("anew"))
    if counted is not None:
        files = files.observe(counted, F.count(F.lit(1)).alias("listed"), F.count_if("error").alias("errors"), F.count_if("anew").alias("read"))
    return checkpointed(files).where("NOT error").drop("error", "anew")


def build_index(files: DataFrame, counted: Observation | None = None) -> Graph:
    """The graph of files(path, content, language); rows without text are left out. counted: see read_once."""
    files = checkpointed(numbered_files(read_once(files, counted=counted)))
    nodes, contains, refs = extract_tables(files)
    return with_resolved(nodes, contains, refs, files.select("path", "content", "content_hash"))


def updated(g: Graph, files: DataFrame, counted: Observation | None = None) -> tuple[Graph, Layer]:
    """The graph after a new listing, and what is new in it.

    Only new and changed files are read again, files that are gone leave the graph, unchanged symbols keep their ids. Of the
    references in other files only those to names that came or went are resolved again: no other can find another target.
    Edges of files without such references stay as they are. The result says the same as a full build.
    """
    files = read_once(files, g.sources, counted)
    state = checkpointed(changed_files(files, g.sources))
    redo = state.where("state IN ('added', 'changed')").select("path")
    known = g.nodes.where("kind = 'file'").select(F.col("file_path").alias("path"), (F.col("id") / ROOM).cast("long").alias("seq"))
    fresh = files.join(redo, "path", "left_semi").select("path", "content", "content_hash", "language")
    most = known.agg(F.max("seq")).first()[0]
    new = numbered_files(fresh.join(known, "path", "left_anti"), 0 if most is None else most + 1)
    changed = checkpointed(fresh.join(known, "path").select(*fresh.columns, "seq").unionByName(new.select(*fresh.columns, "seq")))
    columns = [c.split()[0] for c in NODES.split(", ")]
    nodes, contains, refs = extract_tables(changed)
    nodes = nodes.select(columns)
    moved = state.where("state <> 'same'").select("path")
    replaced = checkpointed(moved.join(known, "path", "left").join(changed.select("path", F.col("seq").alias("new_seq")), "path", "left").select(F.col("path").alias("file_path"), F.coalesce("seq", "new_seq").alias("seq")))
    stay = lambda t: t.join(replaced.select("file_path"), "file_path", "left_anti")
    all_nodes, all_refs = stay(g.nodes).select(columns).unionByName(nodes), stay(g.refs).unionByName(refs)
    names = checkpointed(touched_names(g.nodes.join(replaced.select("file_path"), "file_path", "left_semi"), nodes))
    again = checkpointed(references_to(stay(g.refs), names))
    found = resolve_some(all_nodes, again.unionByName(refs)).drop("ref_id")
    # in files with a reference that is resolved again all edges are numbered anew
    others = again.select("file_path").distinct()
    renumbered = checkpointed(replaced.select("file_path").union(others).distinct())
    old_targets = g.nodes.join(names, "name", "left_semi").select(F.col("id").alias("target_id"))
    kept = g.edges.join(others, "file_path", "left_semi").select(contains.columns)
    kept = stay(kept.where("kind = 'contains'").unionByName(kept.where("kind <> 'contains'").join(old_targets, "target_id", "left_anti").select(contains.columns)))
    edges = checkpointed(numbered_edges(kept.unionByName(contains).unionByName(found)))
    all_edges = g.edges.join(renumbered, "file_path", "left_anti").select(edges.columns).unionByName(edges)
    texts = changed.select("path", "content", "content_hash")
    rows = Graph(nodes, edges, refs, texts)
    sources = g.sources.join(moved, "path", "left_anti").unionByName(texts)
    return Graph(all_nodes, all_edges, all_refs, sources), Layer(replaced, renumbered, rows)


def update_index(g: Graph, files: DataFrame, counted: Observation | None = None) -> Graph:
    """The graph after a new listing; see updated."""
    return updated(g, files, counted)[0]


def update_files(g: Graph, listed: DataFrame, paths: list[str], counted: Observation | None = None) -> Graph:
    """The graph after these files alone are read again from a listing; those that are gone leave it."""
    given = g.nodes.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    known = g.nodes.where("kind = 'file'").select(F.col("file_path").alias("path"), "language")
    columns = ["path", "content", "content_hash", "language"]
    others = g.sources.join(given, "path", "left_anti").join(known, "path").select(columns)
    # the hash of what stays is that of the index, and of the given files that of the listing or none
    stale = replace(g, sources=others.select("path", "content", "content_hash").unionByName(g.sources.join(given, "path", "left_semi").select("path", "content", F.lit("").alias("content_hash"))))
    return update_index(stale, others.unionByName(listed.join(given, "path", "left_semi").select(columns)), counted)


def _store(spark: SparkSession, path: str):
    """The Hadoop file system and path of a URI."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files that name a version, oldest first."""
    store, at = _store(spark, folder)
    if not store.exists(at):
        return []
    return sorted(n for s in store.listStatus(at) if (n := s.getPath().getName()).startswith("current-"))


def published(spark: SparkSession, folder: str) -> str | None:
    """The current version's name; none before the first was published."""
    found = _pointers(spark, folder)
    return spark.read.text(f"{folder}/{found[-1]}").first()[0] if found else None


class Conflict(OSError):
    """Another version was published since the one that an update builds on."""


def _write(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    store, at = _store(spark, path)
    out = store.create(at, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def _point(spark: SparkSession, folder: str, version: str, base: str | None = None) -> str:
    """Makes a version the current one: its number is claimed by a file that only one publisher can create, then the pointer
    appears by one renaming. base: the version that must still be current."""
    from py4j.protocol import Py4JJavaError

    store, _ = _store(spark, folder)
    while True:
        before = _pointers(spark, folder)
        number = int(before[-1].split("-")[1]) + 1 if before else 0
        claims = [int(s.getPath().getName().split("-")[1]) for s in store.listStatus(_store(spark, folder)[1]) if s.getPath().getName().startswith("claim-")]
        number = max([number, *(c + 1 for c in claims)])
        if base is not None and published(spark, folder) != base:
            raise Conflict(f"{base} is not the current version any more")
        try:
            _write(spark, f"{folder}/claim-{number:012d}", version, overwrite=False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                continue  # another publisher has it
            raise
        if base is not None and published(spark, folder) != base:
            raise Conflict(f"{base} is not the current version any more")
        _write(spark, f"{folder}/.{version}", version)
        if not store.rename(_store(spark, f"{folder}/.{version}")[1], _store(spark, f"{folder}/current-{number:012d}-{version}")[1]):
            raise OSError(f"the pointer to {version} could not be written")
        return version


def _write_tables(g: Graph, folder: str) -> None:
    for name in TABLES:
        table = getattr(g, name)
        if table is None:
            continue
        if name in SORTED:
            write_sorted(table, f"{folder}/{name}", *SORTED[name])
        else:
            table.write.parquet(f"{folder}/{name}")


def publish(g: Graph, folder: str) -> str:
    """Writes the tables, and the indexes of names and texts, to a new version below folder and then makes it the current one."""
    spark = g.nodes.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    postings, totals = semantic_index(g)
    _write_tables(replace(g, postings=postings, totals=totals, names=name_places(g.nodes)), f"{folder}/{version}")
    return _point(spark, folder, version)


def publish_layer(layer: Layer, folder: str, base: str) -> str:
    """Writes what an update of the version base changes, and makes base with it the current version; a Conflict if base isn't current.

    Postings and places of names follow the symbols of a file; totals hold what the update adds to the numbers of all.
    """
    spark = layer.replaced.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    before = current(spark, folder, base)
    gone = before.nodes.join(layer.replaced.select("file_path"), "file_path", "left_semi")
    postings, plus = semantic_index(layer.rows)
    _, minus = semantic_index(replace(before, nodes=gone))
    signed = plus.select("n", F.coalesce("total", F.lit(0)).alias("total")).unionByName(minus.select((-F.col("n")).alias("n"), (-F.coalesce("total", F.lit(0))).alias("total")))
    totals = signed.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    _write_tables(replace(layer.rows, postings=postings, totals=totals, names=name_places(layer.rows.nodes)), f"{folder}/{version}")
    layer.replaced.write.parquet(f"{folder}/{version}/replaced")
    layer.renumbered.write.parquet(f"{folder}/{version}/renumbered")
    _write(spark, f"{folder}/{version}/base", base)
    return _point(spark, folder, version, base)


def layers(spark: SparkSession, folder: str, version: str) -> list[str]:
    """The versions that a version is made of: a whole one, then updates."""
    chain = [version]
    while True:
        store, at = _store(spark, f"{folder}/{chain[0]}/base")
        if not store.exists(at):
            return chain
        chain.insert(0, spark.read.text(f"{folder}/{chain[0]}/base").first()[0])


def current(spark: SparkSession, folder: str, version: str | None = None) -> Graph:
    """The graph of the current version, or of the one given: a whole version, less what each update replaces, with its rows."""
    version = version or published(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no index is published in {folder}")
    tables: dict[str, DataFrame | None] = {}
    for part in layers(spark, folder, version):
        read = lambda name: spark.read.parquet(f"{folder}/{part}/{name}")  # noqa: B023, E731
        there = {name for name in TABLES if _store(spark, f"{folder}/{part}/{name}")[0].exists(_store(spark, f"{folder}/{part}/{name}")[1])}
        if not tables:
            tables = {name: read(name) if name in there else None for name in TABLES}
            continue
        replaced, renumbered = read("replaced"), read("renumbered")
        for name in there:
            old, new = tables[name], read(name)
            if name == "totals":
                tables[name] = old.unionByName(new).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
                continue
            if name in SORTED:
                seq = F.shiftright("block", 24 - BLOCK) if name == "postings" else F.shiftright("id", 24)
                old = old.withColumn("seq", seq).join(replaced.select("seq"), "seq", "left_anti").drop("seq")
            elif name == "sources":
                old = old.join(replaced.select(F.col("file_path").alias("path")), "path", "left_anti")
            else:
                old = old.join(renumbered if name == "edges" else replaced.select("file_path"), "file_path", "left_anti")
            tables[name] = old.unionByName(new)
    return Graph(**tables)


def refresh(spark: SparkSession, folder: str, files: DataFrame | Callable[[Graph | None], DataFrame], most_layers: int = 8) -> str:
    """Publishes the state of a listing: what changed as a layer, or all anew where there is nothing yet or many layers are.

    files may be a function that gives the listing for the current graph (none before the first). Begins again if another
    version was published meanwhile. Where nothing changed the current version stays.
    """
    listing = files if callable(files) else lambda _: files
    while True:
        base = published(spark, folder)
        if base is None:
            return publish(build_index(listing(None)), folder)
        before = current(spark, folder, base)
        g, layer = updated(before, listing(before))
        if layer.replaced.isEmpty():
            return base
        try:
            if len(layers(spark, folder, base)) < most_layers:
                return publish_layer(layer, folder, base)
            return publish(g, folder)
        except Conflict:
            continue


def prune(spark: SparkSession, folder: str, keep: int = 2, days: float | None = None, grace: float = 86400.0) -> int:
    """Deletes all but the newest versions below folder, and of these such as are older than days; never the current one or
    what it is made of. Folders that no pointer names are being written: they go when nothing in them changed for grace seconds.
    Returns how many versions went."""
    import time

    store, at = _store(spark, folder)
    pointers = _pointers(spark, folder)
    named = [p.split("-", 2)[2] for p in pointers]
    age = lambda path: time.time() - max([store.getFileStatus(path).getModificationTime(), *(s.getModificationTime() for s in store.listStatus(path))]) / 1000
    young = [v for p, v in zip(pointers, named, strict=True) if days is None or time.time() - store.getFileStatus(_store(spark, f"{folder}/{p}")[1]).getModificationTime() / 1000 <= days * 86400]
    top = [v for v in named[-max(keep, 1) :] if v in young or v == named[-1]]
    stay = {part for v in top for part in layers(spark, folder, v)}
    for p, version in zip(pointers, named, strict=True):
        if version not in top:
            store.delete(_store(spark, f"{folder}/{p}")[1], False)
    unnamed = [s.getPath() for s in store.listStatus(at) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in stay]
    old = [path for path in unnamed if path.getName() in named or age(path) > grace]
    for path in old:
        store.delete(path, True)
    return len(old)


def compact(spark: SparkSession, folder: str, file_bytes: int = 128 << 20) -> str:
    """Publishes the current version again, whole and in files of about this size."""
    version = published(spark, folder)
    g, parts = current(spark, folder), layers(spark, folder, version)
    tables = {}
    for name in TABLES:
        if (t := getattr(g, name)) is not None:
            size = sum(store.getContentSummary(at).getLength() for part in parts for store, at in [_store(spark, f"{folder}/{part}/{name}")] if store.exists(at))
            tables[name] = t.coalesce(max(1, -(-size // file_bytes)))
    return publish(Graph(**tables), folder)


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """Size of the current version, with what it is made of."""
    version, total = published(spark, folder), 0
    for part in layers(spark, folder, version) if version else []:
        store, at = _store(spark, f"{folder}/{part}")
        total += store.getContentSummary(at).getLength()
    return total


def run_counters(g: Graph, counted: Observation) -> DataFrame:
    """name, count of the run that made g: files, nodes, edges, skipped (files as they were), errors (no UTF-8 text), resolved_refs.

    What was seen on the way is told as it was then; nothing is listed or read again.
    """
    seen = counted.get
    kinds = g.nodes.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count("*").alias("nodes"))
    edges = g.edges.agg(F.count("*").alias("edges"), F.count_if(~F.col("kind").isin("contains", "tests")).alias("resolved_refs"))
    told = {"errors": seen["errors"], "skipped": seen["listed"] - seen["errors"] - seen["read"]}
    pairs = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("count")) for c in df.columns))).alias("x")).select("x.*")
    return pairs(kinds).unionByName(pairs(edges)).unionByName(g.nodes.sparkSession.createDataFrame(list(told.items()), "name string, count long"))
