"""Scan of a source tree as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tree import Store, register

# What is indexed and what is not.
EXCLUDED = ("node_modules", "target", "dist", "build", ".git", "__pycache__", ".venv", "venv", "vendor")
EXTENSIONS = tuple("rs ts tsx js jsx py go java c h cpp cc hpp cs kt kts scala rb groovy".split())
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "py": "python", "pyi": "python", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "groovy": "groovy", "gradle": "groovy",
}
MANIFEST_LANGUAGES = {
    "package.json": "javascript", "Cargo.toml": "rust", "go.mod": "go", "pyproject.toml": "python", "requirements.txt": "python", "Gemfile": "ruby", "composer.json": "php", "pom.xml": "java",
    "build.gradle": "groovy", "build.gradle.kts": "kotlin", "build.sbt": "scala",
}
MANIFESTS = tuple(MANIFEST_LANGUAGES)
SOURCE_EXTENSIONS = tuple(
    """c h cpp cc cxx c++ hpp hxx hh cs rs go zig d nim v cu cuh java kt kts scala sc groovy clj cljs cljc vb fs fsx py pyi pyw rb rake
php phtml pl pm lua tcl r jl dart ex exs erl hrl cr js jsx mjs cjs ts tsx mts cts coffee hs lhs ml mli elm rkt scm lisp el swift m mm
sh bash zsh fish ps1 sql pas f90 f95 f03 for""".split()
)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, if that isn't its first character."""
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)


def language(path: Column) -> Column:
    by_extension, by_name = (F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) for table in (LANGUAGES, MANIFEST_LANGUAGES))
    return F.coalesce(F.element_at(by_name, file_name(path)), F.element_at(by_extension, F.lower(extension(path))), F.lit("unknown"))


def indexed(path: Column, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a relative path is indexed: no part excluded, and a manifest or of a known extension."""
    kind = file_name(path).isin(*MANIFESTS) | (extension(path).isin(*extensions) if extensions else F.lit(True))
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, excluded))) & kind


def unsupported_types(paths: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """ext, count of source files that aren't indexed for their type."""
    ext = F.lower(extension(F.col("path")))
    hit = ext.isin(*SOURCE_EXTENSIONS) & ~ext.isin(*extensions)
    return paths.where(hit).groupBy(ext.alias("ext")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "ext")


def list_tree(spark: SparkSession, root: str, git_ignore: bool = True, excluded: tuple[str, ...] = EXCLUDED, parts: int = 64) -> DataFrame:
    """path (relative), size, modified of every file below root, hidden ones too; nothing is opened, and excluded folders aren't entered.

    With git_ignore, what .gitignore files say counts where root is in a working tree.
    """
    read = register(spark).read.format("tree").option("gitignore", str(git_ignore).lower()).option("excluded", "/".join(excluded)).option("parts", parts)
    return read.load(root.rstrip("/"))


def scan_tree(spark: SparkSession, root: str, git_ignore: bool = True, wanted: Column | None = None, excluded: tuple[str, ...] = EXCLUDED, opened=None) -> DataFrame:
    """path (relative), content (text), content_hash, language, size, modified_at of the files of list_tree; bad UTF-8: null text.

    wanted: a condition on path and size; only files that meet it are opened. opened: an accumulator that counts them.
    """
    root = root.rstrip("/")
    files = list_tree(spark, root, git_ignore, excluded)
    files = files if wanted is None else files.where(wanted)
    # folders hold unlike numbers of files: names are dealt anew before texts are read
    files = files.repartition("path").select("path", "size", F.unix_timestamp("modified").alias("modified_at"))

    def read(record_batches):
        import pyarrow as pa

        store = Store(root)
        for rb in record_batches:
            for at in range(0, rb.num_rows, 64):
                part = rb.slice(at, 64)
                texts = [store.read(p) for p in part.column(0).to_pylist()]
                if opened is not None:
                    opened.add(len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "bytes"])

    files = files.mapInArrow(read, "path string, size long, modified_at long, bytes binary")
    text = F.when(F.is_valid_utf8("bytes"), F.decode("bytes", "UTF-8"))
    return files.select("path", text.alias("content"), "size", "modified_at").withColumn("content_hash", F.sha2("content", 256)).withColumn("language", language(F.col("path")))


def scan_signature(spark: SparkSession, root: str) -> tuple[int, int, str]:
    """Number of files, their size and newest modification: a cheap sign of change. Nothing is opened."""
    r = list_tree(spark, root).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.max("modified").cast("string").alias("newest")).first()
    return r.n, r.size, r.newest
