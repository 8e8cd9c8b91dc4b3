"""History of a working tree, from git: churn, changed regions and blame. The parsing is done on DataFrames."""

from __future__ import annotations

import re
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .paths import relative_path

REF = re.compile(r"[A-Za-z0-9_\-./~^:@]+")


def checked_ref(ref: str) -> str:
    """A git revision that can't be taken for an option."""
    if not REF.fullmatch(ref) or ref.startswith("-"):
        raise ValueError(f"not a git revision: {ref!r}")
    return ref


def git_lines(spark: SparkSession, root: str, *args: str) -> DataFrame:
    """part, line_no, value of git's output, which streams into a file of the shared folder; parts are its blocks."""
    path = f"{shared_dir(spark)}/git-{uuid.uuid4().hex}.txt"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    with subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE) as run:
        while piece := run.stdout.read(1 << 20):
            out.write(bytearray(piece))
    out.close()
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, run.args)
    # in a block, lines come in order
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line_no"), "value")


def churn_of(lines: DataFrame) -> DataFrame:
    """path, commits from lines of names."""
    return lines.where(F.trim("value") != "").groupBy(F.trim("value").alias("path")).agg(F.count("*").alias("commits"))


def file_churn(spark: SparkSession, root: str, days: int = 90, path: str | None = None) -> DataFrame:
    limit = ["--", relative_path(path)] if path else []
    return churn_of(git_lines(spark, root, "log", "--name-only", "--pretty=format:", f"--since={int(days)}.days.ago", *limit))


def hunk_regions(lines: DataFrame) -> DataFrame:
    """file_path, first, last of the new side of each hunk of a diff without context (part, line_no, value).

    Lines go by part, then line_no; each part begins with the file at the end of the one before, so that parts are read
    side by side. A hunk that adds nothing marks its line; deleted files and line 0 are left out.
    """
    file = F.when(F.col("value").startswith("+++ "), F.regexp_extract("value", r"^\+\+\+ b/(.*)$", 1))
    so_far = Window.partitionBy("part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = lines.withColumn("f", file).groupBy("part").agg(F.max_by("f", F.when(F.col("f").isNotNull(), F.col("line_no"))).alias("f"))  # a row for each part
    begins = ends.select("part", F.last("f", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("begin"))
    lines = lines.join(begins, "part")
    start = F.regexp_extract("value", r"^@@ -\S+ \+(\d+)", 1)
    n = F.regexp_extract("value", r"^@@ -\S+ \+\d+,(\d+)", 1)
    hunks = lines.withColumn("file_path", F.coalesce(F.last(file, ignorenulls=True).over(so_far), "begin")).where(start != "").select("file_path", start.cast("int").alias("first"), F.when(n == "", 1).otherwise(F.try_to_number(n, F.lit("999999999")).cast("int")).alias("n"))
    return hunks.where((F.col("file_path") != "") & (F.col("first") > 0)).select("file_path", "first", F.when(F.col("n") == 0, F.col("first")).otherwise(F.col("first") + F.col("n") - 1).cast("int").alias("last"))


def changed_regions(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    return hunk_regions(git_lines(spark, root, "diff", "--unified=0", checked_ref(ref), "--"))


def blame(root: str, path: str, first: int, last: int) -> str:
    return subprocess.run(["git", "-C", root, "blame", "-L", f"{int(first)},{int(last)}", "--date=short", "--", relative_path(path)], capture_output=True, text=True, check=True).stdout
