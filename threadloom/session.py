"""Sessions: the shared folder for written tables, and this package on Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir; one of its own only where that is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="spark-shared-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df written as Parquet, with the writer's options, in the shared folder and read back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers, once an application; not needed where they have it on their path."""
    package = Path(__file__).resolve().parent
    root = str(package.parent)
    there = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in there or os.getcwd() == root or app in _shipped:
        return spark
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
    return spark
