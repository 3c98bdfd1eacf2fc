"""Session helpers: table access and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only in local mode a temporary folder may stand in; a cluster must name the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="reportloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of executors and is computed once, where an eager
    checkpoint computes its last stage twice. ``drop`` frees a table that a later one
    has replaced.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"
        self.written = 0

    def save(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` and return the table read back, with its path."""
        path = f"{self.root}/{self.written}"
        self.written += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back."""
        return self.save(df)[0]

    def drop(self, path: str) -> None:
        """Delete a table written before."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, once for each Spark application.

    The package goes as a zip into the shared folder and from there to every executor.
    """
    context = spark.sparkContext
    if getattr(context, "_reportloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    target = f"{shared_dir(spark)}/reportloom-{uuid.uuid4().hex[:12]}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(target)
    context._reportloom_shipped = True
