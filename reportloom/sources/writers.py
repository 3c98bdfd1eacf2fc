"""Sinks: JSON lines, CSV, index tables, metadata, skip-if-done."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def config_key(config: dict) -> str:
    """Twelve hex digits that name a configuration."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path, compression="gzip")


def flat(rows: DataFrame, first: list[str]) -> DataFrame:
    """Preferred columns first, the others in the order of the alphabet; nested values as JSON."""
    order = [c for c in first if c in rows.columns] + sorted(c for c in rows.columns if c not in first)
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.select(*[F.to_json(c).alias(c) if isinstance(kinds[c], (ArrayType, MapType, StructType)) else F.col(c) for c in order])


def csv(rows: DataFrame, path: str, digits: int = 6, compression: str = "none", mode: str = "errorifexists") -> None:
    """CSV with a header, floating numbers with a fixed number of digits; nulls stay empty."""
    out = rows.select(*[F.when(F.col(f.name).isNotNull(), F.format_string(f"%.{digits}f", f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in rows.schema])
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path, compression=compression)


def done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written completely."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def table_once(rows: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written first unless it is complete already."""
    spark = rows.sparkSession
    if not done(spark, path):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def content_mark(rows: DataFrame) -> DataFrame:
    """(n, content_hash): row count and a hash that no order of rows changes."""
    total = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))  # a sum, as equal rows would cancel in an exclusive or
    return rows.agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0)).cast("decimal(38,0)").alias("content_hash"))


def with_metadata(rows: DataFrame, path: str, config: dict) -> None:
    """Write rows, and beside them one row with configuration, its key, count and content hash."""
    table = table_once(rows, f"{path}/data")
    note = content_mark(table).withColumn("config", F.lit(json.dumps(config, sort_keys=True))).withColumn("config_key", F.lit(config_key(config)))
    note.write.mode("overwrite").parquet(f"{path}/meta")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(n, content_hash, same): the table counted and hashed again, against its metadata."""
    meta = spark.read.parquet(f"{path}/meta").select(F.col("n").alias("_n"), F.col("content_hash").alias("_h"))
    again = content_mark(spark.read.parquet(f"{path}/data"))
    return again.crossJoin(meta).select("n", "content_hash", ((F.col("n") == F.col("_n")) & F.col("content_hash").eqNullSafe(F.col("_h"))).alias("same"))  # one row each


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextmanager
def exclusive(spark: SparkSession, path: str, stale_hours: float = 24.0) -> Iterator[None]:
    """Hold ``path.lock`` while a table is made; a lock younger than ``stale_hours`` raises FileExistsError."""
    fs, lock = _file_system(spark, f"{path.rstrip('/')}.lock")
    if fs.exists(lock):
        age = time.time() - fs.getFileStatus(lock).getModificationTime() / 1000
        if age <= 3600 * stale_hours:
            raise FileExistsError(str(lock))
        fs.delete(lock, False)
    fs.create(lock, False).close()  # fails if another writer was faster
    try:
        yield
    finally:
        fs.delete(lock, False)


def clear(spark: SparkSession, path: str) -> None:
    """Remove a table, its metadata and its lock."""
    for name in (path, f"{path.rstrip('/')}.lock"):
        fs, target = _file_system(spark, name)
        fs.delete(target, True)


def run_dir(spark: SparkSession, root: str, run: str = "auto") -> str:
    """The folder of a run: ``last`` (and ``auto`` if there is one) the run before, ``new`` one named by the time, else the run named."""
    fs, pointer = _file_system(spark, f"{root.rstrip('/')}/LAST_RUN")
    if run in ("last", "auto") and fs.exists(pointer):
        return spark.read.text(str(pointer)).first().value.strip()
    if run == "last":
        raise FileNotFoundError(str(pointer))
    path = run if "/" in run else f"{root.rstrip('/')}/{time.strftime('%Y%m%d-%H%M%S') if run in ('new', 'auto') else run}"
    fs.mkdirs(_file_system(spark, path)[1])
    out = fs.create(pointer, True)
    out.write(bytearray(path.encode()))
    out.close()
    return path


def index_once(spark: SparkSession, root: str, config: dict, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of an index, made and written below the key of its configuration unless they are there already."""
    path = f"{root.rstrip('/')}/{config_key(config)}"
    fs, marker = _file_system(spark, f"{path}/DONE")
    if not fs.exists(marker):
        for name, table in make().items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        fs.create(marker, True).close()
    names = [f.getPath().getName() for f in fs.listStatus(_file_system(spark, path)[1]) if f.isDirectory()]
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
