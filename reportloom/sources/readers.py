"""Sources: reports, splits, JSON lines, candidate pools, word lists, tables with synonym headers, metadata."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def report_columns(rows: DataFrame, given: str, truth: str, keep: list[str] | None = None) -> DataFrame:
    """Project to the named columns, each once; a missing one raises KeyError."""
    wanted = list(dict.fromkeys([given, truth, *(keep or [])]))
    missing = [c for c in wanted if c not in rows.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return rows.select(*(["row_id"] if "row_id" in rows.columns and "row_id" not in wanted else []), *wanted)


def csv(spark: SparkSession, path: str | list[str], schema: str | StructType | None = None, sep: str = ",") -> DataFrame:
    """Comma or tab separated rows with a header and quoted line breaks; with a schema no inference."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: str | StructType, parts: int | None = None) -> DataFrame:
    """One JSON object per line, blank lines skipped. gz files can't be split, so ``parts`` spreads the rows."""
    rows = spark.read.schema(schema).option("allowNonNumericNumbers", True).json(path)
    return rows.repartition(parts) if parts else rows


def metadata(spark: SparkSession, root: str, schema: str | StructType, glob: str = "*.meta.json") -> DataFrame:
    """All metadata files below ``root`` with their path."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(root)
    return rows.withColumn("meta_path", F.input_file_name())


def split_table(spark: SparkSession, paths: dict[str, str], schema: str | StructType) -> DataFrame | None:
    """The splits' files as one table with a split column; None unless all of them exist."""
    if paths and not all(exists(spark, p) for p in paths.values()):
        return None
    out = None
    for name, path in sorted(paths.items()):
        part = csv(spark, path, schema).withColumn("row_id", F.col("row_id").cast("bigint")).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no split files")
    return out


def word_list(rows: DataFrame, column: str = "word") -> DataFrame:
    """Distinct lower-cased words without nulls."""
    return rows.where(F.col(column).isNotNull()).select(F.lower(F.col(column).cast("string")).alias("word")).distinct()


def with_synonyms(rows: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rename headers to canonical names, regardless of case and outer blanks; the first match of a name counts."""
    have = {c.strip().lower(): c for c in reversed(rows.columns)}
    renames = {}
    for name, spellings in names.items():
        hit = next((have[s.lower()] for s in (name, *spellings) if s.lower() in have), None)
        if hit is not None and hit != name:
            renames[hit] = name
    return rows.withColumnsRenamed(renames)


def candidate_text(generated: str = "gen_text", stored: str = "candidate_text") -> Column:
    """The generated text if there is one, else the stored candidate's, else empty."""
    return F.coalesce(F.col(generated), F.col(stored), F.lit(""))


def pool_score(components: str = "components.PrefScore", top: str = "pref_score") -> Column:
    """Preference score of a candidate from its components, else the top level, else zero."""
    return F.coalesce(F.col(components), F.col(top), F.lit(0.0))


def context_of_file(pattern: str, group: int = 1) -> Column:
    """What the file name tells about its rows."""
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, group)


def non_contiguous(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Keys whose rows don't lie together in the order of ``position``; empty if all do."""
    from pyspark.sql import Window

    spread = rows.groupBy(key).agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.count("*").alias("n"))
    within = Window.partitionBy(key)
    return spread.where(F.col("hi") - F.col("lo") + 1 > F.col("n")).select(key, F.max("n").over(within).alias("n"))


def _files(spark: SparkSession, pattern: str) -> list:
    """File states (path, time of the last change) that match a glob."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or [])


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_files(spark, path))


def expanded(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths that match any of the globs, each once, in the order of the alphabet; none raises FileNotFoundError."""
    found = sorted({str(f.getPath()) for p in patterns for f in _files(spark, p)})
    if not found:
        raise FileNotFoundError(f"no files match {patterns}")
    return found


def newest_with(spark: SparkSession, pattern: str, wanted: dict[str, object]) -> str | None:
    """The artifact last changed among those whose metadata table agrees with ``wanted``, or None.

    An artifact is a folder with a one-row table ``meta`` that has its configuration as JSON.
    """
    for f in sorted(_files(spark, pattern), key=lambda f: -f.getModificationTime()):
        path = str(f.getPath())
        if not exists(spark, f"{path}/meta/_SUCCESS"):
            continue
        config = json.loads(spark.read.parquet(f"{path}/meta").select("config").first().config)
        if all(config.get(k) == v for k, v in wanted.items()):
            return path
    return None
