"""The project's tables as the operators take them, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.session import table


def newest(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row per key: its latest; of equal times the one with the greater content."""
    r = F.max_by(F.struct(*columns), F.struct(F.col(at), F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"))))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(r.alias("r")).select(key, "r.*")


def reports(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, input_text, gt_text, split, source, author): each report once."""
    rows = newest(table(spark, d, "splits"), "row_id", "loaded_at", ["new_llama_output", "text", "split", "source", "author"])
    return rows.withColumnsRenamed({"new_llama_output": "input_text", "text": "gt_text"})


def sheet(spark: SparkSession, d: str) -> DataFrame:
    """(sheet_id, row_id, model, adapter_type, condition_id, input_text, gen_text): each generated answer once."""
    columns = ["row_id", "model", "adapter_type", "condition_id", "input_text", "gen_text"]
    return newest(table(spark, d, "annotation_sheet"), "sheet_id", "generated_at", columns)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate of a prompt once, by its latest scoring; NaN scores are null."""
    columns = ["model", "pref_profile", "align_context", "k", "candidate_rank", "candidate_text", "resp_tokens", "score", "cond", "ua"]
    rows = table(spark, d, "candidates").select(
        "*", F.when(~F.isnan("prefscore"), F.col("prefscore")).alias("score"), F.col("condfilledrate").alias("cond"), F.col("uahe_per_1ktok").alias("ua")
    )
    r = F.max_by(F.struct(*columns), F.struct(F.col("scored_at"), F.coalesce("score", F.lit(-1.0))))
    return rows.where("row_id is not null").groupBy("row_id", "candidate_index").agg(r.alias("r")).select("row_id", "candidate_index", "r.*")


REPORTS = """reports AS (
  SELECT row_id, new_llama_output AS input_text, text AS gt_text, split, source, author FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST,
      md5(concat_ws('|', new_llama_output, text, split, source, author)) DESC) AS age FROM splits WHERE row_id IS NOT NULL) WHERE age = 1)"""
SHEET = """sheet AS (
  SELECT sheet_id, row_id, model, adapter_type, condition_id, input_text, gen_text FROM (
    SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY generated_at DESC NULLS LAST,
      md5(concat_ws('|', row_id::VARCHAR, model, adapter_type, condition_id, input_text, gen_text)) DESC) AS age
    FROM annotation_sheet WHERE sheet_id IS NOT NULL) WHERE age = 1)"""
CANDIDATES = """cand AS (
  SELECT row_id, candidate_index, model, pref_profile, align_context, k, candidate_rank, candidate_text, resp_tokens, score, cond, ua FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id, candidate_index ORDER BY scored_at DESC NULLS LAST, coalesce(score, -1) DESC) AS age
    FROM (SELECT *, CASE WHEN isnan(prefscore) THEN NULL ELSE prefscore END AS score, condfilledrate AS cond, uahe_per_1ktok AS ua
          FROM candidates WHERE row_id IS NOT NULL)) WHERE age = 1)"""
