"""The best N items of every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def latest_scored(
    items: DataFrame, group: str = "row_id", item: str = "candidate_index",
    score: str = "prefscore", at: str = "scored_at",
) -> DataFrame:
    """One row per (group, item): the score of its latest entry.

    Rows without a group are left out. A null time counts as the oldest. Of several entries
    of one time the scored one counts, then the higher score. NaN counts as no score. The
    aggregate combines before the shuffle, so a repeated item costs one row per task.
    """
    usable = F.when(~F.isnan(F.col(score)), F.col(score))
    return (
        items.select(group, item, F.struct(F.col(at).alias("at"), usable.alias("score")).alias("entry"))
        .where(F.col(group).isNotNull())
        .groupBy(group, item)
        .agg(F.max("entry").alias("entry"))
        .select(group, item, F.col("entry.score").alias("score"))
    )


def top_n(
    scored: DataFrame, n: int, group: str = "row_id", item: str = "candidate_index",
    score: str = "score", salts: int = SALTS,
) -> DataFrame:
    """The ``n`` highest scores of each group with their rank, ties to the smaller item.

    Groups are hashed into ``salts`` subgroups; each keeps its best ``n``, then the at most
    ``n * salts`` survivors of a group are ranked. Rows without a score are not ranked; a
    null item comes after all others of its score. An empty table gives an empty result.
    """
    order = (F.col(score).desc(), F.col(item).asc_nulls_last())
    salted = scored.where(F.col(score).isNotNull()).withColumn(
        "_salt", F.pmod(F.xxhash64(item), F.lit(salts)).cast("int")
    )
    inner = Window.partitionBy(group, "_salt").orderBy(*order)
    outer = Window.partitionBy(group).orderBy(*order)
    survivors = salted.withColumn("_rank", F.row_number().over(inner)).where(F.col("_rank") <= n)
    return (
        survivors.withColumn("rank", F.row_number().over(outer))
        .where(F.col("rank") <= n)
        .select(group, item, score, "rank")
    )
