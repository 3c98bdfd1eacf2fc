"""Splits and samples by hash: the same rows on every run and in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.operators.retrieval import draw


def group_split(rows: DataFrame, group: str, seed: int, train: float = 0.8) -> DataFrame:
    """Adds split: whole groups go to train, val and test.

    Groups are ranked by hash: the first floor(train * G) are train, of the rest the first
    floor(half) val. The ranking runs over distinct groups in two steps, by hash range and
    within it, so no task holds all of them.
    """
    groups = rows.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_d", draw(F.lit(seed), F.col(group)))
    cells = groups.withColumn("_cell", F.floor(F.col("_d") / (1 << 22)))
    sizes = cells.groupBy("_cell").agg(F.count("*").alias("_c"))  # at most 1024 cells
    ahead = Window.partitionBy(F.lit(1)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).withColumn("_all", F.sum("_c").over(Window.partitionBy(F.lit(1))))
    inside = Window.partitionBy("_cell").orderBy("_d", group)
    placed = cells.join(F.broadcast(sizes), "_cell").withColumn("_i", F.col("_before") + F.row_number().over(inside) - 1)  # 1024 rows
    cut = F.floor(F.col("_all") * train)
    half = cut + F.floor((F.col("_all") - cut) * 0.5)
    split = F.when(F.col("_i") < cut, "train").when(F.col("_i") < half, "val").otherwise("test")
    return rows.join(placed.select(group, split.alias("split_new")), group)


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """(group, splits): groups that occur in more than one split; empty if there is no leak."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def per_stratum(rows: DataFrame, strata: str, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each stratum by hash."""
    order = Window.partitionBy(strata).orderBy(draw(F.lit(seed), F.col(key)), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def two_strata(rows: DataFrame, first: str, key: str, n: int, share: float, seed: int) -> DataFrame:
    """``n`` rows, ``share`` of them from the rows where ``first`` holds; a stratum too small leaves its rest to the other."""
    marked = rows.withColumn("_s", F.coalesce(F.col(first), F.lit(False)))
    have = marked.agg(F.count_if("_s").alias("_yes"), F.count_if(~F.col("_s")).alias("_no"))
    want = int(n * share)
    yes = F.least(F.greatest(F.lit(want), F.lit(n) - F.col("_no")), F.col("_yes"))
    no = F.least(F.greatest(F.lit(n - want), F.lit(n) - F.col("_yes")), F.col("_no"))
    order = Window.partitionBy("_s").orderBy(draw(F.lit(seed), F.col(key)), key)
    placed = marked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).crossJoin(F.broadcast(have))  # one row
    return placed.where(F.col("_n") <= F.when(F.col("_s"), yes).otherwise(no)).drop("_s", "_n", "_yes", "_no")


def prompt_split(rows: DataFrame, prompt: str, share: float, seed: int) -> DataFrame:
    """Adds is_eval: floor(share of the different prompts), one at least, go to evaluation with all their rows.

    Null prompts are one prompt. Prompts are ranked by hash, within hash ranges, so no task holds all.
    """
    prompts = rows.select(F.col(prompt).alias("_p")).distinct().withColumn("_d", draw(F.lit(seed), F.coalesce("_p", F.lit(""))))
    cells = prompts.withColumn("_cell", F.floor(F.col("_d") / (1 << 22)))
    sizes = cells.groupBy("_cell").agg(F.count("*").alias("_c"))  # at most 1024 cells
    whole = Window.partitionBy(F.lit(1))
    ahead = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_cell", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("_all"))
    inside = Window.partitionBy("_cell").orderBy("_d", "_p")
    placed = cells.join(F.broadcast(sizes), "_cell").withColumn("_i", F.col("_before") + F.row_number().over(inside))  # 1024 rows
    chosen = placed.where(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_all") * share))).select("_p", F.lit(True).alias("_e"))
    return rows.join(chosen, F.col(prompt).eqNullSafe(F.col("_p")), "left").withColumn("is_eval", F.coalesce("_e", F.lit(False))).drop("_p", "_e")
