"""Preference pairs from scored candidates: three selection rules, threshold sweeps, audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportloom.functions.text import strip

#: Place of a candidate without rank or index: behind all others.
LAST = 1_000_000_000


@dataclass(frozen=True)
class Policy:
    """Thresholds of a selection. A cap below zero is off."""

    quality_floor: float = 0.0
    margin: float = 0.05
    uahe_cap: float = -1.0
    min_cond: float = 0.6
    min_sec: float = 0.0
    uahe_order: bool = False
    pairs: int = 2


#: The published policies of the profiles.
POLICIES = {
    "balanced": Policy(), "structure": Policy(), "hard": Policy(margin=0.03, uahe_cap=0.0, uahe_order=True),
}
#: The grid of the sweep.
GRID = {
    "margin": (0.01, 0.03, 0.05, 0.07, 0.10, 0.15), "quality_floor": (0.0, 0.1, 0.2, 0.3, 0.4, 0.5),
    "uahe_cap": (-1.0, 0.0, 1.0, 2.0, 5.0), "min_cond": (0.0, 0.3, 0.5, 0.6, 0.8),
}


def ranked(candidates: DataFrame, by_rank: bool = False) -> DataFrame:
    """Candidates with their place in the prompt: score descending, then index; on request the stored rank first."""
    order = [F.desc("score"), F.asc("candidate_index")]
    if by_rank:
        order.insert(0, F.asc_nulls_last("candidate_rank"))
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("row_id").orderBy(*order)))


def usable(candidates: DataFrame) -> DataFrame:
    """The candidates as the selection rules see them.

    Rows without prompt are left out. A missing or NaN score, rate or filled share counts as
    zero, a missing condition share as the filled share (``sec``, if there is one), a missing
    text as empty; texts are compared without outer white space.
    """
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    sec = number("sec") if "sec" in candidates.columns else F.lit(None).cast("double")
    return candidates.where("row_id is not null").select(
        "row_id", F.coalesce("candidate_index", F.lit(LAST)).alias("candidate_index"), F.coalesce("candidate_rank", F.lit(LAST)).alias("candidate_rank"),
        F.coalesce(number("score"), F.lit(0.0)).alias("score"), F.coalesce(number("ua"), F.lit(0.0)).alias("ua"),
        F.coalesce(number("cond"), sec, F.lit(0.0)).alias("cond"), F.coalesce(sec, F.lit(0.0)).alias("sec"),
        strip(F.coalesce("candidate_text", F.lit(""))).alias("candidate_text"),
    )


def best_rows(candidates: DataFrame, by_rank: bool = False) -> DataFrame:
    """The first usable candidate of each prompt, by an aggregate that combines before the shuffle."""
    key = [F.col("score"), -F.col("candidate_index")]
    if by_rank:
        key.insert(0, -F.col("candidate_rank"))
    return candidates.groupBy("row_id").agg(
        F.max_by(F.struct("candidate_index", "score", "ua", "cond", "sec", "candidate_text"), F.struct(*key)).alias("best"),
        F.count("*").alias("candidates"),
    )


def mine(candidates: DataFrame, policy: Policy, rule: str = "remine") -> DataFrame:
    """(row_id, reason, pair_no, chosen_index, rejected_index, chosen_score, rejected_score).

    ``candidates`` has row_id, candidate_index, candidate_rank, score, ua, cond, candidate_text
    and perhaps sec. ``rule`` is mine, remine or sweep, which differ in order, cap, margin and
    repetition. One row for each pair, or one without pair and with the reason. Candidates are
    rejected from the last place of the order on.
    """
    rows = usable(candidates)
    by_rank = rule == "remine"
    first = best_rows(rows, by_rank)
    capped = policy.uahe_cap > 0 if rule == "mine" else policy.uahe_cap >= 0
    reason = F.when(F.col("best.score") < policy.quality_floor, "below_quality_floor")
    if capped:
        reason = reason.when(F.col("best.ua") > policy.uahe_cap, "uahe_cap")
    if policy.min_cond > 0:
        reason = reason.when(F.col("best.cond") < policy.min_cond, "min_cond")
    if policy.min_sec > 0 and by_rank:
        reason = reason.when(F.col("best.sec") < policy.min_sec, "min_sec")
    first = first.withColumn("reason", reason.otherwise("ok"))
    slack = 1e-12 if by_rank else 0.0
    rest = rows.join(first.where("reason = 'ok'").select("row_id", "best"), "row_id")
    fine = rest.where(
        (F.col("candidate_index") != F.col("best.candidate_index"))
        & (F.col("best.score") - F.col("score") + slack >= policy.margin)
        & (F.col("candidate_text") != F.col("best.candidate_text"))
    )
    if policy.uahe_order or rule == "sweep":
        fine = fine.where(F.col("ua") >= F.col("best.ua"))
    worst = [F.asc("score"), F.desc("candidate_index")]
    if by_rank:  # not empty, and each text once
        worst.insert(0, F.desc("candidate_rank"))
        fine = fine.where("candidate_text <> ''")
        once = Window.partitionBy("row_id", "candidate_text").orderBy(*worst)
        fine = fine.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    wanted = 1 if rule == "sweep" else max(1, policy.pairs)
    picked = fine.withColumn("pair_no", F.row_number().over(Window.partitionBy("row_id").orderBy(*worst))).where(F.col("pair_no") <= wanted)
    picked = picked.select("row_id", "pair_no", F.col("candidate_index").alias("rejected_index"), F.col("score").alias("rejected_score"))
    out = first.join(picked, "row_id", "left")
    none = "no_valid_reject" if rule == "sweep" else "no_reject"
    paired = F.col("pair_no").isNotNull()
    return out.select(
        "row_id", F.when((F.col("reason") == "ok") & ~paired, none).otherwise(F.col("reason")).alias("reason"), "pair_no",
        F.when(paired, F.col("best.candidate_index")).alias("chosen_index"), "rejected_index",
        F.when(paired, F.col("best.score")).alias("chosen_score"), "rejected_score",
    )


REASONS = ("ok", "no_candidates", "below_quality_floor", "uahe_cap", "min_cond", "min_sec", "no_reject", "no_valid_reject")


def audit(mined: DataFrame, *keys: str) -> DataFrame:
    """Prompts, kept prompts, pairs, pass rate and a fixed column for each reason."""
    per = mined.groupBy(*keys, "row_id").agg(F.first("reason").alias("reason"), F.count("pair_no").alias("pairs"))
    kept = F.count_if(F.col("reason") == "ok")
    return per.groupBy(*keys).agg(
        F.count("*").alias("prompts_total"), kept.alias("prompts_kept"), F.sum("pairs").alias("pairs"),
        F.round(kept / F.count("*"), 4).alias("pass_rate"), *[F.count_if(F.col("reason") == r).alias(f"reject_{r}") for r in REASONS],
    )


def sweep(candidates: DataFrame, spark: SparkSession, grid: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """Audit of the sweep rule for every combination of the grid.

    Each prompt is first reduced to its best row and to the widest gap to a candidate that can
    be rejected. These numbers are then rounded to the cuts of the grid, which changes no
    comparison with them, and counted: only the few different roundings meet the grid.
    """
    grid = grid or GRID
    rows = usable(candidates)
    first = best_rows(rows)
    rest = rows.join(first, "row_id").where(
        (F.col("candidate_text") != F.col("best.candidate_text")) & (F.col("candidate_index") != F.col("best.candidate_index"))
        & (F.col("ua") >= F.col("best.ua"))
    )
    gap = rest.groupBy("row_id").agg(F.max(F.col("best.score") - F.col("score")).alias("gap"))
    prompts = first.join(gap, "row_id", "left").select(
        _rounded(F.col("best.score"), grid["quality_floor"]).alias("score"), _rounded(F.col("best.ua"), grid["uahe_cap"], up=True).alias("ua"),
        _rounded(F.col("best.cond"), grid["min_cond"]).alias("cond"), _rounded(F.col("gap"), grid["margin"]).alias("gap"),
    ).groupBy("score", "ua", "cond", "gap").agg(F.count("*").alias("n"))
    cells = spark.createDataFrame(
        [(m, q, c, k) for m in grid["margin"] for q in grid["quality_floor"] for c in grid["uahe_cap"] for k in grid["min_cond"]],
        "margin double, quality_floor double, uahe_cap double, min_cond double",
    )
    met = prompts.crossJoin(F.broadcast(cells))  # the grid is a fixed table, and the roundings are as many at most
    reason = (
        F.when(F.col("score") < F.col("quality_floor"), "below_quality_floor")
        .when((F.col("uahe_cap") >= 0) & (F.col("ua") > F.col("uahe_cap")), "uahe_cap")
        .when((F.col("min_cond") > 0) & (F.col("cond") < F.col("min_cond")), "min_cond")
        .when(F.col("gap") >= F.col("margin"), "ok")
        .otherwise("no_valid_reject")
    )
    of = lambda r: F.sum(F.when(F.col("reason") == r, F.col("n")).otherwise(0))
    return met.withColumn("reason", reason).groupBy("margin", "quality_floor", "uahe_cap", "min_cond").agg(
        F.sum("n").alias("prompts_total"), of("ok").alias("prompts_kept"), of("ok").alias("pairs"), F.round(of("ok") / F.sum("n"), 4).alias("pass_rate"),
        *[of(r).alias(f"reject_{r}") for r in ("below_quality_floor", "uahe_cap", "min_cond", "no_valid_reject")],
    )


def _rounded(x: Column, cuts: tuple[float, ...], up: bool = False) -> Column:
    """x rounded to the next cut below (or above); beyond all cuts, and for null, a number beyond them."""
    array = F.array(*[F.lit(float(c)) for c in cuts])
    if up:
        return F.coalesce(F.array_min(F.filter(array, lambda c: c >= x)), F.lit(1e300))
    return F.coalesce(F.array_max(F.filter(array, lambda c: c <= x)), F.lit(-1e300))


def policies(spark: SparkSession) -> DataFrame:
    """The published policies as a table."""
    return spark.createDataFrame(
        [(k, p.quality_floor, p.margin, p.uahe_cap, p.min_cond, p.uahe_order, p.pairs) for k, p in POLICIES.items()],
        "pref_profile string, quality_floor double, margin double, uahe_cap double, min_cond double, uahe_order boolean, pairs int",
    )
