"""Statistics: bootstrap, signed ranks, multiplicity correction, rank correlation, agreement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.session import Scratch


def paired(values: DataFrame, key: str, condition: str, value: str, a: object, b: object, *groups: str) -> DataFrame:
    """(groups, key, a, b, delta): values of two conditions side by side, keys with both only.

    A conditional aggregate instead of a self-join; of repeated rows the mean counts.
    """
    sides = values.where(F.col(condition).isin(a, b)).groupBy(*groups, key).agg(
        F.avg(F.when(F.col(condition) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(condition) == b, F.col(value))).alias("b")
    )
    return sides.where("a is not null and b is not null").withColumn("delta", F.col("a") - F.col("b"))


def signed_ranks(pairs: DataFrame, *groups: str, digits: int = 9) -> DataFrame:
    """Wilcoxon numbers of each group: n_total, n_nonzero, w_plus, z, p, rank_biserial.

    Zero deltas are left out, ties get average ranks, the normal approximation is corrected
    for ties. With fewer than five deltas that aren't zero z is null and p is one. Ranks come from
    counts of equal sizes, so no task sorts a whole group of raw rows.
    """
    size = F.round(F.abs("delta"), digits)
    counts = pairs.where("delta is not null").groupBy(*groups, size.alias("size")).agg(
        F.count("*").alias("t"), F.count_if(F.col("delta") > 0).alias("up")
    )
    below = Window.partitionBy(*groups).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    nonzero = F.when(F.col("size") > 0, F.col("t")).otherwise(0)
    ranked = counts.withColumn("nz", nonzero).withColumn("below", F.coalesce(F.sum("nz").over(below), F.lit(0)))
    rank = F.col("below") + (F.col("nz") + 1) / 2
    per = ranked.groupBy(*groups).agg(
        F.sum("t").alias("n_total"), F.sum("nz").alias("n"), F.sum(F.when(F.col("size") > 0, rank * F.col("up")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.col("nz") * F.col("nz") * F.col("nz") - F.col("nz")).alias("ties"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when((F.col("n") >= 5) & (variance > 0), (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance))
    r = F.when(n > 0, 2 * F.col("w_plus") / (n * (n + 1) / 2) - 1).otherwise(0.0)
    out = per.withColumn("z", z)
    return out.select(
        *groups, "n_total", F.col("n").alias("n_nonzero"), "w_plus", "z", F.when(F.col("z").isNotNull(), normal_p(F.col("z"))).otherwise(1.0).alias("p"),
        r.alias("rank_biserial"),
    )


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal score, by a rational approximation with an error below 2e-7."""
    #: Coefficients of the approximation of the error function.
    c = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (c[0] + t * (c[1] + t * (c[2] + t * (c[3] + t * c[4]))))
    return poly * F.exp(-x * x)


def with_corrections(tests: DataFrame, p: str, tie: str, *groups: str) -> DataFrame:
    """Adds holm_q and bh_q. Result sets of tests are small; each group is corrected in one task."""
    order = [F.coalesce(F.col(p), F.lit(1.0)), F.col(tie)]
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    by = whole.orderBy(*order)
    rows = tests.withColumn("_n", F.count("*").over(whole)).withColumn("_i", F.row_number().over(by)).withColumn("_p", order[0])
    up = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = whole.orderBy(*[o.desc() for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("holm_q", F.least(F.lit(1.0), F.max(F.col("_p") * (F.col("_n") - F.col("_i") + 1)).over(up)))
        .withColumn("bh_q", F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_n") / F.col("_i")).over(down)))
        .drop("_n", "_i", "_p")
    )


def tau_b(rows: DataFrame, level: str, value: str, *groups: str, digits: int = 9) -> DataFrame:
    """(groups, n, n_levels, tau_b): Kendall's tau-b of a few ordered levels against a measure.

    From counts by value and level; pairs are never formed. tau is zero and p one if either side
    is constant. z and p are those of the normal approximation, corrected for ties.
    """
    clean = rows.where(F.col(level).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = clean.groupBy(*groups, F.round(value, digits).alias("y"), F.col(level).alias("x")).agg(F.count("*").alias("c"))
    lower_y = Window.partitionBy(*groups, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    seen = counts.withColumn("less", F.coalesce(F.sum("c").over(lower_y), F.lit(0)))
    # for each value, how many rows of each level lie below: complete the levels of every value
    levels = counts.groupBy(*groups, "x").agg(F.sum("c").alias("t"))
    values = counts.groupBy(*groups, "y").agg(F.sum("c").alias("u"))
    grid = values.join(levels, list(groups)) if groups else values.crossJoin(levels)
    full = grid.join(seen.select(*groups, "y", "x", "c"), [*groups, "y", "x"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    full = full.withColumn("less", F.coalesce(F.sum("c").over(lower_y), F.lit(0)))
    by_level = Window.partitionBy(*groups, "y").orderBy("x")
    up = by_level.rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*groups, "y").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("conc", F.col("c") * F.coalesce(F.sum("less").over(up), F.lit(0))).withColumn(
        "disc", F.col("c") * F.coalesce(F.sum("less").over(down), F.lit(0))
    )
    s = full.groupBy(*groups).agg((F.sum("conc") - F.sum("disc")).cast("double").alias("s"), F.sum("c").cast("double").alias("n"))
    n1 = levels.groupBy(*groups).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("n1"), F.count("*").alias("n_levels"), *_tie_sums("t", "x"))
    n2 = values.groupBy(*groups).agg(F.sum(F.col("u") * (F.col("u") - 1) / 2).alias("n2"), *_tie_sums("u", "y"))
    joined = s.join(n1, list(groups)).join(n2, list(groups)) if groups else s.crossJoin(n1).crossJoin(n2)
    n0 = F.col("n") * (F.col("n") - 1) / 2
    root = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    n = F.col("n")
    variance = (n * (n - 1) * (2 * n + 5) - F.col("x5") - F.col("y5")) / 18 + 2 * F.col("n1") * F.col("n2") / (n * (n - 1))
    variance = variance + F.when(n > 2, F.col("x2") * F.col("y2") / (9 * n * (n - 1) * (n - 2))).otherwise(0.0)
    z = F.when((root > 0) & (variance > 0), F.col("s") / F.sqrt(variance)).otherwise(0.0)
    out = joined.select(*groups, n.cast("bigint").alias("n"), "n_levels", F.when(root > 0, F.col("s") / root).otherwise(0.0).alias("tau_b"), z.alias("z"))
    return out.withColumn("p", F.when(F.col("z") == 0, 1.0).otherwise(normal_p(F.col("z"))))


def _tie_sums(t: str, name: str) -> list[Column]:
    """What ties add to the variance of tau's numerator."""
    c = F.col(t).cast("double")
    return [F.sum(c * (c - 1) * (2 * c + 5)).alias(f"{name}5"), F.sum(c * (c - 1) * (c - 2)).alias(f"{name}2")]


def bootstrap_tau(rows: DataFrame, key: str, level: str, value: str, draws: int, seed: int, *groups: str, alpha: float = 0.05) -> DataFrame:
    """(groups, ci_lo, ci_hi): linear percentiles of tau-b over ``draws`` resamples of all rows of a group.

    In each resample a row counts as often as a Poisson number with mean one says, drawn by a
    hash of seed, resample and key. Rows with null level or value are left out.
    """
    clean = rows.where(F.col(level).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*groups, key, level, value)
    each = clean.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    hashed = F.xxhash64(F.lit(seed), "b", key)
    each = each.withColumn("_u", hashed.bitwiseXOR(F.shiftrightunsigned(hashed, 32)).bitwiseAND(F.lit((1 << 32) - 1))).where(F.col("_u") >= _POISSON[0])
    times = F.when(F.col("_u") < _POISSON[1], 1)
    for k in range(2, len(_POISSON)):
        times = times.when(F.col("_u") < _POISSON[k], k)
    drawn = each.withColumn("_c", F.explode(F.sequence(F.lit(1), times.otherwise(len(_POISSON))))).drop("_u", "_c")
    return interval(tau_b(drawn, level, value, *groups, "b").withColumnRenamed("tau_b", "m"), *groups, alpha=alpha)


def summary(tests: DataFrame, value: str, q: str, item: str, *groups: str, level: float = 0.05) -> DataFrame:
    """(groups, mean, median, min, max of the value, mean q, different items, significant ones); null q isn't significant."""
    return tests.groupBy(*groups).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(q).alias("mean_q"), F.count_distinct(item).alias("n_items"), F.count_if(F.col(q) < level).alias("n_sig"),
    )  # results of tests, a few for each group

#: 32-bit limits of the Poisson distribution with mean one; a count is the number of limits at or below a draw.
_POISSON = tuple(round((1 << 32) * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12))


def bootstrap_means(values: DataFrame, key: str, value: str, draws: int, seed: int, *groups: str) -> DataFrame:
    """(groups, b, m): means of ``draws`` resamples of all rows of a group.

    ``key`` tells the rows apart. In each resample a row counts as often as a Poisson number with mean
    one says, drawn by a hash of seed, resample and key. Null and NaN values are left out. Each task
    sums its rows for every resample, so only sums are shuffled: groups times draws for each task.
    """
    spark = values.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = values.select(*groups, key, F.col(value).cast("double").alias("_x")).where("_x is not null and not isnan(_x)").repartition(tasks, key)
    each = rows.select(*groups, key, "_x", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    # both halves, as one alone keeps a little of the key's order
    hashed = F.xxhash64(F.lit(seed), "b", key)
    drawn = each.withColumn("_u", hashed.bitwiseXOR(F.shiftrightunsigned(hashed, 32)).bitwiseAND(F.lit((1 << 32) - 1))).where(F.col("_u") >= _POISSON[0])
    times = F.when(F.col("_u") < _POISSON[1], 1)
    for k in range(2, len(_POISSON)):
        times = times.when(F.col("_u") < _POISSON[k], k)
    counted = drawn.select(*groups, "b", "_x", times.otherwise(len(_POISSON)).alias("_t"))
    return counted.groupBy(*groups, "b").agg((F.sum(F.col("_x") * F.col("_t")) / F.sum("_t")).alias("m"))


def interval(means: DataFrame, *groups: str, alpha: float = 0.05) -> DataFrame:
    """(groups, ci_lo, ci_hi): linear percentiles of resampled means."""
    q = F.percentile(F.round("m", 9), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = means.groupBy(*groups).agg(q.alias("q"))
    return out.select(*groups, F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"))


def kappa(pairs: DataFrame, a: str, b: str, *groups: str, least: int = 5) -> DataFrame:
    """(groups, n, agreement, kappa) of two label columns; nulls are dropped, fewer than ``least`` pairs give null."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*groups, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    rows = Window.partitionBy(*groups, "a")
    columns = Window.partitionBy(*groups, "b")
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    cells = cells.withColumn("ra", F.sum("c").over(rows)).withColumn("rb", F.sum("c").over(columns)).withColumn("n", F.sum("c").over(whole))
    # the product of margins needs each label once on either side
    left = cells.groupBy(*groups, "a").agg(F.first("ra").alias("ra"), F.first("n").alias("n"))
    right = cells.groupBy(*groups, F.col("b").alias("a")).agg(F.first("rb").alias("rb"))
    chance = left.join(right, [*groups, "a"]).groupBy(*groups).agg(F.sum(F.col("ra") * F.col("rb") / (F.col("n") * F.col("n"))).alias("pe"))
    seen = cells.groupBy(*groups).agg(F.first("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    both = seen.join(chance, list(groups), "left") if groups else seen.crossJoin(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("pe", F.lit(0.0))
    enough = F.col("n") >= least
    return both.select(
        *groups, "n", F.when(enough, po).alias("agreement"), F.when(enough & (pe < 1), (po - pe) / (1 - pe)).when(enough, F.lit(1.0)).alias("kappa")
    )


def majority(votes: Column) -> Column:
    """The label with at least two of the votes, of equals the first in the alphabet; else no_consensus."""
    labels = F.array_sort(F.array_distinct(F.filter(votes, lambda v: v.isNotNull())))
    counted = F.transform(labels, lambda x: F.struct(F.size(F.filter(votes, lambda v: v == x)).alias("c"), x.alias("x")))
    strong = F.filter(counted, lambda e: e["c"] >= 2)
    best = F.aggregate(strong, F.struct(F.lit(0).alias("c"), F.lit("no_consensus").alias("x")), lambda s, e: F.when(e["c"] > s["c"], e).otherwise(s))
    return best["x"]


def precision_recall(sums: DataFrame, tp: str, fp: str, fn: str) -> DataFrame:
    """Adds precision, recall and f1, four digits; an empty denominator counts as one."""
    t, one = F.col(tp), F.lit(1)
    pr, re = t / F.greatest(one, t + F.col(fp)), t / F.greatest(one, t + F.col(fn))
    f1 = 2 * pr * re / F.greatest(F.lit(1e-9), pr + re)
    return sums.withColumns({"precision": F.round(pr, 4), "recall": F.round(re, 4), "f1": F.round(f1, 4)})


def numbered(rows: DataFrame, by: str, name: str, *ties: str) -> DataFrame:
    """Adds the number (from one) of each row in the order of ``by`` and ``ties``, without one task sorting all rows.

    Rows are spread by ranges of the order; the sizes of the ranges before are added to the number within a range.
    """
    spread = Scratch(rows.sparkSession, "numbered").keep(rows.repartitionByRange(by, *ties).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_c"))  # as many as partitions
    ahead = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(by, *ties)
    return spread.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_part", "_before")
