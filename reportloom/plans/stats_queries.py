"""Queries on aggregates, statistics, annotation and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions.text import SPLIT_NAMES, split_name
from reportloom.operators import annotation, stats
from reportloom.plans.registry import query
from reportloom.plans.text_queries import s_strip
from reportloom.plans.views import CANDIDATES, candidates, newest
from reportloom.session import table
from reportloom.sources.writers import content_mark

_BY = "model, pref_profile"


@query("agg01_means", f"WITH {CANDIDATES} SELECT {_BY}, count(*) AS n, round(avg(score), 6) AS score_mean, round(avg(cond), 6) AS cond_mean, round(avg(ua), 6) AS ua_mean FROM cand GROUP BY ALL")
def agg01(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy("model", "pref_profile").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score_mean"), F.round(F.avg("cond"), 6).alias("cond_mean"), F.round(F.avg("ua"), 6).alias("ua_mean")
    )


@query("agg02_median_iqr", f"WITH {CANDIDATES} SELECT {_BY}, round(quantile_cont(score, 0.5), 6) AS score_median, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS score_iqr FROM cand GROUP BY ALL")
def agg02(spark: SparkSession, d: str) -> DataFrame:
    q = candidates(spark, d).groupBy("model", "pref_profile").agg(F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("model", "pref_profile", F.round(F.col("q")[1], 6).alias("score_median"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("score_iqr"))


@query("agg03_mean_std", f"WITH {CANDIDATES} SELECT align_context, round(avg(ua), 6) AS ua_mean, round(stddev_pop(ua), 6) AS ua_std FROM cand GROUP BY ALL")
def agg03(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy("align_context").agg(F.round(F.avg("ua"), 6).alias("ua_mean"), F.round(F.stddev_pop("ua"), 6).alias("ua_std"))


_ENT = "ent AS (SELECT entity_id, row_id, condition_id, model, entity_type, entity_surface, in_input, in_retrieval, in_gen, gen_context, regex_attribution, annota_extraction, annota_attribution FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY labelled_at DESC NULLS LAST, md5(concat_ws('|', annota_extraction, annota_attribution)) DESC) AS age FROM entity_level_annota WHERE entity_id IS NOT NULL) WHERE age = 1)"


def entities(spark: SparkSession, d: str) -> DataFrame:
    columns = ["row_id", "condition_id", "model", "entity_type", "entity_surface", "in_input", "in_retrieval", "in_gen", "gen_context", "regex_attribution", "annota_extraction", "annota_attribution"]
    key = F.struct("labelled_at", F.md5(F.concat_ws("|", "annota_extraction", "annota_attribution").cast("binary")))
    rows = table(spark, d, "entity_level_annota").where("entity_id is not null").groupBy("entity_id").agg(F.max_by(F.struct(*columns), key).alias("r"))
    return rows.select("entity_id", "r.*")


@query("agg05_entity_stats", f"WITH {_ENT} SELECT entity_type, sum(in_input)::BIGINT AS total_in_input, sum(in_retrieval)::BIGINT AS total_in_retrieval, sum(in_gen)::BIGINT AS total_in_output, count(DISTINCT row_id) AS rows_with_entity, round(100.0 * count(DISTINCT row_id) / (SELECT count(DISTINCT row_id) FROM ent), 1) AS pct_rows FROM ent GROUP BY ALL")
def agg05(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    whole = e.agg(F.count_distinct("row_id").alias("n"))
    per = e.groupBy("entity_type").agg(
        F.sum("in_input").alias("total_in_input"), F.sum("in_retrieval").alias("total_in_retrieval"), F.sum("in_gen").alias("total_in_output"), F.count_distinct("row_id").alias("rows_with_entity")
    )
    return per.crossJoin(F.broadcast(whole)).withColumn("pct_rows", F.round(100.0 * F.col("rows_with_entity") / F.col("n"), 1)).drop("n")  # one row


@query(
    "agg06_precision_recall",
    f"WITH {_ENT}, s AS (SELECT entity_type, count_if(in_gen = 1 AND upper(annota_extraction) LIKE 'TP%')::BIGINT AS tp, count_if(in_gen = 1 AND upper(annota_extraction) LIKE 'FP%')::BIGINT AS fp, count_if(coalesce(in_gen, 0) = 0 AND in_input = 1)::BIGINT AS fn FROM ent GROUP BY ALL),"
    " p AS (SELECT *, tp / greatest(1, tp + fp)::DOUBLE AS pr, tp / greatest(1, tp + fn)::DOUBLE AS re FROM s) SELECT entity_type, tp, fp, fn, round(pr, 4) AS precision, round(re, 4) AS recall, round(2 * pr * re / greatest(1e-9, pr + re), 4) AS f1 FROM p",
)
def agg06(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).withColumn("l", F.upper("annota_extraction"))
    sums = e.groupBy("entity_type").agg(
        F.count_if((F.col("in_gen") == 1) & F.col("l").startswith("TP")).alias("tp"), F.count_if((F.col("in_gen") == 1) & F.col("l").startswith("FP")).alias("fp"),
        F.count_if((F.coalesce("in_gen", F.lit(0)) == 0) & (F.col("in_input") == 1)).alias("fn"),
    )
    return stats.precision_recall(sums, "tp", "fp", "fn")


@query("agg09_pool_stats", f"WITH {CANDIDATES}, s AS (SELECT pref_profile, row_id, count(*) AS c, max(score) - min(score) AS spread FROM cand WHERE score IS NOT NULL GROUP BY ALL), a AS (SELECT pref_profile, count(*) AS n_prompts, round(avg(spread), 6) AS spread_mean, round(quantile_cont(spread, 0.5), 6) AS spread_median FROM s GROUP BY ALL) SELECT a.*, b.* EXCLUDE (pref_profile) FROM a JOIN (SELECT pref_profile, count(*) AS n_candidates, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, min(score) AS score_min, max(score) AS score_max FROM cand WHERE score IS NOT NULL GROUP BY ALL) b ON a.pref_profile IS NOT DISTINCT FROM b.pref_profile")
def agg09(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).where("score is not null")
    spread = rows.groupBy("pref_profile", "row_id").agg((F.max("score") - F.min("score")).alias("spread"))
    a = spread.groupBy("pref_profile").agg(F.count("*").alias("n_prompts"), F.round(F.avg("spread"), 6).alias("spread_mean"), F.round(F.percentile("spread", F.lit(0.5)), 6).alias("spread_median"))
    b = rows.groupBy(F.col("pref_profile").alias("p")).agg(
        F.count("*").alias("n_candidates"), F.round(F.avg("score"), 6).alias("score_mean"), F.round(F.stddev_pop("score"), 6).alias("score_std"), F.min("score").alias("score_min"), F.max("score").alias("score_max")
    )
    return a.join(b, F.col("pref_profile").eqNullSafe(F.col("p"))).drop("p")


@query("agg12_label_precision", f"WITH {_ENT} SELECT entity_type, count(*) AS labelled, count_if(starts_with(annota_extraction, 'TP'))::BIGINT AS tp, round(100.0 * count_if(starts_with(annota_extraction, 'TP')) / count(*), 1) AS precision_pct FROM ent WHERE annota_extraction IS NOT NULL GROUP BY ALL")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    tp = F.count_if(F.col("annota_extraction").startswith("TP"))
    return entities(spark, d).where("annota_extraction is not null").groupBy("entity_type").agg(F.count("*").alias("labelled"), tp.alias("tp"), F.round(100.0 * tp / F.count("*"), 1).alias("precision_pct"))


_SPLIT = "regexp_replace(lower(split), '[^a-z]+', '', 'g')"
_S_SPLIT = "CASE " + " ".join(f"WHEN {_SPLIT} IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in SPLIT_NAMES.items()) + " END"


@query("agg13_groups_per_split", f"SELECT {_S_SPLIT} AS split_name, count(DISTINCT group_id) AS groups, count(DISTINCT row_id) AS records FROM splits GROUP BY ALL")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "splits").groupBy(split_name(F.col("split")).alias("split_name")).agg(F.count_distinct("group_id").alias("groups"), F.count_distinct("row_id").alias("records"))


@query("agg14_verify", "SELECT count(*) AS n, count(DISTINCT sheet_id) AS n_distinct, round(avg(length(gen_text)), 4) AS mean_chars, count_if(gen_text IS NULL)::BIGINT AS n_null FROM annotation_sheet")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotation_sheet").agg(
        F.count("*").alias("n"), F.count_distinct("sheet_id").alias("n_distinct"), F.round(F.avg(F.length("gen_text")), 4).alias("mean_chars"), F.count_if(F.col("gen_text").isNull()).alias("n_null")
    )


@query("snk08_content_hash")
def snk08(spark: SparkSession, d: str) -> DataFrame:
    return content_mark(table(spark, d, "dpo_pairs"))


# conditions: two return flags over the customers' mean discounts
_PAIRS = "v AS (SELECT o_custkey AS k, l_shipmode_ AS g, l_returnflag AS c, l_discount AS x FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem) JOIN orders ON l_orderkey = o_orderkey), pr AS (SELECT g, k, avg(x) FILTER (c = 'A') AS a, avg(x) FILTER (c = 'R') AS b FROM v WHERE c IN ('A', 'R') GROUP BY ALL HAVING avg(x) FILTER (c = 'A') IS NOT NULL AND avg(x) FILTER (c = 'R') IS NOT NULL)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("k"), F.col("l_linestatus").alias("g"), F.col("l_returnflag").alias("c"), F.col("l_discount").alias("x"))
    return stats.paired(rows, "k", "c", "x", "A", "R", "g")


@query("joi01_paired", f"WITH {_PAIRS} SELECT g, count(*) AS pairs, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS delta FROM pr GROUP BY g HAVING count(*) >= 5")
def joi01(spark: SparkSession, d: str) -> DataFrame:
    per = _pairs(spark, d).groupBy("g").agg(F.count("*").alias("pairs"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg("delta"), 6).alias("delta"))
    return per.where("pairs >= 5")


_WILCOXON = (
    f"WITH {_PAIRS}, dl AS (SELECT g, round(a - b, 9) AS dv FROM pr), nz AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY abs(dv)) + (count(*) OVER (PARTITION BY g, abs(dv)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY g, abs(dv)) AS t FROM dl WHERE dv <> 0),"
    " w AS (SELECT g, count(*)::DOUBLE AS n, sum(CASE WHEN dv > 0 THEN r ELSE 0 END) AS wp, sum(t * t - 1)::DOUBLE AS ties FROM nz GROUP BY g), z AS (SELECT *, (wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w)"
    " SELECT g, (SELECT count(*) FROM dl WHERE dl.g = z.g) AS n_total, n::BIGINT AS n_nonzero, wp AS w_plus, round(z, 6) AS z, round(2 * wp / (n * (n + 1) / 2) - 1, 6) AS rank_biserial FROM z"
)


@query("sta02_wilcoxon", _WILCOXON)
def sta02(spark: SparkSession, d: str) -> DataFrame:
    r = stats.signed_ranks(_pairs(spark, d), "g")
    return r.select("g", "n_total", "n_nonzero", "w_plus", F.round("z", 6).alias("z"), F.round("rank_biserial", 6).alias("rank_biserial"))


@query("sta02_wilcoxon_p")
def sta02_p(spark: SparkSession, d: str) -> DataFrame:
    return stats.signed_ranks(_pairs(spark, d), "g")


_P = "t AS (SELECT event_type || '-' || (user_id % 40)::VARCHAR AS id, round(abs(avg(value)) / (1 + abs(avg(value)) + stddev_pop(value)), 9) AS p FROM events GROUP BY ALL)"


def _tests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string")).alias("id"))
    m = F.abs(F.avg("value"))
    return e.agg(F.round(m / (1 + m + F.stddev_pop("value")), 9).alias("p"))


@query(
    "sta04_holm_bh",
    f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM t) SELECT id, p, round(least(1.0, max(p * (n - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 9) AS holm_q, round(least(1.0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 9) AS bh_q FROM r",
)
def sta04(spark: SparkSession, d: str) -> DataFrame:
    return stats.with_corrections(_tests(spark, d), "p", "id").select("id", "p", F.round("holm_q", 9).alias("holm_q"), F.round("bh_q", 9).alias("bh_q"))


@query(
    "sta06_tau_b",
    f"WITH {CANDIDATES}, v AS (SELECT model AS g, k AS x, round(ua, 9) AS y FROM cand WHERE k IS NOT NULL AND ua IS NOT NULL AND NOT isnan(ua)), c AS (SELECT g, x, y, count(*)::DOUBLE AS c FROM v GROUP BY ALL),"
    " s AS (SELECT a.g, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.c * b.c WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN -a.c * b.c ELSE 0 END) / 2 AS s FROM c a JOIN c b ON a.g = b.g GROUP BY ALL),"
    " n AS (SELECT g, sum(c) AS n FROM c GROUP BY ALL), n1 AS (SELECT g, sum(t * (t - 1) / 2) AS n1, count(*) AS n_levels FROM (SELECT g, x, sum(c) AS t FROM c GROUP BY ALL) GROUP BY g), n2 AS (SELECT g, sum(u * (u - 1) / 2) AS n2 FROM (SELECT g, y, sum(c) AS u FROM c GROUP BY ALL) GROUP BY g)"
    " SELECT g AS model, n::BIGINT AS n, n_levels, round(s / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 6) AS tau_b FROM s JOIN n USING (g) JOIN n1 USING (g) JOIN n2 USING (g)",
)
def sta06(spark: SparkSession, d: str) -> DataFrame:
    return stats.tau_b(candidates(spark, d).where("model is not null"), "k", "ua", "model").select("model", "n", "n_levels", F.round("tau_b", 6).alias("tau_b"))


#: Resamples of the query, each of all rows.
_DRAWS = 10_000
# 10,000 resamples are too slow for the SQL; tests/test_whole.py compares with the normal approximation
@query("sta01_bootstrap")
def sta01(spark: SparkSession, d: str) -> DataFrame:
    means = stats.bootstrap_means(table(spark, d, "events").withColumnRenamed("event_type", "g"), "event_id", "value", _DRAWS, 11, "g")
    return stats.interval(means, "g").select("g", F.round("ci_lo", 4).alias("ci_lo"), F.round("ci_hi", 4).alias("ci_hi"))


def _s_binary(x: str) -> str:
    return f"CASE WHEN starts_with(upper({s_strip(f"coalesce({x}, '')")}), 'TP') THEN 'TP' ELSE 'FP' END"


def _s_plain(x: str) -> str:
    return f"CASE WHEN contains(lower(coalesce({x}, '')), 'input') THEN 'input' WHEN contains(lower(coalesce({x}, '')), 'retrieval') THEN 'retrieval' WHEN contains(lower(coalesce({x}, '')), 'unattributed') THEN 'unattributed' ELSE 'NA' END"


def _s_newest(name: str) -> str:
    return f"(SELECT entity_id, extraction, attribution FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY labelled_at DESC NULLS LAST, md5(concat_ws('|', extraction, attribution)) DESC) AS age FROM {name} WHERE entity_id IS NOT NULL) WHERE age = 1)"


_LAB = (
    f"lb AS (SELECT ent.entity_id, entity_type, {_s_binary('annota_extraction')} AS a, CASE WHEN gp.entity_id IS NOT NULL THEN {_s_binary('gp.extraction')} END AS b, CASE WHEN gm.entity_id IS NOT NULL THEN {_s_binary('gm.extraction')} END AS c,"
    f" {_s_plain('annota_attribution')} AS a_attr, CASE WHEN gp.entity_id IS NOT NULL THEN {_s_plain('gp.attribution')} END AS b_attr, CASE WHEN gm.entity_id IS NOT NULL THEN {_s_plain('gm.attribution')} END AS c_attr"
    f" FROM ent LEFT JOIN {_s_newest('result_gpt_merged')} gp ON ent.entity_id = gp.entity_id LEFT JOIN {_s_newest('result_gemini_merged')} gm ON ent.entity_id = gm.entity_id)"
)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's latest labels by three annotators, b and c null where they have no entry."""
    binary, plain = annotation.binary_extraction, annotation.plain_attribution
    out = entities(spark, d).select("entity_id", "entity_type", binary(F.col("annota_extraction")).alias("a"), plain(F.col("annota_attribution")).alias("a_attr"))
    for name, c in (("gpt", "b"), ("gemini", "c")):
        other = newest(table(spark, d, f"result_{name}_merged"), "entity_id", "labelled_at", ["extraction", "attribution"])
        out = out.join(other.select("entity_id", binary(F.col("extraction")).alias(c), plain(F.col("attribution")).alias(f"{c}_attr")), "entity_id", "left")
    return out


@query("joi02_annotators", f"WITH {_ENT}, {_LAB} SELECT * FROM lb")
def joi02(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d)


@query(
    "sta09_kappa",
    f"WITH {_ENT}, {_LAB}, q AS (SELECT entity_type AS g, a, b FROM lb WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT g, count(*) AS n, count_if(a = b)::DOUBLE / count(*) AS po FROM q GROUP BY g),"
    " m AS (SELECT g, sum(pa * pb) AS pe FROM (SELECT q.g, v.l, count_if(a = v.l)::DOUBLE / count(*) AS pa, count_if(b = v.l)::DOUBLE / count(*) AS pb FROM q, (VALUES ('TP'), ('FP')) v(l) GROUP BY ALL) GROUP BY g)"
    " SELECT g AS entity_type, n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM n JOIN m USING (g) WHERE n >= 5",
)
def sta09(spark: SparkSession, d: str) -> DataFrame:
    k = stats.kappa(_labels(spark, d), "a", "b", "entity_type").where("n >= 5")
    return k.select("entity_type", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(
    "sta10_majority",
    f"WITH {_ENT}, {_LAB} SELECT entity_id, CASE WHEN (coalesce(a = 'TP', false)::INT + coalesce(b = 'TP', false)::INT + coalesce(c = 'TP', false)::INT) >= 2 THEN 'TP' WHEN (coalesce(a = 'FP', false)::INT + coalesce(b = 'FP', false)::INT + coalesce(c = 'FP', false)::INT) >= 2 THEN 'FP' ELSE 'no_consensus' END AS consensus FROM lb",
)
def sta10(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("entity_id", stats.majority(F.array("a", "b", "c")).alias("consensus"))


@query("sta11_disagreement", f"WITH {_ENT}, {_LAB} SELECT entity_id FROM lb WHERE a IS DISTINCT FROM b OR a IS DISTINCT FROM c OR b IS DISTINCT FROM c")
def sta11(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).where("not (a <=> b) or not (a <=> c) or not (b <=> c)").select("entity_id")


_CTX = "lower(coalesce(gen_context, ''))"
_ANN3 = f"""WITH {_ENT} SELECT entity_id, CASE entity_type WHEN 'URL' THEN 'TP' WHEN 'FILE' THEN 'TP'
 WHEN 'HASH' THEN CASE WHEN regexp_matches(s, '(?i)^[a-f0-9]{{6}}$') AND regexp_matches(c, 'color|colour|#|rgb|hex') THEN 'FP:color_code' WHEN length(s) <= 8 AND regexp_matches(s, '^[0-9]+$') THEN 'FP:decimal_number'
  WHEN regexp_matches(s, '^[0-9]*$') THEN 'TP:likely_bugid_or_revision' WHEN length(s) >= 12 THEN 'TP:likely_commit_hash' ELSE 'TP:likely_short_hash' END
 WHEN 'FLAG' THEN CASE WHEN regexp_matches(l, '^(?:e\\.g|i\\.e|etc\\.|vs\\.|fig\\.|eq\\.|ref\\.|no\\.|st\\.|nd\\.|rd\\.|th\\.)') THEN 'FP:abbreviation' WHEN regexp_matches(s, '^[0-9]+\\.[0-9]+') THEN 'FP:version_number'
  WHEN regexp_matches(s, '^[^.]{{0,2}}\\.[^.]{{0,2}}$') THEN 'FP:too_short' WHEN regexp_matches(l, 'config|setting|enable|disable|preference|pref|flag|option') THEN 'TP:likely_setting'
  WHEN regexp_matches(s, '^[\\p{{L}}_]*\\p{{L}}[\\p{{L}}_]*(?:\\.[\\p{{L}}_]*\\p{{L}}[\\p{{L}}_]*)+$') THEN 'TP:likely_property' ELSE 'TP:dotted_name' END ELSE 'TP' END AS label
 FROM (SELECT entity_id, entity_type, trim(coalesce(entity_surface, '')) AS s, lower(trim(coalesce(entity_surface, ''))) AS l, {_CTX} AS c FROM ent)"""


@query("ann03_extraction_label", _ANN3)
def ann03(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("entity_id", annotation.extraction_label(F.col("entity_type"), F.col("entity_surface"), F.col("gen_context")).alias("label"))


@query("ann05_refined_labels")
def ann05(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    kind, s, c = F.col("entity_type"), F.col("entity_surface"), F.col("gen_context")
    label = F.when(kind == "HASH", annotation.refined_hash(s, c)).when(kind == "FLAG", annotation.refined_flag(s, c)).otherwise(annotation.extraction_label(kind, s, c))
    return e.select("entity_id", label.alias("label"))


@query(
    "ann04_attribution_check",
    f"WITH {_ENT}, f AS (SELECT entity_id, regex_attribution AS g, coalesce(in_input = 1, false) AS i, coalesce(in_retrieval = 1, false) AS r, coalesce(in_gen = 1, false) AS o FROM ent)"
    " SELECT entity_id, CASE WHEN NOT o THEN 'NA:not_in_gen' WHEN g = 'input' AND i THEN 'Y:correct_input_attr' WHEN g = 'retrieval' AND NOT i AND r THEN 'Y:correct_retrieval_attr' WHEN g = 'unattributed' AND NOT i AND NOT r THEN 'Y:correct_unattributed'"
    " ELSE 'N:mismatch_expected_' || CASE WHEN i THEN 'IAHE' WHEN r THEN 'RAHE' ELSE 'UAHE' END END AS label FROM f",
)
def ann04(spark: SparkSession, d: str) -> DataFrame:
    check = annotation.attribution_check(F.col("regex_attribution"), F.col("in_input"), F.col("in_retrieval"), F.col("in_gen"))
    return entities(spark, d).select("entity_id", check.alias("label"))


@query("set01_bag_union", "SELECT origin, count(*) AS n, count(score)::BIGINT AS scored FROM (SELECT 'c' AS origin, row_id, prefscore AS score FROM candidates UNION ALL SELECT 'p', row_id, chosen_score FROM dpo_pairs UNION ALL SELECT 's', row_id, NULL FROM annotation_sheet) GROUP BY ALL")
def set01(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "candidates").select(F.lit("c").alias("origin"), "row_id", F.col("prefscore").alias("score"))
    b = table(spark, d, "dpo_pairs").select(F.lit("p").alias("origin"), "row_id", F.col("chosen_score").alias("score"))
    c = table(spark, d, "annotation_sheet").select(F.lit("s").alias("origin"), "row_id")
    both = a.unionByName(b).unionByName(c, allowMissingColumns=True)
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.count("score").alias("scored"))
