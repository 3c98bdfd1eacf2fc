"""Queries on sources, whole stages, summaries of tests, samples by prompt, prompts and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions import text as tx
from reportloom.operators import annotation, mining, sampling, scan, stats
from reportloom.plans.registry import query
from reportloom.plans.retrieval_queries import _BM25, _DRAW
from reportloom.plans.stats_queries import _ENT, _P, _pairs, _tests, entities
from reportloom.plans.text_queries import ATT, attributed, s_strip
from reportloom.plans.views import CANDIDATES, REPORTS, candidates, reports
from reportloom.session import Scratch, table
from reportloom.sources import readers


@query("src01_report_columns", "SELECT row_id, new_llama_output, text, source FROM splits")
def src01(spark: SparkSession, d: str) -> DataFrame:
    return readers.report_columns(table(spark, d, "splits"), "new_llama_output", "text", ["source", "text"])


@query("src06_synonyms", "SELECT entity_id, entity_surface, extraction AS ext, attribution AS attr FROM result_gpt_merged")
def src06(spark: SparkSession, d: str) -> DataFrame:
    named = readers.with_synonyms(table(spark, d, "result_gpt_merged"), {"ext": ("Extraction", "annotb_extraction"), "attr": ("attribution", "annotb_attribution"), "surface": ("text",)})
    return named.select("entity_id", "entity_surface", "ext", "attr")


@query("src08_pool", f"WITH {CANDIDATES} SELECT row_id, candidate_index, coalesce(score, 0.0) AS pref_score, coalesce(candidate_text, '') AS candidate_text FROM cand")
def src08(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).select("row_id", "candidate_index", F.struct(F.lit(None).cast("double").alias("PrefScore")).alias("components"), F.col("score").alias("pref_score"), F.lit(None).cast("string").alias("gen_text"), "candidate_text")
    return rows.select("row_id", "candidate_index", readers.pool_score().alias("pref_score"), readers.candidate_text().alias("candidate_text"))


@query(
    "src09_non_contiguous",
    "WITH p AS (SELECT ticket_key, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE ticket_key IS NOT NULL) SELECT ticket_key, count(*) AS n FROM p GROUP BY ticket_key HAVING max(i) - min(i) + 1 > count(*)",
)
def src09(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose rows don't lie together in the order of the ids, by the ranks of the ids."""
    docs = table(spark, d, "documents").where("ticket_key is not null").select("doc_id", "ticket_key")
    return readers.non_contiguous(stats.numbered(docs, "doc_id", "i"), "ticket_key", "i")


_SUMMARY = f"""WITH {_P}, r AS (SELECT *, split_part(id, '-', 1) AS g, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM t),
 h AS (SELECT *, least(1.0, max(p * (n - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS q FROM r)
 SELECT g, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median, round(min(p), 6) AS min, round(max(p), 6) AS max, round(avg(q), 6) AS mean_q, count(DISTINCT id) AS n_items, count_if(q < 0.05)::BIGINT AS n_sig FROM h GROUP BY g"""


@query("agg07_test_summary", _SUMMARY)
def agg07(spark: SparkSession, d: str) -> DataFrame:
    tests = stats.with_corrections(_tests(spark, d), "p", "id").withColumn("g", F.split_part("id", F.lit("-"), F.lit(1)))
    out = stats.summary(tests, "p", "holm_q", "id", "g")
    return out.select("g", *[F.round(c, 6).alias(c) for c in ("mean", "median", "min", "max", "mean_q")], "n_items", "n_sig")


#: Places on the ordinal axis of adapters.
ADAPTERS = {"base": 0, "sft": 1, "dpo": 2}


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """(axis, model, context, metric, level, value, id): the candidates on the axis of k, for each model and context."""
    rows = candidates(spark, d).where("model is not null and k in (0, 1, 2)")
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("score", "cond", "ua")]))
    rows = rows.select(F.lit("k").alias("axis"), "model", F.coalesce("align_context", F.lit("NA")).alias("context"), F.col("k").alias("level"), F.concat_ws("|", "row_id", "candidate_index").alias("id"), metrics.alias("x"))
    return rows.select("axis", "model", "context", "level", "id", "x.*").where("value is not null")


_AXES_SQL = f"""WITH {CANDIDATES}, v AS (SELECT model, coalesce(align_context, 'NA') AS context, m AS metric, k AS x, round(CASE m WHEN 'score' THEN score WHEN 'cond' THEN cond ELSE ua END, 9) AS y
  FROM cand, (SELECT unnest(['score', 'cond', 'ua']) AS m) WHERE model IS NOT NULL AND k IN (0, 1, 2)), w AS (SELECT * FROM v WHERE y IS NOT NULL), c AS (SELECT model, context, metric, x, y, count(*)::DOUBLE AS c FROM w GROUP BY ALL),
 s AS (SELECT a.model, a.context, a.metric, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.c * b.c WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN -a.c * b.c ELSE 0 END) / 2 AS s FROM c a JOIN c b USING (model, context, metric) GROUP BY ALL),
 n AS (SELECT model, context, metric, sum(c) AS n FROM c GROUP BY ALL),
 n1 AS (SELECT model, context, metric, sum(t * (t - 1) / 2) AS n1, sum(t * (t - 1) * (2 * t + 5)) AS x5, sum(t * (t - 1) * (t - 2)) AS x2, count(*) AS n_levels FROM (SELECT model, context, metric, x, sum(c) AS t FROM c GROUP BY ALL) GROUP BY ALL),
 n2 AS (SELECT model, context, metric, sum(u * (u - 1) / 2) AS n2, sum(u * (u - 1) * (2 * u + 5)) AS y5, sum(u * (u - 1) * (u - 2)) AS y2 FROM (SELECT model, context, metric, y, sum(c) AS u FROM c GROUP BY ALL) GROUP BY ALL)
 SELECT 'k' AS axis, model, context, metric, n::BIGINT AS n, n_levels, round(CASE WHEN (n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2) > 0 THEN s / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)) ELSE 0 END, 6) AS tau_b,
  round(CASE WHEN (n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2) > 0 THEN s / sqrt((n * (n - 1) * (2 * n + 5) - x5 - y5) / 18 + 2 * n1 * n2 / (n * (n - 1)) + x2 * y2 / (9 * n * (n - 1) * (n - 2))) ELSE 0 END, 5) AS z
 FROM s JOIN n USING (model, context, metric) JOIN n1 USING (model, context, metric) JOIN n2 USING (model, context, metric) WHERE n >= 10"""
_GROUP = ("axis", "model", "context", "metric")


@query("sta08_axis_tau", _AXES_SQL)
def sta08(spark: SparkSession, d: str) -> DataFrame:
    tau = stats.tau_b(_axes(spark, d), "level", "value", *_GROUP).where("n >= 10")
    return tau.select(*_GROUP, "n", "n_levels", F.round("tau_b", 6).alias("tau_b"), F.round("z", 5).alias("z"))


@query("sta06_tau_p")
def sta06_p(spark: SparkSession, d: str) -> DataFrame:
    tests = stats.tau_b(_axes(spark, d), "level", "value", *_GROUP).where("n >= 10")
    return stats.with_corrections(tests.withColumn("id", F.concat_ws("|", *_GROUP)), "p", "id")


@query("sta07_tau_interval")
def sta07(spark: SparkSession, d: str) -> DataFrame:
    rows = _axes(spark, d).where("metric = 'ua'")
    return stats.bootstrap_tau(rows, "id", "level", "value", 50, 7, *_GROUP)


@query("sta01_paired_interval")
def sta01_paired(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference of the paired values with its bootstrap interval, groups of five pairs or more."""
    pairs = Scratch(spark, "pairs").keep(_pairs(spark, d))
    means = stats.bootstrap_means(pairs, "k", "delta", 10_000, 5, "g")
    per = pairs.groupBy("g").agg(F.count("*").alias("pairs"), F.avg("delta").alias("delta")).where("pairs >= 5")
    return per.join(stats.interval(means, "g"), "g")


@query(
    "sam04_k_strata",
    f"WITH {CANDIDATES}, h AS (SELECT row_id, coalesce(bool_or(k > 0), false) AS has FROM cand GROUP BY ALL), c AS (SELECT count(*) FILTER (has) AS y, count(*) FILTER (NOT has) AS n FROM h),"
    f" r AS (SELECT *, row_number() OVER (PARTITION BY has ORDER BY {_DRAW.format(chr(39) + '4|' + chr(39) + ' || row_id::VARCHAR')}, row_id) AS i FROM h)"
    " SELECT row_id, has FROM r, c WHERE i <= CASE WHEN has THEN least(greatest(60, 100 - n), y) ELSE least(greatest(40, 100 - y), n) END",
)
def sam04(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).groupBy("row_id").agg(F.coalesce(F.bool_or(F.col("k") > 0), F.lit(False)).alias("has"))
    return sampling.two_strata(rows, "has", "row_id", 100, 0.6, 4)


@query(
    "sam06_prompt_split",
    f"WITH p AS (SELECT prompt, row_number() OVER (ORDER BY {_DRAW.format(chr(39) + '42|' + chr(39) + ' || coalesce(prompt, ' + chr(39) * 2 + ')')}, prompt NULLS FIRST) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT prompt FROM dpo_pairs))"
    " SELECT pair_id, i <= greatest(1, floor(n * 0.1::DOUBLE)) AS is_eval FROM dpo_pairs a JOIN p ON a.prompt IS NOT DISTINCT FROM p.prompt",
)
def sam06(spark: SparkSession, d: str) -> DataFrame:
    return sampling.prompt_split(table(spark, d, "dpo_pairs").select("pair_id", "prompt"), "prompt", 0.1, 42).select("pair_id", "is_eval")


@query(
    "joi05_cache_lookup",
    "WITH c AS (SELECT row_id, arg_max(retrieved_pos, scored_at) AS pos FROM candidates WHERE row_id IS NOT NULL AND candidate_index = 0 AND scored_at IS NOT NULL AND retrieved_pos IS NOT NULL GROUP BY row_id)"
    " SELECT DISTINCT s.row_id, coalesce(len(pos), 0)::INTEGER AS n_pos FROM splits s LEFT JOIN c USING (row_id) WHERE s.row_id IS NOT NULL",
)
def joi05(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "candidates").where("row_id is not null and candidate_index = 0 and scored_at is not null and retrieved_pos is not null")
    cache = kept.groupBy("row_id").agg(F.max_by("retrieved_pos", "scored_at").alias("pos"))
    asked = table(spark, d, "splits").where("row_id is not null").select("row_id").distinct()
    return asked.join(cache, "row_id", "left").select("row_id", F.size(F.coalesce("pos", F.array().cast("array<int>"))).alias("n_pos"))


_PROMPT = (
    _BM25.replace("SELECT item_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3",
    f"SELECT item_id, 'Write a report.' || chr(10) || chr(10) || coalesce(e || chr(10) || chr(10), '') || '### Input:' || chr(10) || {s_strip('i.text')} || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM test_items i LEFT JOIN"
    f" (SELECT item_id, string_agg('### Example Input:' || chr(10) || {s_strip("coalesce(product, '')")} || chr(10) || chr(10) || '### Example Bug Report:' || chr(10) || {s_strip('text')} || chr(10), chr(10) || chr(10) ORDER BY rank) AS e FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id) x USING (item_id)")
)


@query("txt23_prompt", _PROMPT)
def txt23(spark: SparkSession, d: str) -> DataFrame:
    from reportloom.operators.retrieval import exemplars

    items, docs = table(spark, d, "test_items").select("item_id", "text"), table(spark, d, "documents")
    hits = scan.bm25_topk(items, docs.select("doc_id", "text"), "item_id", "doc_id", "text", 3)
    packed = exemplars(hits, docs, "doc_id", ["product", "text"]).withColumnRenamed("q", "item_id")
    pairs = F.transform("examples", lambda e: F.struct(F.coalesce(e["product"], F.lit("")).alias("given"), e["text"].alias("made")))
    none = F.array().cast("array<struct<given:string,made:string>>")
    return items.join(packed, "item_id", "left").select("item_id", tx.prompt(F.lit("Write a report."), F.coalesce(pairs, none), F.col("text")).alias("prompt"))


@query(
    "ret13_retrieval_text",
    _BM25.replace("SELECT item_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3", "SELECT item_id, string_agg(text, chr(10) ORDER BY rank) AS retrieved FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id"),
)
def ret13(spark: SparkSession, d: str) -> DataFrame:
    from reportloom.operators.retrieval import exemplars

    items, docs = table(spark, d, "test_items").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text")
    packed = exemplars(scan.bm25_topk(items, docs, "item_id", "doc_id", "text", 3), docs, "doc_id", ["text"])
    return packed.select(F.col("q").alias("item_id"), F.array_join(F.transform("examples", lambda e: e["text"]), "\n").alias("retrieved"))


@query(
    "ret14_list_of_k",
    _BM25.replace("SELECT item_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3", "SELECT item_id, k, doc_id, rank::INTEGER AS rank FROM r, (SELECT unnest([1, 2, 5]) AS k) WHERE rank <= k"),
)
def ret14(spark: SparkSession, d: str) -> DataFrame:
    items, docs = table(spark, d, "test_items").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text")
    hits = scan.topk("bm25", items, docs, "item_id", "doc_id", "text", 5)
    return scan.for_each_k(hits, [0, 1, 2, 5, 2]).select(F.col("q").alias("item_id"), "k", F.col("doc").alias("doc_id"), "rank")


@query(
    "ret11_cache",
    _BM25.replace("SELECT item_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3", "SELECT item_id, list(doc_id ORDER BY rank) AS retrieved, list(round(score, 4) ORDER BY rank) AS scores FROM r WHERE rank <= 3 GROUP BY item_id"),
)
def ret11(spark: SparkSession, d: str) -> DataFrame:
    """The hits of each query as lists, written below the key of the search's configuration and read back."""
    from reportloom.session import shared_dir
    from reportloom.sources.writers import index_once

    items, docs = table(spark, d, "test_items").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text")

    def make() -> dict[str, DataFrame]:
        hits = scan.bm25_topk(items, docs, "item_id", "doc_id", "text", 3)
        packed = F.array_sort(F.collect_list(F.struct("rank", "doc", F.round("score", 4).alias("score"))))  # at most k
        return {"hits": hits.groupBy("q").agg(packed.alias("h")).select(F.col("q").alias("item_id"), F.col("h.doc").alias("retrieved"), F.col("h.score").alias("scores"))}

    return index_once(spark, f"{shared_dir(spark)}/retrieval", {"backend": "bm25", "k": 3, "data": d, "k1": 1.5, "b": 0.75}, make)["hits"]


@query("min06_dump", f"WITH {CANDIDATES} SELECT row_id, candidate_index, row_number() OVER (PARTITION BY row_id ORDER BY coalesce(score, 0.0) DESC, candidate_index)::INTEGER AS candidate_rank, candidate_text, resp_tokens, coalesce(score, 0.0) AS pref_score FROM cand WHERE candidate_index IS NOT NULL")
def min06(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).where("candidate_index is not null").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return mining.ranked(rows).select("row_id", "candidate_index", F.col("place").alias("candidate_rank"), "candidate_text", "resp_tokens", F.col("score").alias("pref_score"))


@query("ann06_refined_flags")
def ann06(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("entity_type = 'FLAG'").select("entity_id", annotation.refined_flag(F.col("entity_surface"), F.col("gen_context")).alias("label"))


@query("ann07_blank_copy", f"WITH {_ENT} SELECT entity_id, entity_type, entity_surface, '' AS extraction, '' AS attribution, '' AS notes FROM ent")
def ann07(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("entity_id", "entity_type", "entity_surface", *[F.lit("").alias(c) for c in ("extraction", "attribution", "notes")])


@query(
    "txt19_attribution_totals",
    ATT + " SELECT sheet_id, (n_input + n_retrieval + n_unattributed)::INTEGER AS hard_out, (n_retrieval + n_unattributed)::INTEGER AS iuhe, round(n_unattributed / greatest(1.0, n_input + n_retrieval + n_unattributed), 6) AS unattributed_rate,"
    " round(1000.0 * n_retrieval / greatest(1, tokens), 6) AS rahe_per_1k, tokens::INTEGER AS tokens FROM att",
)
def txt19_totals(spark: SparkSession, d: str) -> DataFrame:
    i, r, u = F.col("input"), F.col("retrieval"), F.col("unattributed")
    out = i + r + u
    return attributed(spark, d).select(
        "sheet_id", out.alias("hard_out"), (r + u).alias("iuhe"), F.round(tx.ratio(u, out.cast("double")), 6).alias("unattributed_rate"),
        F.round(1000.0 * tx.ratio(r, F.col("tokens").cast("double")), 6).alias("rahe_per_1k"), "tokens",
    )


@query(
    "scl14_report_order",
    f"WITH {REPORTS} SELECT row_id, row_number() OVER (ORDER BY sha1(gt_text), row_id) AS pos FROM reports WHERE gt_text IS NOT NULL",
)
def scl14(spark: SparkSession, d: str) -> DataFrame:
    rows = reports(spark, d).where("gt_text is not null").select("row_id", F.sha1(F.col("gt_text").cast("binary")).alias("group_id"))
    return stats.numbered(rows, "group_id", "pos", "row_id").select("row_id", "pos")
