"""Queries on entity sheets, prompts, spans, grids and further splits and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions import scoring
from reportloom.functions import text as tx
from reportloom.operators import mining, retrieval, sampling, scan, stats
from reportloom.plans.registry import query
from reportloom.plans.retrieval_queries import _DRAW
from reportloom.plans.stats_queries import _ENT, _LAB, _labels
from reportloom.plans.text_queries import ENT, s_ent, s_mask, s_tokens
from reportloom.plans.views import CANDIDATES, REPORTS, SHEET, candidates, reports, sheet
from reportloom.session import table


@query("txt03_lines", "SELECT doc_id, len(l) - (CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END) AS n_lines FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents WHERE text IS NOT NULL)")
def txt03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(tx.lines(F.col("text"))).cast("bigint").alias("n_lines"))


@query("txt17_entity_spans")
def txt17(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    out = None
    for kind in tx.KINDS:
        part = docs.select("doc_id", F.lit(kind).alias("kind"), F.explode(tx.spans(F.col("text"), kind)).alias("s")).select("doc_id", "kind", "s.*")
        out = part if out is None else out.unionByName(part)
    return out


_SHEET_SQL = " UNION ALL ".join(
    f"SELECT sheet_id, '{k}' AS entity_type, x AS entity_surface, list_contains({s_ent('i', k)}, x)::INTEGER AS in_input, list_contains({s_ent('r', k)}, x)::INTEGER AS in_retrieval FROM (SELECT *, unnest({s_ent('o', k)}) AS x FROM j)" for k in ENT
)


@query(
    "ann02_entity_sheet",
    f"WITH {SHEET}, {REPORTS}, j AS (SELECT sheet_id, coalesce(gen_text, '') AS o, coalesce(sheet.input_text, '') AS i, coalesce(gt_text, '') AS r FROM sheet LEFT JOIN reports USING (row_id)), e AS ({_SHEET_SQL})"
    " SELECT *, CASE WHEN in_input = 1 THEN 'input' WHEN in_retrieval = 1 THEN 'retrieval' ELSE 'unattributed' END AS attribution FROM e",
)
def ann02(spark: SparkSession, d: str) -> DataFrame:
    rows = sheet(spark, d).join(reports(spark, d).select("row_id", "gt_text"), "row_id", "left")
    texts = [F.coalesce(c, F.lit("")) for c in ("gen_text", "input_text", "gt_text")]
    kinds = [F.struct(F.lit(k).alias("kind"), *[tx.entities(t, k).alias(n) for t, n in zip(texts, "oir")]) for k in tx.KINDS]
    long = rows.select("sheet_id", F.explode(F.array(*kinds)).alias("e")).select("sheet_id", "e.*")
    long = long.select("sheet_id", F.col("kind").alias("entity_type"), F.explode("o").alias("entity_surface"), "i", "r")
    long = long.select(
        "sheet_id", "entity_type", "entity_surface", F.array_contains("i", F.col("entity_surface")).cast("int").alias("in_input"),
        F.array_contains("r", F.col("entity_surface")).cast("int").alias("in_retrieval"),
    )
    label = F.when(F.col("in_input") == 1, "input").when(F.col("in_retrieval") == 1, "retrieval").otherwise("unattributed")
    return long.withColumn("attribution", label)


_COUNTS = ", ".join(f"len({s_ent('o', k)})::INTEGER AS n_{k.lower()}, len(list_filter({s_ent('o', k)}, lambda x: NOT list_contains({s_ent('i', k)}, x)))::INTEGER AS un_{k.lower()}" for k in ENT)


@query("ann01_row_sheet", f"WITH {SHEET}, j AS (SELECT sheet_id, coalesce(gen_text, '') AS o, coalesce(input_text, '') AS i FROM sheet) SELECT sheet_id, left(o, 500) AS excerpt, '' AS human_notes, {_COUNTS} FROM j")
def ann01(spark: SparkSession, d: str) -> DataFrame:
    o, i = F.coalesce("gen_text", F.lit("")), F.coalesce("input_text", F.lit(""))
    counts = []
    for k in tx.KINDS:
        counts += [F.size(tx.entities(o, k)).alias(f"n_{k.lower()}"), F.size(F.array_except(tx.entities(o, k), tx.entities(i, k))).alias(f"un_{k.lower()}")]
    return sheet(spark, d).select("sheet_id", tx.excerpt(o, 500).alias("excerpt"), F.lit("").alias("human_notes"), *counts)


@query("txt24_prompt_budget")
def txt24(spark: SparkSession, d: str) -> DataFrame:
    items, docs = table(spark, d, "test_items").select("item_id", "text"), table(spark, d, "documents").where("text is not null")
    hits = scan.bm25_topk(items, docs.select("doc_id", "text"), "item_id", "doc_id", "text", 3)
    packed = retrieval.exemplars(hits, docs, "doc_id", ["product", "text"]).withColumnRenamed("q", "item_id")
    rows = items.join(packed, "item_id", "left").withColumn("t", tx.truncated(tx.tokens(F.col("text")), 64, "head_tail"))
    rows = rows.withColumn("sizes", F.coalesce(F.transform("examples", lambda e: F.size(tx.truncated(tx.tokens(e["text"]), 96, "head"))), F.array().cast("array<int>")))
    rows = rows.withColumn("effective_k", tx.fitting_examples(F.col("sizes"), F.lit(256) - F.size("t")))
    rows = rows.withColumn("examples_tokens", F.aggregate(F.slice("sizes", F.lit(1), F.col("effective_k")), F.lit(0), lambda a, x: a + x))
    return rows.select(
        "item_id", F.size("t").alias("input_tokens"), "examples_tokens", F.size("sizes").alias("requested_k"), "effective_k",
        (F.size("sizes") - F.col("effective_k")).alias("examples_dropped"), (F.size("t") + F.col("examples_tokens")).alias("prompt_tokens"),
        (F.size(tx.tokens(F.col("text"))) > 64).alias("input_truncated"),
    )


@query("sco02_pair_cosine", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sco02(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


_MASKED = [s_tokens(s_mask(c, ("URL", "HASH", "FILE"))) for c in ("gt_text", "gen_text")]


@query(
    "sco03_rouge1_norm",
    f"WITH {REPORTS}, {SHEET}, t AS (SELECT sheet_id, {_MASKED[0]} AS a, {_MASKED[1]} AS b FROM sheet JOIN reports USING (row_id) WHERE gt_text IS NOT NULL AND gen_text IS NOT NULL),"
    " ca AS (SELECT sheet_id, w, count(*) AS c FROM (SELECT sheet_id, unnest(a) AS w FROM t) GROUP BY ALL), cb AS (SELECT sheet_id, w, count(*) AS c FROM (SELECT sheet_id, unnest(b) AS w FROM t) GROUP BY ALL),"
    " h AS (SELECT sheet_id, sum(least(ca.c, cb.c)) AS hit FROM ca JOIN cb USING (sheet_id, w) GROUP BY ALL)"
    " SELECT sheet_id, round(CASE WHEN len(a) > 0 THEN coalesce(hit, 0)::DOUBLE / len(a) ELSE 0 END, 6) AS rouge1_r_norm, round(CASE WHEN coalesce(hit, 0) > 0 THEN 2.0 * (hit::DOUBLE / len(b)) * (hit::DOUBLE / len(a)) / (hit::DOUBLE / len(b) + hit::DOUBLE / len(a)) ELSE 0 END, 6) AS rouge1_f1_norm FROM t LEFT JOIN h USING (sheet_id)",
)
def sco03(spark: SparkSession, d: str) -> DataFrame:
    rows = sheet(spark, d).join(reports(spark, d).select("row_id", "gt_text"), "row_id").where("gt_text is not null and gen_text is not null")
    rows = rows.select("sheet_id", *[tx.tokens(tx.similarity_form(F.col(c))).alias(n) for c, n in (("gt_text", "a"), ("gen_text", "b"))])
    scored = scoring.rouge1_rows(rows, "sheet_id", "a", "b")
    return scored.select("sheet_id", F.round("rouge1_r", 6).alias("rouge1_r_norm"), F.round("rouge1_f1", 6).alias("rouge1_f1_norm"))


@query(
    "agg08_direction",
    f"WITH {CANDIDATES}, m AS (SELECT pref_profile, model, avg(ua) FILTER (align_context = 'retrieval_aware') - avg(ua) FILTER (align_context = 'retrieval_free') AS delta FROM cand WHERE model IS NOT NULL AND pref_profile IS NOT NULL GROUP BY ALL)"
    " SELECT pref_profile, count(*) AS n_models, count_if(delta > 0)::BIGINT AS n_positive, count_if(delta < 0)::BIGINT AS n_negative, count_if(delta > 0) = count(*) OR count_if(delta < 0) = count(*) AS consistent, round(quantile_cont(delta, 0.5), 6) AS median_delta, string_agg(model, ';' ORDER BY model) AS models FROM m WHERE delta IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
)
def agg08(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda v: F.avg(F.when(F.col("align_context") == v, F.col("ua")))
    m = candidates(spark, d).where("model is not null and pref_profile is not null").groupBy("pref_profile", "model").agg((mean("retrieval_aware") - mean("retrieval_free")).alias("delta"))
    up, down, n = F.count_if(F.col("delta") > 0), F.count_if(F.col("delta") < 0), F.count("*")
    out = m.where("delta is not null").groupBy("pref_profile").agg(
        n.alias("n_models"), up.alias("n_positive"), down.alias("n_negative"), ((up == n) | (down == n)).alias("consistent"),
        F.round(F.percentile("delta", F.lit(0.5)), 6).alias("median_delta"), F.array_join(F.array_sort(F.collect_set("model")), ";").alias("models"),
    )
    return out.where("n_models >= 2")


@query("sam02_row_split", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format(chr(39) + '42|' + chr(39) + ' || doc_id::VARCHAR')}, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) + floor((n - floor(n * 0.8::DOUBLE)) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split_new FROM r")
def sam02(spark: SparkSession, d: str) -> DataFrame:
    return sampling.group_split(table(spark, d, "documents").select("doc_id"), "doc_id", 42)


def _s_kappa(x: str, y: str) -> str:
    return (
        f"(SELECT '{x}-{y}' AS pair, n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, count_if({x}_attr = {y}_attr)::DOUBLE / count(*) AS po FROM tp WHERE {x}_attr IS NOT NULL AND {y}_attr IS NOT NULL),"
        f" (SELECT sum(p * q) AS pe FROM (SELECT {x}_attr AS l, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM tp WHERE {x}_attr IS NOT NULL AND {y}_attr IS NOT NULL GROUP BY 1)"
        f" JOIN (SELECT {y}_attr AS l, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM tp WHERE {x}_attr IS NOT NULL AND {y}_attr IS NOT NULL GROUP BY 1) USING (l)) WHERE n >= 5)"
    )


# attribution of the entities that the first two annotators both call right
@query("sta13_attribution_agreement", f"WITH {_ENT}, {_LAB}, tp AS (SELECT * FROM lb WHERE a = 'TP' AND b = 'TP') " + " UNION ALL ".join(_s_kappa(x, y) for x, y in ("ab", "ac", "bc")))
def sta13(spark: SparkSession, d: str) -> DataFrame:
    tp = _labels(spark, d).where("a = 'TP' and b = 'TP'")
    pairs = [F.struct(F.lit(f"{x}-{y}").alias("pair"), F.col(f"{x}_attr").alias("x"), F.col(f"{y}_attr").alias("y")) for x, y in ("ab", "ac", "bc")]
    k = stats.kappa(tp.select(F.explode(F.array(*pairs)).alias("p")).select("p.*"), "x", "y", "pair").where("n >= 5")
    return k.select("pair", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("src05_word_list", "SELECT DISTINCT lower(placeholder) AS word FROM placeholders WHERE placeholder IS NOT NULL")
def src05(spark: SparkSession, d: str) -> DataFrame:
    from reportloom.sources.readers import word_list

    return word_list(table(spark, d, "placeholders"), "placeholder")


@query("scl16_condition_grid", f"WITH {SHEET}, m AS (SELECT DISTINCT model FROM sheet WHERE model IS NOT NULL), p AS (SELECT unnest(['balanced', 'structure', 'hard']) AS pref_profile) SELECT model, pref_profile, model || '|' || pref_profile AS key FROM m, p")
def scl16(spark: SparkSession, d: str) -> DataFrame:
    models = sheet(spark, d).where("model is not null").select("model").distinct()
    profiles = mining.policies(spark).select("pref_profile")
    return models.crossJoin(F.broadcast(profiles)).withColumn("key", tx.condition_key(F.col("model"), F.col("pref_profile")))  # three rows


@query("scl15_condition_filter", f"WITH {CANDIDATES} SELECT model, align_context, k, count(*) AS n FROM cand WHERE pref_profile = 'balanced' AND k IN (0, 1, 2) GROUP BY ALL")
def scl15(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).where("pref_profile = 'balanced' and k in (0, 1, 2)").groupBy("model", "align_context", "k").agg(F.count("*").alias("n"))
