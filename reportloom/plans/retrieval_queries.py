"""Queries on retrieval, joins, splits, samples and mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions import text as tx
from reportloom.operators import mining, retrieval, sampling, scan
from reportloom.plans.registry import query
from reportloom.plans.stats_queries import _S_SPLIT
from reportloom.plans.text_queries import s_squeeze, s_strip, s_tokens
from reportloom.plans.views import CANDIDATES, REPORTS, candidates, reports
from reportloom.session import table

_POST = (
    f"d AS (SELECT doc_id, {s_tokens('coalesce(text, chr(32))')} AS t FROM documents), post AS (SELECT doc_id, len(t) AS dl, w AS term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS w FROM d) GROUP BY ALL),"
    f" qd AS (SELECT item_id, {s_tokens('text')} AS t FROM test_items), q AS (SELECT item_id, w AS term, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS w FROM qd) GROUP BY ALL)"
)
_BM25 = f"""WITH {_POST}, n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 s AS (SELECT q.item_id, post.doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM q JOIN df USING (term) JOIN post USING (term) CROSS JOIN n GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
 SELECT item_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3"""


def _hits(best: DataFrame) -> DataFrame:
    return best.select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


@query("ret06_bm25_topk", _BM25)
def ret06(spark: SparkSession, d: str) -> DataFrame:
    items, docs = table(spark, d, "test_items").select(F.col("item_id"), "text"), table(spark, d, "documents").select("doc_id", "text")
    return _hits(scan.bm25_topk(items, docs, "item_id", "doc_id", "text", 3))


@query("ret02_bm25_terms", f"WITH {_POST}, n AS (SELECT count(*) AS n FROM d) SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM post, n GROUP BY term")
def ret02(spark: SparkSession, d: str) -> DataFrame:
    _, terms, _ = retrieval.bm25_index(table(spark, d, "documents"), "doc_id", "text")
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


_PAIRED = "list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"
_GRAMS = (
    f"WITH d AS (SELECT doc_id, {s_tokens('text')} AS t FROM documents), all_post AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_PAIRED.format(t='t')}) AS w FROM d WHERE len(t) > 0) GROUP BY ALL),"
    f" n AS (SELECT count(*) AS n FROM d), vocab AS (SELECT term, count(*) AS df, row_number() OVER (ORDER BY sum(tf) DESC, term) AS place FROM all_post GROUP BY term),"
    f" idf AS (SELECT term, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM vocab, n WHERE place <= {retrieval.MOST_TERMS})"
)
_TFIDF = f"""{_GRAMS}, qd AS (SELECT item_id, {s_tokens('text')} AS t FROM test_items), q AS (SELECT item_id, w AS term, count(*) AS qtf FROM (SELECT item_id, unnest({_PAIRED.format(t='t')}) AS w FROM qd WHERE len(t) > 0) GROUP BY ALL),
 dv AS (SELECT doc_id, term, tf * idf AS w FROM all_post JOIN idf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM dv GROUP BY ALL),
 qv AS (SELECT item_id, term, qtf * idf AS w FROM q JOIN idf USING (term)), qn AS (SELECT item_id, sqrt(sum(w * w)) AS z FROM qv GROUP BY ALL),
 s AS (SELECT item_id, doc_id, sum(qv.w / qn.z * dv.w / dn.z) AS score FROM qv JOIN qn USING (item_id) JOIN dv USING (term) JOIN dn USING (doc_id) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
 SELECT item_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3"""


@query("ret01_tfidf_terms", f"{_GRAMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def ret01(spark: SparkSession, d: str) -> DataFrame:
    return scan.tfidf_terms(table(spark, d, "documents"), "doc_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


@query("ret05_tfidf_topk", _TFIDF)
def ret05(spark: SparkSession, d: str) -> DataFrame:
    items, docs = table(spark, d, "test_items").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text")
    return _hits(scan.tfidf_topk(items, docs, "item_id", "doc_id", "text", 3))


@query(
    "ret04_dense_topk",
    "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS q, b.vec_id, list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM q JOIN embeddings b ON q.vec_id <> b.vec_id),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, vec_id) AS rank FROM s) SELECT q, vec_id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5",
)
def ret04(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "embeddings")
    return scan.dense_topk(base.where("vec_id % 100 = 0"), base, "vec_id", "vec_id", "embedding", 5).select("q", "vec_id", F.round("score", 4).alias("score"), "rank")


_EXCL = _BM25[: _BM25.index(" r AS (SELECT *")].replace("test_items", "(SELECT doc_id AS item_id, text FROM documents WHERE doc_id % 100 = 0)") + """
 k AS (SELECT doc_id, ticket_key FROM documents), f AS (SELECT s.* FROM s LEFT JOIN k a ON a.doc_id = s.item_id LEFT JOIN k b ON b.doc_id = s.doc_id
  WHERE s.item_id <> s.doc_id AND (a.ticket_key IS NULL OR b.ticket_key IS NULL OR a.ticket_key <> b.ticket_key)),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM f)
 SELECT item_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 2"""


@query("ret09_exclusion", _EXCL)
def ret09(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "ticket_key")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("item_id"), "text", "ticket_key")
    return _hits(scan.bm25_topk(asked, docs, "item_id", "doc_id", "text", 2, "ticket_key", "ticket_key"))


@query("ret10_random_k")
def ret10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("ticket_key").alias("group_id"))
    return retrieval.random_k(docs, docs, 2, 42)


@query(
    "ret12_exemplars",
    _BM25.replace("SELECT item_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3", "SELECT item_id, string_agg(coalesce(product, '') || ':' || text, ' ## ' ORDER BY rank) AS examples FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id"),
)
def ret12(spark: SparkSession, d: str) -> DataFrame:
    items, docs = table(spark, d, "test_items").select("item_id", "text"), table(spark, d, "documents")
    hits = scan.bm25_topk(items, docs.select("doc_id", "text"), "item_id", "doc_id", "text", 3)
    packed = retrieval.exemplars(hits, docs, "doc_id", ["product", "text"])
    whole = lambda e: F.concat(F.coalesce(e["product"], F.lit("")), F.lit(":"), e["text"])
    return packed.select(F.col("q").alias("item_id"), F.array_join(F.transform("examples", whole), " ## ").alias("examples"))


_KEYED = f"{REPORTS}, keyed AS (SELECT row_id, sha1({s_squeeze('gt_text')}) AS group_id FROM reports WHERE gt_text IS NOT NULL)"
_DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@query(
    "sam01_group_split",
    f"WITH {_KEYED}, g AS (SELECT group_id, row_number() OVER (ORDER BY {_DRAW.format(chr(39) + '42|' + chr(39) + ' || group_id')}, group_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM keyed))"
    " SELECT row_id, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) + floor((n - floor(n * 0.8::DOUBLE)) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split_new FROM keyed JOIN g USING (group_id)",
)
def sam01(spark: SparkSession, d: str) -> DataFrame:
    keyed = reports(spark, d).where("gt_text is not null").select("row_id", tx.text_key(F.col("gt_text")).alias("group_id"))
    return sampling.group_split(keyed, "group_id", 42).select("row_id", "split_new")


@query("joi03_leak_check", f"WITH {REPORTS} SELECT group_id, count(DISTINCT s) AS splits FROM (SELECT sha1({s_squeeze('gt_text')}) AS group_id, {_S_SPLIT} AS s FROM reports WHERE gt_text IS NOT NULL) GROUP BY ALL HAVING count(DISTINCT s) > 1")
def joi03(spark: SparkSession, d: str) -> DataFrame:
    rows = reports(spark, d).where("gt_text is not null").select(tx.text_key(F.col("gt_text")).alias("group_id"), tx.split_name(F.col("split")).alias("s"))
    return sampling.leaks(rows, "group_id", "s")


@query(
    "sam05_downsample",
    f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format(chr(39) + '7|' + chr(39) + ' || doc_id::VARCHAR')}, doc_id) AS n FROM documents) WHERE n <= 50",
)
def sam05(spark: SparkSession, d: str) -> DataFrame:
    return sampling.per_stratum(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 50, 7)


@query(
    "sam03_two_strata",
    f"WITH e AS (SELECT DISTINCT entity_id, in_input = 1 AS has FROM entity_level_annota WHERE entity_id IS NOT NULL), h AS (SELECT entity_id, coalesce(bool_or(has), false) AS has FROM e GROUP BY ALL), c AS (SELECT count(*) FILTER (has) AS y, count(*) FILTER (NOT has) AS n FROM h),"
    f" r AS (SELECT *, row_number() OVER (PARTITION BY has ORDER BY {_DRAW.format(chr(39) + '3|' + chr(39) + ' || entity_id::VARCHAR')}, entity_id) AS i FROM h)"
    " SELECT entity_id, has FROM r, c WHERE i <= CASE WHEN has THEN least(greatest(70, 100 - n), y) ELSE least(greatest(30, 100 - y), n) END",
)
def sam03(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_level_annota").where("entity_id is not null")
    e = e.groupBy("entity_id").agg(F.coalesce(F.bool_or(F.col("in_input") == 1), F.lit(False)).alias("has"))
    return sampling.two_strata(e, "has", "entity_id", 100, 0.7, 3)


@query(
    "joi04_prompt_membership",
    f"WITH {CANDIDATES}, p AS (SELECT DISTINCT row_id FROM dpo_pairs WHERE row_id IS NOT NULL) SELECT row_id, count(*) AS candidates, row_id IN (SELECT row_id FROM p) AS mined FROM cand GROUP BY row_id",
)
def joi04(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "dpo_pairs").where("row_id is not null").select("row_id").distinct().withColumn("known", F.lit(True))
    per = candidates(spark, d).groupBy("row_id").agg(F.count("*").alias("candidates"))
    return per.join(known, "row_id", "left").select("row_id", "candidates", F.coalesce("known", F.lit(False)).alias("mined"))


_USABLE = (
    "u AS (SELECT row_id, coalesce(candidate_index, 1000000000) AS candidate_index, coalesce(candidate_rank, 1000000000) AS candidate_rank, coalesce(score, 0.0) AS score,"
    f" coalesce(nullif(ua, 'NaN'::DOUBLE), 0.0) AS ua, coalesce(nullif(cond, 'NaN'::DOUBLE), 0.0) AS cond, {s_strip("coalesce(candidate_text, '')")} AS candidate_text FROM cand)"
)


def _s_mine(rule: str, p: mining.Policy) -> str:
    key = "candidate_rank, score DESC, candidate_index" if rule == "remine" else "score DESC, candidate_index"
    capped = p.uahe_cap > 0 if rule == "mine" else p.uahe_cap >= 0
    cap = f" WHEN ua > {p.uahe_cap} THEN 'uahe_cap'" if capped else ""
    order = " AND r.ua >= b.ua" if p.uahe_order or rule == "sweep" else ""
    slack = " + 1e-12" if rule == "remine" else ""
    once = " AND r.candidate_text <> ''" if rule == "remine" else ""
    dedup = "f2 AS (SELECT *, row_number() OVER (PARTITION BY row_id, candidate_text ORDER BY candidate_rank DESC, score, candidate_index DESC) AS c FROM f), g AS (SELECT * FROM f2 WHERE c = 1)" if rule == "remine" else "g AS (SELECT * FROM f)"
    none = "no_valid_reject" if rule == "sweep" else "no_reject"
    worst = "candidate_rank DESC, score, candidate_index DESC" if rule == "remine" else "score, candidate_index DESC"
    return f"""WITH {CANDIDATES}, {_USABLE}, o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {key}) AS place FROM u),
 b AS (SELECT *, CASE WHEN score < {p.quality_floor} THEN 'below_quality_floor'{cap} WHEN cond < {p.min_cond} THEN 'min_cond' ELSE 'ok' END AS why FROM o WHERE place = 1),
 f AS (SELECT r.* FROM u r JOIN b USING (row_id) WHERE b.why = 'ok' AND r.candidate_index <> b.candidate_index AND b.score - r.score{slack} >= {p.margin}::DOUBLE AND r.candidate_text IS DISTINCT FROM b.candidate_text{order}{once}),
 {dedup}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {worst}) AS pair_no FROM g)
 SELECT b.row_id, CASE WHEN b.why = 'ok' AND k.pair_no IS NULL THEN '{none}' ELSE b.why END AS reason, k.pair_no::INTEGER AS pair_no, CASE WHEN k.pair_no IS NOT NULL THEN b.candidate_index END AS chosen_index,
  k.candidate_index AS rejected_index, CASE WHEN k.pair_no IS NOT NULL THEN b.score END AS chosen_score, k.score AS rejected_score
 FROM b LEFT JOIN (SELECT * FROM k WHERE pair_no <= {1 if rule == 'sweep' else p.pairs}) k ON k.row_id = b.row_id"""


_MINE = mining.Policy(min_cond=0.5)


@query("min02_mine", _s_mine("mine", _MINE))
def min02(spark: SparkSession, d: str) -> DataFrame:
    return mining.mine(candidates(spark, d), _MINE, "mine")


@query("min03_remine", _s_mine("remine", mining.POLICIES["balanced"]))
def min03(spark: SparkSession, d: str) -> DataFrame:
    return mining.mine(candidates(spark, d), mining.POLICIES["balanced"], "remine")


@query("min03_remine_hard", _s_mine("remine", mining.POLICIES["hard"]))
def min03_hard(spark: SparkSession, d: str) -> DataFrame:
    return mining.mine(candidates(spark, d), mining.POLICIES["hard"], "remine")


@query("min05_sweep_rule", _s_mine("sweep", mining.Policy(uahe_cap=5.0)))
def min05_rule(spark: SparkSession, d: str) -> DataFrame:
    return mining.mine(candidates(spark, d), mining.Policy(uahe_cap=5.0), "sweep")


_GRID = ", ".join(f"(SELECT unnest([{', '.join(map(str, v))}])::DOUBLE AS {k}) t_{k}" for k, v in mining.GRID.items())


@query(
    "min05_sweep",
    f"WITH {CANDIDATES}, {_USABLE}, o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, candidate_index) AS place FROM u), b AS (SELECT * FROM o WHERE place = 1),"
    " gap AS (SELECT b.row_id, max(b.score - r.score) AS gap FROM b JOIN u r USING (row_id) WHERE r.candidate_index <> b.candidate_index AND r.candidate_text IS DISTINCT FROM b.candidate_text AND r.ua >= b.ua GROUP BY ALL),"
    f" p AS (SELECT b.row_id, score, ua, cond, gap FROM b LEFT JOIN gap USING (row_id)), g AS (SELECT * FROM {_GRID}),"
    " w AS (SELECT *, CASE WHEN score < quality_floor THEN 'below_quality_floor' WHEN uahe_cap >= 0 AND ua > uahe_cap THEN 'uahe_cap' WHEN cond < min_cond THEN 'min_cond' WHEN coalesce(gap >= margin, false) THEN 'ok' ELSE 'no_valid_reject' END AS why FROM p, g)"
    " SELECT margin, quality_floor, uahe_cap, min_cond, count(*) AS prompts_total, count_if(why = 'ok')::BIGINT AS prompts_kept, count_if(why = 'ok')::BIGINT AS pairs, round(count_if(why = 'ok')::DOUBLE / count(*), 4) AS pass_rate,"
    + ", ".join(f" count_if(why = '{r}')::BIGINT AS reject_{r}" for r in ("below_quality_floor", "uahe_cap", "min_cond", "no_valid_reject")) + " FROM w GROUP BY ALL",
)
def min05(spark: SparkSession, d: str) -> DataFrame:
    return mining.sweep(candidates(spark, d), spark)


@query(
    "agg10_audit",
    _s_mine("remine", mining.POLICIES["balanced"]).replace("SELECT b.row_id, CASE", ", z AS (SELECT b.row_id, CASE", 1).replace("SELECT b.row_id, CASE WHEN b.why", "SELECT b.row_id, CASE WHEN b.why").replace("\n , z AS", ", z AS")
    + "), y AS (SELECT row_id, any_value(reason) AS why, count(pair_no) AS pairs FROM z GROUP BY row_id) SELECT count(*) AS prompts_total, count_if(why = 'ok')::BIGINT AS prompts_kept, sum(pairs)::BIGINT AS pairs, round(count_if(why = 'ok')::DOUBLE / count(*), 4) AS pass_rate,"
    + ", ".join(f" count_if(why = '{r}')::BIGINT AS reject_{r}" for r in mining.REASONS) + " FROM y",
)
def agg10(spark: SparkSession, d: str) -> DataFrame:
    return mining.audit(min03(spark, d))


@query("min07_policies", "SELECT * FROM (VALUES ('balanced', 0.0::DOUBLE, 0.05::DOUBLE, -1.0::DOUBLE, 0.6::DOUBLE, false, 2), ('structure', 0.0, 0.05, -1.0, 0.6, false, 2), ('hard', 0.0, 0.03, 0.0, 0.6, true, 2)) t(pref_profile, quality_floor, margin, uahe_cap, min_cond, uahe_order, pairs)")
def min07(spark: SparkSession, d: str) -> DataFrame:
    return mining.policies(spark)


@query("min01_ranked", f"WITH {CANDIDATES} SELECT row_id, candidate_index, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, candidate_index)::INTEGER AS place FROM cand WHERE score IS NOT NULL")
def min01(spark: SparkSession, d: str) -> DataFrame:
    return mining.ranked(candidates(spark, d).where("score is not null")).select("row_id", "candidate_index", "place")
