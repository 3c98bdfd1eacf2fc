"""Queries on text: cleaning, tokens, entities, attribution, sections, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions import scoring, sections
from reportloom.functions import text as tx
from reportloom.plans.registry import query
from reportloom.plans.views import CANDIDATES, REPORTS, SHEET, candidates, reports, sheet
from reportloom.session import table

W = r"[\s\x0B\x{85}\p{Z}]"  # Unicode white space in RE2


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def s_squeeze(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '{W}+', ' ', 'g')")


def s_clean(x: str) -> str:
    t = s_strip(f"coalesce({x}, '')")
    return f"CASE WHEN lower({t}) IN ('nan', 'none', 'null') THEN '' ELSE {t} END"


def s_words(x: str) -> str:
    """White-space word count."""
    return f"len(list_filter(regexp_split_to_array({x}, '{W}+'), lambda w: w <> ''))"


def s_tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w))"


ENT = {
    "URL": f"(?i)https?://[^{W[1:-1]}]+|www\\.[^{W[1:-1]}]+",
    "HASH": r"(?i)\b[a-f0-9]{7,40}\b",
    "FILE": r"(?i)\b[\p{L}\p{N}_\-.]+\.(?:gif|png|jpg|jpeg|webp|mp4|mov|avi|log|txt|csv|json|xml)\b",
    "FLAG": r"(?i)\b[a-zA-Z_]+\.[a-zA-Z0-9_.]+\b(?::(?:true|false))?",
}


def s_all(x: str, kind: str) -> str:
    return f"regexp_extract_all({x}, '{ENT[kind]}')"


def s_ent(x: str, kind: str) -> str:
    found = f"list_distinct({s_all(x, kind)})"
    return found if kind != "FLAG" else f"list_filter({found}, lambda f: NOT list_contains({s_all(x, 'FILE')}, f))"


@query("scl01_clean_cell", f"WITH {REPORTS} SELECT row_id, {s_clean('input_text')} AS input_clean, {s_clean('author')} AS author_clean FROM reports")
def scl01(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).select("row_id", tx.clean_cell(F.col("input_text")).alias("input_clean"), tx.clean_cell(F.col("author")).alias("author_clean"))


@query("scl02_squeeze", f"WITH {REPORTS} SELECT row_id, {s_squeeze('gt_text')} AS squeezed FROM reports")
def scl02(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).select("row_id", tx.squeeze(F.col("gt_text")).alias("squeezed"))


@query("scl03_text_key", f"WITH {REPORTS} SELECT row_id, sha1({s_squeeze('gt_text')}) AS group_id, left(sha1(gt_text), 12) AS short_id FROM reports WHERE gt_text IS NOT NULL")
def scl03(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).where("gt_text is not null").select("row_id", tx.text_key(F.col("gt_text")).alias("group_id"), tx.short_key(F.col("gt_text")).alias("short_id"))


def s_name(x: str) -> str:
    t = s_strip(f"coalesce({x}, '')")
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"CASE WHEN {t} = '' THEN 'none' ELSE {t} END"


@query("scl05_safe_name", f"WITH {REPORTS} SELECT row_id, {s_name('author')} AS author_name, {s_name('source')} AS source_name FROM reports")
def scl05(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).select("row_id", tx.safe_name(F.col("author")).alias("author_name"), tx.safe_name(F.col("source")).alias("source_name"))


@query(
    "scl06_both_texts",
    f"WITH {REPORTS} SELECT row_id, length(i)::INTEGER AS n_input, length(g)::INTEGER AS n_gt FROM (SELECT row_id, {s_clean('input_text')} AS i, {s_clean('gt_text')} AS g FROM reports) WHERE i <> '' AND g <> ''",
)
def scl06(spark: SparkSession, d: str) -> DataFrame:
    both = reports(spark, d).select("row_id", tx.clean_cell(F.col("input_text")).alias("i"), tx.clean_cell(F.col("gt_text")).alias("g"))
    return both.where("i <> '' and g <> ''").select("row_id", F.length("i").alias("n_input"), F.length("g").alias("n_gt"))


@query(
    "scl07_condition_key",
    f"WITH {SHEET}, c AS (SELECT DISTINCT coalesce(model, '') || '|' || coalesce(adapter_type, '') || '|' || coalesce(condition_id, '') AS key FROM sheet)"
    " SELECT key, string_split(key, '|')[3] AS tail, string_split(key, '|')[1] || '|' || string_split(key, '|')[2] AS head FROM c",
)
def scl07(spark: SparkSession, d: str) -> DataFrame:
    keys = sheet(spark, d).select(tx.condition_key(F.col("model"), F.col("adapter_type"), F.col("condition_id")).alias("key")).distinct()
    return keys.select("key", tx.last_part(F.col("key")).alias("tail"), tx.before_last(F.col("key")).alias("head"))


@query("scl09_excerpts", "SELECT doc_id, left(text, 300) AS p300, left(text, 1000) AS p1000 FROM documents WHERE text IS NOT NULL")
def scl09(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", tx.excerpt(F.col("text"), 300).alias("p300"), tx.excerpt(F.col("text"), 1000).alias("p1000"))


@query(
    "scl10_context_window",
    "WITH e AS (SELECT DISTINCT entity_id, gen_context AS t, entity_surface AS s FROM entity_level_annota WHERE gen_context IS NOT NULL AND entity_surface IS NOT NULL),"
    " p AS (SELECT *, instr(t, s) AS a FROM e) SELECT entity_id, t, s, CASE WHEN a > 0 THEN (CASE WHEN a - 20 > 1 THEN '...' ELSE '' END) || substr(t, greatest(1, a - 20), least(length(t), a + length(s) - 1 + 20) - greatest(1, a - 20) + 1)"
    " || (CASE WHEN a + length(s) - 1 + 20 < length(t) THEN '...' ELSE '' END) END AS around FROM p",
)
def scl10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_level_annota").where("gen_context is not null and entity_surface is not null")
    e = e.select("entity_id", F.col("gen_context").alias("t"), F.col("entity_surface").alias("s")).distinct()
    return e.withColumn("around", tx.window_around(F.col("t"), F.col("s"), 20))


@query(
    "scl11_list_render",
    f"WITH {SHEET} SELECT sheet_id, array_to_string(list_slice(list_sort({s_ent('gen_text', 'FLAG')}), 1, 20), '; ') AS flags FROM sheet WHERE gen_text IS NOT NULL",
)
def scl11(spark: SparkSession, d: str) -> DataFrame:
    rows = sheet(spark, d).where("gen_text is not null")
    return rows.select("sheet_id", F.array_join(F.slice(F.array_sort(tx.entities(F.col("gen_text"), "FLAG")), 1, 20), "; ").alias("flags"))


@query("scl12_numeric", "SELECT doc_id, coalesce(try_cast(split_part(ticket_key, '-', 2) AS DOUBLE), 0) AS n FROM documents")
def scl12(spark: SparkSession, d: str) -> DataFrame:
    part = F.split_part(F.col("ticket_key"), F.lit("-"), F.lit(2))
    return table(spark, d, "documents").select("doc_id", F.coalesce(part.try_cast("double"), F.lit(0.0)).alias("n"))


@query("scl13_head", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def scl13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").limit(100)


@query("txt01_tokens", f"SELECT doc_id, {s_tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL")
def txt01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@query("txt02_word_count", f"SELECT doc_id, {s_words('text')}::INTEGER AS words FROM documents WHERE text IS NOT NULL")
def txt02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.word_count(F.col("text")).alias("words"))


def s_counts(x: str) -> str:
    return ", ".join(f"len({s_ent(x, k)})::INTEGER AS n_{k.lower()}" for k in ENT)


@query("txt15_entities", f"WITH {SHEET} SELECT sheet_id, {s_counts('gen_text')} FROM sheet WHERE gen_text IS NOT NULL")
def txt15(spark: SparkSession, d: str) -> DataFrame:
    rows = sheet(spark, d).where("gen_text is not null")
    return rows.select("sheet_id", *[F.size(tx.entities(F.col("gen_text"), k)).alias(f"n_{k.lower()}") for k in tx.KINDS])


@query(
    "txt16_entities_any_case",
    f"SELECT doc_id, len(list_filter(list_distinct({s_all('text', 'FLAG')}), lambda f: NOT list_contains(list_transform({s_all('text', 'FILE')}, lambda x: lower(x)), lower(f))))::INTEGER AS n_flag"
    " FROM documents WHERE text IS NOT NULL",
)
def txt16(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(tx.entities(F.col("text"), "FLAG", any_case=True)).alias("n_flag"))


def attributed(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their input, the true report as retrieved text, and attribution counts per kind."""
    rows = sheet(spark, d).join(reports(spark, d).select("row_id", "gt_text"), "row_id", "left")
    text = {c: F.coalesce(c, F.lit("")) for c in ("gen_text", "input_text", "gt_text")}
    for k in tx.KINDS:
        rows = rows.withColumn(f"a_{k}", tx.attribution(*[tx.entities(text[c], k) for c in ("gen_text", "input_text", "gt_text")]))
    rows = rows.withColumn("tokens", F.size(tx.tokens(text["gen_text"])))
    for name in ("input", "retrieval", "unattributed"):
        rows = rows.withColumn(name, sum((F.col(f"a_{k}")[name] for k in tx.KINDS[1:]), F.col(f"a_{tx.KINDS[0]}")[name]))
    return rows


def _s_attribution() -> str:
    parts = []
    for k in ENT:
        o, i, r = (s_ent(f"coalesce({c}, '')", k) for c in ("gen_text", "input_text", "gt_text"))
        parts.append(f"{o} AS o_{k}, {i} AS i_{k}, {r} AS r_{k}")
    sums = {
        "n_input": " + ".join(f"len(list_filter(o_{k}, lambda x: list_contains(i_{k}, x)))" for k in ENT),
        "n_retrieval": " + ".join(f"len(list_filter(o_{k}, lambda x: NOT list_contains(i_{k}, x) AND list_contains(r_{k}, x)))" for k in ENT),
        "n_unattributed": " + ".join(f"len(list_filter(o_{k}, lambda x: NOT list_contains(i_{k}, x) AND NOT list_contains(r_{k}, x)))" for k in ENT),
    }
    return (
        f"WITH {SHEET}, {REPORTS}, j AS (SELECT sheet_id, sheet.row_id, model, adapter_type, condition_id, gen_text, gt_text, sheet.input_text FROM sheet LEFT JOIN reports USING (row_id)),"
        f" e AS (SELECT sheet_id, row_id, model, adapter_type, condition_id, len({s_tokens('coalesce(gen_text, chr(32))')}) AS tokens, {', '.join(parts)} FROM j),"
        f" att AS (SELECT sheet_id, row_id, model, adapter_type, condition_id, tokens, {', '.join(f'{v} AS {k}' for k, v in sums.items())} FROM e)"
    )


ATT = _s_attribution()


@query("txt18_attribution", ATT + " SELECT sheet_id, n_input::INTEGER AS n_input, n_retrieval::INTEGER AS n_retrieval, n_unattributed::INTEGER AS n_unattributed FROM att")
def txt18(spark: SparkSession, d: str) -> DataFrame:
    return attributed(spark, d).select(
        "sheet_id", F.col("input").alias("n_input"), F.col("retrieval").alias("n_retrieval"), F.col("unattributed").alias("n_unattributed")
    )


@query(
    "txt19_attribution_rates",
    ATT + " SELECT sheet_id, round(n_retrieval / greatest(1.0, n_retrieval + n_unattributed), 6) AS transfer_rate, round((n_input + n_retrieval) / greatest(1.0, n_input + n_retrieval + n_unattributed), 6) AS support_rate,"
    " round(1000.0 * n_unattributed / greatest(1, tokens), 6) AS uahe_per_1k, round(1000.0 * (n_retrieval + n_unattributed) / greatest(1, tokens), 6) AS iuhe_per_1k FROM att",
)
def txt19(spark: SparkSession, d: str) -> DataFrame:
    r, u, i = F.col("retrieval"), F.col("unattributed"), F.col("input")
    return attributed(spark, d).select(
        "sheet_id", F.round(tx.ratio(r, (r + u).cast("double")), 6).alias("transfer_rate"),
        F.round(tx.ratio(i + r, (i + r + u).cast("double")), 6).alias("support_rate"),
        F.round(1000.0 * tx.ratio(u, F.col("tokens").cast("double")), 6).alias("uahe_per_1k"),
        F.round(1000.0 * tx.ratio(r + u, F.col("tokens").cast("double")), 6).alias("iuhe_per_1k"),
    )


def s_mask(x: str, kinds: tuple[str, ...]) -> str:
    for k in kinds:
        x = f"regexp_replace({x}, '{ENT[k]}', '<{k}>', 'g')"
    return x


@query(
    "txt20_masks",
    f"WITH {REPORTS} SELECT row_id, {s_mask('gt_text', ('URL', 'HASH', 'FILE', 'FLAG'))} AS masked, {s_mask('gt_text', ('URL', 'HASH', 'FILE'))} AS compared FROM reports WHERE gt_text IS NOT NULL",
)
def txt20(spark: SparkSession, d: str) -> DataFrame:
    rows = reports(spark, d).where("gt_text is not null")
    return rows.select("row_id", tx.masked(F.col("gt_text")).alias("masked"), tx.similarity_form(F.col("gt_text")).alias("compared"))


@query(
    "txt22_truncation",
    f"WITH {REPORTS}, t AS (SELECT row_id, {s_tokens('gt_text')} AS t FROM reports WHERE gt_text IS NOT NULL) SELECT row_id, array_to_string(list_slice(t, 1, 16), ' ') AS head,"
    " array_to_string(CASE WHEN len(t) <= 16 THEN t ELSE list_slice(t, len(t) - 15, len(t)) END, ' ') AS tail,"
    " array_to_string(CASE WHEN len(t) <= 15 THEN t ELSE list_concat(list_slice(t, 1, 7), list_slice(t, len(t) - 7, len(t))) END, ' ') AS both FROM t",
)
def txt22(spark: SparkSession, d: str) -> DataFrame:
    rows = reports(spark, d).where("gt_text is not null").select("row_id", tx.tokens(F.col("gt_text")).alias("t"))
    cut = {"head": tx.truncated(F.col("t"), 16, "head"), "tail": tx.truncated(F.col("t"), 16, "tail"), "both": tx.truncated(F.col("t"), 15, "head_tail")}
    return rows.select("row_id", *[F.array_join(c, " ").alias(k) for k, c in cut.items()])


# Sections: the SQL takes the lines apart and groups them again, independent of the array form.
_CANON = """CASE WHEN h LIKE '%step%' AND (h LIKE '%reproduce%' OR h LIKE '%repro%') THEN 'steps' WHEN h LIKE '%expected%' THEN 'expected' WHEN h LIKE '%actual%' THEN 'actual'
 WHEN h LIKE '%affected version%' OR h IN ('version', 'versions') THEN 'env_versions' WHEN h LIKE '%platform%' OR h = 'os' THEN 'env_platforms' WHEN h LIKE '%environment%' THEN 'environment'
 WHEN h LIKE '%regression%' THEN 'regression' WHEN h LIKE '%note%' OR h LIKE '%additional%' THEN 'notes' WHEN h LIKE '%evidence%' OR h LIKE '%attachment%' OR h LIKE '%log%' THEN 'evidence'
 WHEN h LIKE '%summary%' THEN 'summary' ELSE h END"""
_SECTIONS = f"""
, ln AS (SELECT sheet_id, unnest(string_split(gen_text, chr(10))) AS raw, unnest(range(1, len(string_split(gen_text, chr(10))) + 1)) AS i FROM sheet WHERE gen_text IS NOT NULL),
st AS (SELECT *, {s_strip('raw')} AS s FROM ln),
hd AS (SELECT *, CASE WHEN regexp_matches(s, '^\\*\\*.+?\\*\\*') THEN regexp_extract(s, '^\\*\\*(.+?)\\*\\*\\s*:?\\s*(.*)$', 1) WHEN regexp_matches(s, '^\\[.+?\\]') THEN regexp_extract(s, '^\\[(.+?)\\]\\s*:?\\s*(.*)$', 1) END AS head,
  CASE WHEN regexp_matches(s, '^\\*\\*.+?\\*\\*') THEN regexp_extract(s, '^\\*\\*(.+?)\\*\\*\\s*:?\\s*(.*)$', 2) WHEN regexp_matches(s, '^\\[.+?\\]') THEN regexp_extract(s, '^\\[(.+?)\\]\\s*:?\\s*(.*)$', 2) END AS rest FROM st),
sec AS (SELECT *, sum(CASE WHEN head IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id ORDER BY i) AS no FROM hd),
grp AS (SELECT sheet_id, no, min(i) AS i, trim(regexp_replace(lower(max(head)), '[^a-z0-9]+', ' ', 'g')) AS h,
  {s_strip("string_agg(CASE WHEN head IS NOT NULL THEN rest ELSE raw END, chr(10) ORDER BY i)")} AS body FROM sec WHERE no > 0 GROUP BY sheet_id, no),
parts AS (SELECT sheet_id, no, {_CANON} AS name, body FROM grp),
firsts AS (SELECT sheet_id, name, arg_min(body, no) AS body, count(*) AS times FROM parts GROUP BY ALL),
facts AS (SELECT *, body = '' OR regexp_matches(body, '<[^>]{{1,100}}>') OR regexp_matches(body, '(?i)\\b(?:tbd|todo|n/a|na)\\b') OR regexp_matches(body, '^[.{W[1:-1]}]+$') AS ph,
  body = '' OR regexp_matches(body, '(?i)\\b(?:not provided|unknown|unspecified|not available)\\b') AS un, {s_words('body')} AS nw,
  len(list_filter(string_split(body, chr(10)), lambda l: regexp_matches({s_strip('l')}, '^(?:\\d+[.)]|[-*]){W}'))) AS steps, regexp_matches(body, '\\d') AS digit FROM firsts),
wide AS (SELECT sheet_id,
  bool_or(name = 'steps') AS ps, bool_or(name = 'expected') AS pe, bool_or(name = 'actual') AS pa, bool_or(name IN ('environment', 'env_versions', 'env_platforms')) AS pv,
  bool_or(name = 'steps' AND ph) AS hs, bool_or(name = 'expected' AND ph) AS he, bool_or(name = 'actual' AND ph) AS ha,
  coalesce(bool_and(ph) FILTER (WHERE name IN ('environment', 'env_versions', 'env_platforms')), true) AS hv,
  bool_or(name = 'steps' AND un) AS us, bool_or(name = 'expected' AND un) AS ue, bool_or(name = 'actual' AND un) AS ua,
  coalesce(bool_and(un) FILTER (WHERE name IN ('environment', 'env_versions', 'env_platforms')), true) AS uv,
  bool_or(name = 'steps' AND steps >= 2) AS fs, bool_or(name = 'expected' AND NOT ph AND nw >= 5) AS fe, bool_or(name = 'actual' AND NOT ph AND nw >= 5) AS fa,
  bool_or(name IN ('environment', 'env_versions', 'env_platforms') AND NOT ph AND NOT un AND (nw >= 2 OR digit)) AS fv,
  sum(CASE WHEN name IN ('steps', 'expected', 'actual', 'environment', 'env_versions', 'env_platforms', 'regression', 'notes', 'evidence') THEN times - 1 ELSE 0 END) AS dup,
  coalesce(max(steps) FILTER (WHERE name = 'steps'), 0) AS nsteps FROM facts GROUP BY sheet_id),
metrics AS (SELECT s.sheet_id, s.row_id, s.input_text, s.model, s.adapter_type, s.condition_id, coalesce(ps, false) AS ps, coalesce(pe, false) AS pe, coalesce(pa, false) AS pa, coalesce(pv, false) AS pv,
  NOT coalesce(ps, false) OR hs AS hs, NOT coalesce(pe, false) OR he AS he, NOT coalesce(pa, false) OR ha AS ha, coalesce(hv, true) AS hv,
  NOT coalesce(ps, false) OR us AS us, NOT coalesce(pe, false) OR ue AS ue, NOT coalesce(pa, false) OR ua AS ua, coalesce(uv, true) AS uv,
  coalesce(fs, false) AS fs, coalesce(fe, false) AS fe, coalesce(fa, false) AS fa, coalesce(fv, false) AS fv, coalesce(dup, 0) AS dup, coalesce(nsteps, 0) AS nsteps, {s_words('gen_text')} AS words
  FROM sheet s LEFT JOIN wide USING (sheet_id) WHERE gen_text IS NOT NULL)"""


def with_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.with_sections(sheet(spark, d).where("gen_text is not null"), "gen_text", "parts")


@query("txt06_sections", f"WITH {SHEET} {_SECTIONS} SELECT sheet_id, name, count(*) AS times, arg_min(body, no) AS body FROM parts GROUP BY ALL")
def txt06(spark: SparkSession, d: str) -> DataFrame:
    parts = with_sections(spark, d).select("sheet_id", F.posexplode("parts")).select("sheet_id", "pos", "col.*")
    return parts.groupBy("sheet_id", "name").agg(F.count("*").alias("times"), F.min_by("body", "pos").alias("body"))


@query(
    "txt11_section_metrics",
    f"WITH {SHEET} {_SECTIONS} SELECT sheet_id, (ps::INT + pe::INT + pa::INT + pv::INT) / 4.0::DOUBLE AS sec_presence, (fs::INT + fe::INT + fa::INT + fv::INT) / 4.0::DOUBLE AS sec_filled,"
    " (hs::INT + he::INT + ha::INT + hv::INT) / 4.0::DOUBLE AS placeholder_rate, (us::INT + ue::INT + ua::INT + uv::INT) / 4.0::DOUBLE AS unknown_rate, dup::DOUBLE AS dup_sections, words::DOUBLE AS word_count, nsteps::DOUBLE AS steps_count FROM metrics",
)
def txt11(spark: SparkSession, d: str) -> DataFrame:
    m = sections.section_metrics(F.col("gen_text"), F.col("parts"))
    return with_sections(spark, d).select("sheet_id", *[c.alias(k) for k, c in m.items()])


_SIG = {k: f"regexp_matches(coalesce(input_text, ''), '(?i){p}')::INT" for k, p in sections.SIGNALS.items()}


@query("txt12_signals", f"WITH {SHEET} SELECT sheet_id, {', '.join(f'{v}::DOUBLE AS {k}' for k, v in _SIG.items())} FROM sheet")
def txt12(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("sheet_id", *[c.alias(k) for k, c in sections.signals(F.col("input_text")).items()])


_ALIGN = f""", sg AS (SELECT *, {_SIG['steps']} AS g1, {_SIG['expected']} AS g2, {_SIG['actual']} AS g3, {_SIG['environment']} AS g4 FROM metrics),
rates AS (SELECT *, g1 + g2 + g3 + g4 AS n,
  g1 * (fs AND NOT hs AND NOT us)::INT + g2 * (fe AND NOT he AND NOT ue)::INT + g3 * (fa AND NOT ha AND NOT ua)::INT + g4 * fv::INT AS w,
  (1 - g1) * (hs OR us)::INT + (1 - g2) * (he OR ue)::INT + (1 - g3) * (ha OR ua)::INT + (1 - g4) * (hv OR uv)::INT AS o FROM sg),
al AS (SELECT *, CASE WHEN n > 0 THEN w / n ELSE 1.0 END::DOUBLE AS sr, CASE WHEN n < 4 THEN o / (4 - n) ELSE 1.0 END::DOUBLE AS nr FROM rates),
align AS (SELECT *, CASE WHEN n = 0 THEN nr WHEN n = 4 THEN sr ELSE 0.7::DOUBLE * sr + 0.3::DOUBLE * nr END AS cond FROM al)"""


@query(
    "txt13_alignment",
    f"WITH {SHEET} {_SECTIONS} {_ALIGN} SELECT sheet_id, n::DOUBLE AS signal_count, (4 - n)::DOUBLE AS nosignal_count, round(sr, 6) AS signal_filled, round(nr, 6) AS nosignal_filled, round(cond, 6) AS cond_filled FROM align",
)
def txt13(spark: SparkSession, d: str) -> DataFrame:
    m = sections.alignment(sections.signals(F.col("input_text")), F.col("parts"))
    return with_sections(spark, d).select("sheet_id", *[F.round(c, 6).alias(k) for k, c in m.items()])


@query("txt25_row_bundle")
def txt25(spark: SparkSession, d: str) -> DataFrame:
    att = sections.with_sections(attributed(spark, d).where("gen_text is not null"), "gen_text", "parts")
    m = sections.section_metrics(F.col("gen_text"), F.col("parts")) | sections.alignment(sections.signals(F.col("input_text")), F.col("parts"))
    return att.select("sheet_id", "input", "retrieval", "unattributed", "tokens", *[F.round(c, 6).alias(k) for k, c in m.items()])


@query(
    "sco01_rouge1",
    f"WITH {REPORTS}, {SHEET}, t AS (SELECT sheet_id, {s_tokens('gt_text')} AS a, {s_tokens('gen_text')} AS b FROM sheet JOIN reports USING (row_id) WHERE gt_text IS NOT NULL AND gen_text IS NOT NULL),"
    " ca AS (SELECT sheet_id, w, count(*) AS c FROM (SELECT sheet_id, unnest(a) AS w FROM t) GROUP BY ALL), cb AS (SELECT sheet_id, w, count(*) AS c FROM (SELECT sheet_id, unnest(b) AS w FROM t) GROUP BY ALL),"
    " h AS (SELECT sheet_id, sum(least(ca.c, cb.c)) AS hit FROM ca JOIN cb USING (sheet_id, w) GROUP BY ALL)"
    " SELECT sheet_id, round(CASE WHEN len(a) > 0 THEN coalesce(hit, 0)::DOUBLE / len(a) ELSE 0 END, 6) AS rouge1_r, round(CASE WHEN coalesce(hit, 0) > 0 THEN 2.0 * (hit::DOUBLE / len(b)) * (hit::DOUBLE / len(a)) / (hit::DOUBLE / len(b) + hit::DOUBLE / len(a)) ELSE 0 END, 6) AS rouge1_f1 FROM t LEFT JOIN h USING (sheet_id)",
)
def sco01(spark: SparkSession, d: str) -> DataFrame:
    rows = sheet(spark, d).join(reports(spark, d).select("row_id", "gt_text"), "row_id").where("gt_text is not null and gen_text is not null")
    rows = rows.select("sheet_id", tx.tokens(F.col("gt_text")).alias("a"), tx.tokens(F.col("gen_text")).alias("b"))
    return scoring.rouge1_rows(rows, "sheet_id", "a", "b").select("sheet_id", *[F.round(k, 6).alias(k) for k in ("rouge1_r", "rouge1_f1")])


_Q = {
    "rm1": f"CASE WHEN {s_words('t')} BETWEEN 50 AND 300 THEN 1 ELSE 0 END",
    "rm3": f"CASE WHEN len(list_filter(list_transform(regexp_split_to_array(trim(t), '[.!?]'), lambda s: {s_strip('s')}), lambda s: contains(s, chr(10)))) = 0 THEN 1 ELSE 0 END",
    "rr1": r"CASE WHEN regexp_matches(t, '(?m)^(?:\d+\)|-|\*)') THEN 1 ELSE 0 END",
    "rr2": r"CASE WHEN regexp_matches(t, '(?m)^[-*]') THEN 1 ELSE 0 END",
    "rr3": "CASE WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in scoring.ENVIRONMENT_WORDS) + " THEN 2 ELSE 0 END",
    "rr4": "CASE WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in scoring.SCREENSHOT_WORDS) + " THEN 1 ELSE 0 END",
    "rr5": "CASE WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in scoring.GUIDELINE_WORDS) + " THEN 1 ELSE 0 END",
    "ra2": "CASE WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in scoring.DIRECT_VERBS) + " THEN 2 ELSE 0 END",
    "ra3": "CASE WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in scoring.SYSTEM_DEFECT_WORDS) + " THEN 2 ELSE 0 END",
}
_Q["rm2"] = (
    "CASE WHEN len(regexp_extract_all(t, '[A-Za-z]+')) > 0 AND 206.835::DOUBLE - 1.015::DOUBLE * len(regexp_extract_all(t, '[A-Za-z]+')) / greatest(1, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: regexp_matches(s, '[A-Za-z]'))))"
    " - 84.6::DOUBLE * list_sum(list_transform(regexp_extract_all(t, '[A-Za-z]+'), lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+'))))) / len(regexp_extract_all(t, '[A-Za-z]+')) BETWEEN 30 AND 100 THEN 1 ELSE 0 END"
)
_Q["rm4"] = f"CASE WHEN len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: trim(s) <> '')) > 0 AND {s_words('t')}::DOUBLE / len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: trim(s) <> '')) BETWEEN 5 AND 40 THEN 1 ELSE 0 END"


@query(
    "sco04_quality",
    f"WITH {SHEET}, q AS (SELECT sheet_id, left(gen_text, 10000) AS t FROM sheet WHERE gen_text IS NOT NULL), i AS (SELECT sheet_id, {', '.join(f'{v} AS {k}' for k, v in _Q.items())} FROM q)"
    f" SELECT *, ({' + '.join(_Q)}) / 16.0::DOUBLE AS quality FROM i",
)
def sco04(spark: SparkSession, d: str) -> DataFrame:
    q = scoring.quality_indicators(F.col("t"))
    rows = sheet(spark, d).where("gen_text is not null").select("sheet_id", F.substring("gen_text", 1, 10000).alias("t"))
    rows = rows.select("sheet_id", *[c.alias(k) for k, c in q.items()])
    return rows.withColumn("quality", sum((F.col(k) for k in list(q)[1:]), F.col(list(q)[0])) / scoring.QUALITY_DIVISOR)


def _s_pref(profile: str, positive: str, common: str) -> str:
    entity = {
        "structure": "least(0.25::DOUBLE, 0.03::DOUBLE * u)", "hard": "least(0.6::DOUBLE, 0.06::DOUBLE * u) + least(0.25::DOUBLE, 0.02::DOUBLE * (iu - u))",
    }.get(profile, "least(0.45::DOUBLE, 0.045::DOUBLE * u)")
    return f"greatest(0.0, least(1.0, {positive} - ({common}) - 0.10::DOUBLE * least(0.2::DOUBLE, 0.03::DOUBLE * dup) - 0.05::DOUBLE * lp - ({entity})))"


_PREF_SQL = (
    ATT + _SECTIONS.replace("\n, ln", ", ln", 1) + _ALIGN + ", m AS (SELECT a.sheet_id, cond, sr, nr, dup, (ps::INT + pe::INT + pa::INT + pv::INT) / 4.0::DOUBLE AS pres, (fs::INT + fe::INT + fa::INT + fv::INT) / 4.0::DOUBLE AS filled,"
    " (hs::INT + he::INT + ha::INT + hv::INT) / 4.0::DOUBLE AS ph, (us::INT + ue::INT + a.ua::INT + uv::INT) / 4.0::DOUBLE AS un, greatest(1.0, tokens)::DOUBLE AS t,"
    " 1000.0::DOUBLE * n_unattributed / greatest(1, tokens) AS u, 1000.0::DOUBLE * (n_retrieval + n_unattributed) / greatest(1, tokens) AS iu FROM align a JOIN att USING (sheet_id)),"
    " l AS (SELECT *, CASE WHEN t < 200 THEN (200 - t) / 2000 WHEN t > 1200 THEN (t - 1200) / 4000 ELSE 0.0 END AS lp FROM m) SELECT sheet_id, "
    + ", ".join(
        f"round({_s_pref(p, f'{c}::DOUBLE * cond + 0.10::DOUBLE * pres + 0.10::DOUBLE * sr + 0.05::DOUBLE * nr', '0.08::DOUBLE * ph + 0.06::DOUBLE * un')}, 6) AS v2_{p}"
        for p, c in (("structure", 0.65), ("hard", 0.45), ("balanced", 0.55))
    )
    + ", "
    + ", ".join(
        f"round({_s_pref(p, f'{c}::DOUBLE * filled + {e}::DOUBLE * pres', '0.10::DOUBLE * ph + 0.08::DOUBLE * un')}, 6) AS v1_{p}"
        for p, c, e in (("structure", 0.55, 0.25), ("hard", 0.35, 0.15), ("balanced", 0.45, 0.20))
    )
    + " FROM l"
)


@query("sco16_preference_score", _PREF_SQL)
def sco16(spark: SparkSession, d: str) -> DataFrame:
    rows = sections.with_sections(attributed(spark, d).where("gen_text is not null"), "gen_text", "parts")
    s = sections.section_metrics(F.col("gen_text"), F.col("parts"))
    a = sections.alignment(sections.signals(F.col("input_text")), F.col("parts"))
    t = F.greatest(F.lit(1.0), F.col("tokens").cast("double"))
    named = {
        "cond": a["cond_filled"], "sig": a["signal_filled"], "nosig": a["nosignal_filled"], "pres": s["sec_presence"], "filled": s["sec_filled"],
        "placeholder": s["placeholder_rate"], "unknown": s["unknown_rate"], "dup": s["dup_sections"],
        "ua": 1000.0 * F.col("unattributed") / t, "iu": 1000.0 * (F.col("retrieval") + F.col("unattributed")) / t,
    }
    rows = rows.select("sheet_id", "tokens", *[c.alias(k) for k, c in named.items()])
    m = {k: F.col(k) for k in [*named, "tokens"]}
    return rows.select(
        "sheet_id", *[F.round(scoring.preference_score(p, v, m), 6).alias(f"{v}_{p}") for v in ("v2", "v1") for p in ("structure", "hard", "balanced")]
    )


@query(
    "agg15_best_worst",
    f"WITH {CANDIDATES} SELECT row_id, count(*) AS candidates, arg_max(candidate_index, (score, -candidate_index)) AS best, arg_min(candidate_index, (score, -candidate_index)) AS worst, max(score) AS best_score, min(score) AS worst_score FROM cand WHERE score IS NOT NULL GROUP BY row_id",
)
def agg15(spark: SparkSession, d: str) -> DataFrame:
    key = F.struct("score", -F.col("candidate_index"))
    return candidates(spark, d).where("score is not null").groupBy("row_id").agg(
        F.count("*").alias("candidates"), F.max_by("candidate_index", key).alias("best"), F.min_by("candidate_index", key).alias("worst"),
        F.max("score").alias("best_score"), F.min("score").alias("worst_score"),
    )
