"""SQL of those training-data queries that SQL expresses on whole tables."""

from __future__ import annotations

_P3 = """
WITH entries AS (
  SELECT row_id, candidate_index, scored_at,
         CASE WHEN isnan(prefscore) THEN NULL ELSE prefscore END AS score
  FROM candidates WHERE row_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY row_id, candidate_index
           ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) AS age FROM entries
), ranked AS (
  SELECT row_id, candidate_index, score, row_number() OVER (PARTITION BY row_id
           ORDER BY score DESC, candidate_index ASC NULLS LAST) AS rank
  FROM numbered WHERE age = 1 AND score IS NOT NULL
)
"""

_ISSUE = r"(?i)(?:^|[^\p{L}\p{N}])(PREFIXES)(?:[\s\p{Z}]+(?:issue|ticket|bug)|\.[\w.\-]+(?::\d+)?(?:/[\w\-]+)*/)?[\s\p{Z}\-_#:\[\]\x{2010}-\x{2015}\x{2212}]*(\d{5,})"
_P2 = f"""
WITH RECURSIVE pat AS (
  SELECT replace('{_ISSUE}', 'PREFIXES', (SELECT string_agg(upper(prefix), '|' ORDER BY prefix) FROM trackers)) AS p
), hits AS (
  SELECT row_id, unnest(regexp_extract_all(text, p, 1)) AS a, unnest(regexp_extract_all(text, p, 2)) AS b FROM splits, pat WHERE text IS NOT NULL AND row_id IS NOT NULL
), keys AS (
  SELECT row_id, 'issue:' || lower(a) || '-' || b AS key FROM hits
  UNION SELECT row_id, 'group_id:' || regexp_replace(lower(group_id), '[\\s\\p{{Z}}]+', '', 'g') FROM splits
    WHERE 'group_id' IN (SELECT group_col FROM split_seed42) AND row_id IS NOT NULL AND trim(group_id) <> ''
  UNION SELECT row_id, 'author:' || regexp_replace(regexp_replace(regexp_replace(lower(author), '[\\s\\p{{Z}}]+', '', 'g'), '^[@~]+', ''), '@[^@]*$', '') FROM splits
    WHERE 'author' IN (SELECT group_col FROM split_seed42) AND row_id IS NOT NULL AND trim(author) <> ''
      AND regexp_replace(lower(author), '[\\s\\p{{Z}}]+', '', 'g') NOT IN (SELECT replace(lower(placeholder), ' ', '') FROM placeholders WHERE field_name = 'author')
), low AS (
  SELECT row_id AS u, min(row_id) OVER (PARTITION BY key) AS v FROM keys
), sym AS (
  SELECT u, v FROM low WHERE u <> v UNION SELECT v, u FROM low WHERE u <> v
), reach AS (
  SELECT u AS s, u AS t FROM sym UNION SELECT r.s, e.v FROM reach r JOIN sym e ON r.t = e.u
), linked AS (SELECT s AS row_id, min(t) AS cluster_id FROM reach GROUP BY s)
"""
_P2_SPLITS = _P2 + """, share AS (SELECT max(seed) AS seed, max(train_share) AS a, max(val_share) AS b, max(test_share) AS c FROM split_seed42),
whole AS (SELECT r.row_id, coalesce(cluster_id, r.row_id) AS cluster_id FROM (SELECT DISTINCT row_id FROM splits WHERE row_id IS NOT NULL) r LEFT JOIN linked USING (row_id)),
drawn AS (SELECT row_id, cluster_id, a, b, ('0x' || substr(md5(seed::VARCHAR || '|' || cluster_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (a + b + c) AS d FROM whole, share),
placed AS (SELECT row_id, cluster_id, CASE WHEN d < a THEN 'train' WHEN d < a + b THEN 'val' ELSE 'test' END AS split FROM drawn)
"""

_P5 = """
WITH entries AS (
  SELECT entity_id, 'A' AS annotator, labelled_at AS stamp, annota_extraction AS ext, annota_attribution AS att FROM entity_level_annota
  UNION ALL SELECT entity_id, 'B', labelled_at, annotb_extraction, annotb_attribution FROM entity_level_annota
  UNION ALL SELECT entity_id, 'gpt', labelled_at, extraction, attribution FROM result_gpt_merged
  UNION ALL SELECT entity_id, 'gemini', labelled_at, extraction, attribution FROM result_gemini_merged
), marks AS (
  SELECT entity_id, annotator, stamp, 'extraction' AS label_kind,
         regexp_extract(replace(lower(ext), '_', ' '), '\\bt\\.? ?p\\b|true[ -]*pos|\\bf\\.? ?p\\b|false[ -]*pos') AS mark FROM entries
  UNION ALL
  SELECT entity_id, annotator, stamp, 'attribution',
         regexp_extract(replace(lower(att), '_', ' '), 'un-?attribut|not[ -]+attribut|neither|retriev|\\binput') FROM entries
), labels AS (
  SELECT *, CASE WHEN label_kind = 'extraction' THEN CASE WHEN mark LIKE 't%' THEN 'TP' ELSE 'FP' END
            ELSE CASE WHEN mark LIKE 'ret%' THEN 'retrieval' WHEN mark = 'input' THEN 'input' ELSE 'unattributed' END END AS label
  FROM marks WHERE mark IS NOT NULL AND mark <> '' AND entity_id IS NOT NULL
), votes AS (
  SELECT entity_id, label_kind, annotator, label FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, label_kind, annotator ORDER BY stamp DESC NULLS LAST, label DESC) AS age FROM labels)
  WHERE age = 1
), counted AS (
  SELECT entity_id, label_kind, label, count(*) AS c FROM votes GROUP BY ALL
)
"""

ORACLE_SQL: dict[str, str] = {
    "p3_found": _P3 + "SELECT row_id, candidate_index FROM ranked WHERE rank <= 3",
    "p3_topn": _P3 + "SELECT row_id, candidate_index, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 3",
    "p2_found": _P2 + "SELECT row_id, cluster_id FROM linked",
    "p2_splits": _P2_SPLITS + "SELECT * FROM placed",
    "p2_shares": _P2_SPLITS + "SELECT split, count(*) AS records, count(DISTINCT cluster_id) AS clusters FROM placed GROUP BY split",
    "p5_found": _P5 + """
SELECT entity_id, label_kind, label AS consensus_label FROM counted a
WHERE c >= 2 AND NOT EXISTS (SELECT 1 FROM counted b WHERE b.entity_id = a.entity_id AND b.label_kind = a.label_kind
                             AND b.label <> a.label AND b.c >= a.c)""",
    "p5_agreement": _P5 + """
, sized AS (SELECT *, sum(c) OVER (PARTITION BY entity_id, label_kind) AS m FROM counted),
by_label AS (
  SELECT label_kind, label, sum(c)::DOUBLE AS n, sum(c * (c - 1)::DOUBLE / (m - 1)) AS same, sum(c::DOUBLE / m) AS items
  FROM sized WHERE m >= 2 GROUP BY ALL
), total AS (SELECT label_kind, sum(n) AS n, sum(same) AS same, sum(n * (n - 1)) AS chance, sum(items) AS items FROM by_label GROUP BY ALL)
SELECT label_kind, round(items)::BIGINT AS items, round(same / n, 6) AS observed,
       round(1 - (1 - same / n) / (1 - chance / (n * (n - 1))), 6) AS alpha FROM total""",
}
