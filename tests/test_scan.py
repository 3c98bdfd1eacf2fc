from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from reportloom.operators import annotation, mining, retrieval, sampling, scan, stats
from reportloom.sources import readers, writers

RNG = random.Random(5)
WORDS = ["Red", "fox", "ran", "far", "fast", "out", "Über", "x_1"]


def docs_of(spark, n=60):
    rows = [(i, " ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(0, 14))), RNG.choice(["a", "b", None]), "clash") for i in range(n)]
    rows += [(n, None, "a", "c"), (n + 1, "", None, "c"), (n + 2, "Red, fox! " * 4000, "b", "c")] + [(n + 3 + i, "fox ran", "a", "c") for i in range(9)]
    return spark.createDataFrame(rows, "id long, text string, g string, q string")


def rows_of(df):
    return sorted((r.q, r.doc, r["rank"], round(r.score, 6)) for r in df.collect())


def test_scans_equal_joins(spark, monkeypatch):
    docs = docs_of(spark)
    asked = docs.where("id % 7 = 0 or id > 60")
    bm = rows_of(scan.bm25_topk(asked, docs, "id", "id", "text", 3))
    own = rows_of(scan.bm25_topk(asked, docs, "id", "id", "text", 3, "g", "g"))
    tf = rows_of(scan.tfidf_topk(asked, docs, "id", "id", "text", 3, 40))
    assert bm == rows_of(retrieval.top_k(retrieval.bm25(asked, docs, "id", "id", "text"), "q", "doc", 3)) and len(bm) > 20
    monkeypatch.setattr(scan, "SCAN_QUERIES", 0)  # too many queries: the joins take over
    assert rows_of(scan.bm25_topk(asked, docs, "id", "id", "text", 3, "g", "g")) == own and own != bm
    assert rows_of(scan.tfidf_topk(asked, docs, "id", "id", "text", 3, 40)) == tf and tf
    terms = {(r.term, r.df, round(r.idf, 9)) for r in scan.tfidf_terms(docs, "id", "text", 40).collect()}
    assert terms == {(r.term, r.df, round(r.idf, 9)) for r in retrieval.tfidf_terms(docs, "id", "text", 40).collect()} and len(terms) == 40


def test_scans_of_nothing(spark):
    docs = docs_of(spark)
    for f in (scan.bm25_topk, scan.tfidf_topk):
        assert f(docs.limit(0), docs, "id", "id", "text", 3).count() == 0 and f(docs.limit(3), docs.limit(0), "id", "id", "text", 3).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        scan.topk("other", docs, docs, "id", "id", "text", 3)


def test_dense(spark):
    rows = [(i, [RNG.random() for _ in range(3)]) for i in range(40)] + [(40, None), (41, [1.0, 1.0, 1.0]), (42, [1.0, 1.0, 1.0]), (43, [1.0])]
    base = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in scan.dense_topk(base.where("id % 7 = 0 or id = 42"), base, "id", "id", "v", 3, block=4).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    vec = {i: v for i, v in rows if v and len(v) == 3}
    for q in [i for i in vec if i % 7 == 0 or i == 42]:
        want = sorted((i for i in vec if i != q), key=lambda i: (-round(sum(a * b for a, b in zip(vec[q], vec[i])), 6), i))[:3]
        assert [i for _, i in sorted(got[q])] == want


def test_attribution_check(spark):
    cases = [("IAHE", 1, 1, 1, "Y:correct_input_attr"), ("retrieval", 0, 1, 1, "Y:correct_retrieval_attr"), ("RAHE", 1, 1, 1, "N:mismatch_expected_IAHE"), ("UAHE", 0, 0, 1, "Y:correct_unattributed"),
             ("input", 0, 1, 1, "N:mismatch_expected_RAHE"), (None, 0, 0, 1, "N:mismatch_expected_UAHE"), ("UAHE", None, None, 1, "Y:correct_unattributed"), ("IAHE", 1, 0, 0, "NA:not_in_gen"), ("IAHE", 1, 0, None, "NA:not_in_gen")]
    df = spark.createDataFrame([c[:4] for c in cases], "g string, i int, r int, o int")
    assert [x.l for x in df.select(annotation.attribution_check(F.col("g"), F.col("i"), F.col("r"), F.col("o")).alias("l")).collect()] == [c[4] for c in cases]


def test_mining_of_missing_values(spark):
    schema = "row_id long, candidate_index int, candidate_rank int, score double, ua double, cond double, candidate_text string"
    rows = [(1, 0, 1, 0.9, None, 0.8, " a "), (1, 1, 2, 0.5, None, 0.8, "a"), (1, 2, 3, None, None, 0.1, "b"), (1, 3, 9, 0.1, 2.0, 0.1, "b "), (1, 4, None, 0.2, 0.0, None, "c"), (1, 5, 4, 0.0, 0.0, 0.0, None),
            (2, 0, 1, 0.9, 0.0, None, "a"), (2, 1, 2, 0.1, 0.0, 0.9, "b"), (None, 0, 1, 0.9, 0.0, 0.9, "a")]
    df = spark.createDataFrame(rows, schema)
    picked = lambda p: [(r.row_id, r.reason, r.rejected_index) for r in mining.mine(df, p).orderBy("row_id", "pair_no").collect()]
    assert picked(mining.Policy(pairs=3)) == [(1, "ok", 4), (1, "ok", 3), (2, "min_cond", None)]
    assert picked(mining.Policy(min_cond=0.0, min_sec=0.1)) == [(1, "min_sec", None), (2, "min_sec", None)]
    assert picked(mining.Policy(min_cond=0.0, uahe_order=True))[-1] == (2, "ok", 1)


def test_holm_and_bh_of_published_values(spark):
    tests = [(1, 0.001), (2, 0.04), (3, 0.03), (4, 0.2), (5, 0.04)]
    got = {r.id: (round(r.holm_q, 6), round(r.bh_q, 6)) for r in stats.with_corrections(spark.createDataFrame(tests, "id int, p double"), "p", "id").collect()}
    assert got == {1: (0.005, 0.005), 3: (0.12, 0.05), 2: (0.12, 0.05), 5: (0.12, 0.05), 4: (0.2, 0.2)}


def test_numbered_and_prompt_split(spark):
    rows = [(i, f"g{RNG.randrange(5)}", None if i % 9 == 0 else f"p{i % 20}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, p string")
    got = [r.id for r in stats.numbered(df, "g", "n", "id").orderBy("n").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    split = {(r.p, r.is_eval) for r in sampling.prompt_split(df, "p", 0.25, 1).collect()}
    assert len(split) == len({p for p, _ in split}) == 21 and sum(e for _, e in split) == 5


def test_bootstrap_tau(spark):
    rows = [(i, "g", i % 3, float(i % 3) + RNG.random() * 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, x int, y double")
    tau = stats.tau_b(df, "x", "y", "g").first()
    ci = stats.bootstrap_tau(df, "id", "x", "y", 60, 3, "g").first()
    assert ci.ci_lo < tau.tau_b < ci.ci_hi < tau.tau_b + 0.15 and tau.p < 1e-6 and tau.z > 5


def test_locks_runs_and_indexes(spark, tmp_path):
    path = f"{tmp_path}/t"
    with writers.exclusive(spark, path), pytest.raises(FileExistsError), writers.exclusive(spark, path):
        pass
    with writers.exclusive(spark, path):
        time.sleep(0.01)
        with writers.exclusive(spark, path, stale_hours=0.0):
            pass
    a = writers.run_dir(spark, str(tmp_path), "one")
    assert writers.run_dir(spark, str(tmp_path)) == writers.run_dir(spark, str(tmp_path), "last") == a
    made = []
    for _ in range(2):
        index = writers.index_once(spark, f"{tmp_path}/i", {"k": 1}, lambda: made.append(1) or {"t": spark.range(3)})
    assert made == [1] and index["t"].count() == 3
    for k in (1, 2):
        writers.with_metadata(spark.range(k), f"{tmp_path}/art{k}", {"k": k})
    assert readers.newest_with(spark, f"{tmp_path}/art*", {"k": 1}).endswith("art1") and readers.newest_with(spark, f"{tmp_path}/art*", {"k": 3}) is None
    assert len(readers.expanded(spark, [f"{tmp_path}/art*", f"{tmp_path}/art1"])) == 2
    with pytest.raises(FileNotFoundError):
        readers.expanded(spark, [f"{tmp_path}/none*"])
    assert readers.split_table(spark, {"train": f"{tmp_path}/no.csv"}, "row_id int") is None
    writers.clear(spark, f"{tmp_path}/art1")
    assert not readers.exists(spark, f"{tmp_path}/art1")
    twice = spark.createDataFrame([(1,), (1,), (2,), (2,)], "a int")
    assert writers.content_mark(twice).first() != writers.content_mark(twice.withColumn("a", F.col("a") + 5)).first()
