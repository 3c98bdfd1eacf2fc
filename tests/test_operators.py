from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from reportloom.operators import mining, retrieval, sampling, stats
from reportloom.sources import readers, writers


def test_holm_and_bh(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, None)], "id int, p double")
    small = {r.id: (round(r.holm_q, 9), round(r.bh_q, 9)) for r in stats.with_corrections(df.where("id < 4"), "p", "id").collect()}
    assert small == {1: (0.03, 0.03), 2: (0.04, 0.03), 3: (0.04, 0.03)}
    assert {r.id: r.holm_q for r in stats.with_corrections(df, "p", "id").collect()}[4] == 1.0


def test_tau_against_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), round(rng.random(), 1)) for _ in range(80)]
    s = sum(((a[0] > b[0]) - (a[0] < b[0])) * ((a[1] > b[1]) - (a[1] < b[1])) for a, b in combinations(rows, 2))
    n0 = len(rows) * (len(rows) - 1) / 2
    tie = lambda k: sum(a[k] == b[k] for a, b in combinations(rows, 2))
    got = stats.tau_b(spark.createDataFrame([("g", *r) for r in rows], "g string, x int, y double"), "x", "y", "g").first()
    assert got.tau_b == pytest.approx(s / ((n0 - tie(0)) * (n0 - tie(1))) ** 0.5) and got.n == 80
    flat = spark.createDataFrame([("g", 1, 0.5), ("g", 2, 0.5)], "g string, x int, y double")
    assert stats.tau_b(flat, "x", "y", "g").first().tau_b == 0.0


def test_signed_ranks(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, -1.0, 3.0, 0.0, 4.0, -2.0)] + [("z", 0.0)], "g string, delta double")
    got = {r.g: r for r in stats.signed_ranks(df, "g").collect()}
    assert got["a"].w_plus == 1.5 + 3.5 + 5 + 6 and got["a"].n_nonzero == 6 and got["a"].n_total == 7
    assert got["a"].rank_biserial == pytest.approx((16 - 5) / 21)
    assert (got["z"].rank_biserial, got["z"].p, got["z"].z) == (0.0, 1.0, None)


def test_kappa_and_majority(spark):
    rows = [("x", "x")] * 4 + [("x", "y")] + [("y", "y")] * 3 + [("y", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = stats.kappa(df, "a", "b").first()
    po, pe = 7 / 8, (5 / 8) * (4 / 8) + (3 / 8) * (4 / 8)
    assert got.n == 8 and got.kappa == pytest.approx((po - pe) / (1 - pe))
    votes = spark.createDataFrame([(["a", "b", "a"],), (["a", "b", None],), ([None, None, None],)], "v array<string>")
    assert [r.m for r in votes.select(stats.majority(F.col("v")).alias("m")).collect()] == ["a", "no_consensus", "no_consensus"]


CANDIDATES = "row_id long, candidate_index int, candidate_rank int, score double, ua double, cond double, candidate_text string"


def test_selection_rules_differ(spark):
    rows = [(1, 0, 1, 0.9, 1.0, 0.8, "a"), (1, 1, 2, 0.5, 0.5, 0.8, "b"), (1, 2, 3, 0.4, 2.0, 0.8, "b"), (1, 3, 4, 0.3, 2.0, 0.8, ""), (2, 0, 1, 0.9, 0.0, 0.1, "a"), (3, 0, 1, None, 0.0, 0.9, "a")]
    df = spark.createDataFrame(rows, CANDIDATES)
    picked = lambda p, rule: [(r.row_id, r.reason, r.rejected_index) for r in mining.mine(df, p, rule).orderBy("row_id", "pair_no").collect()]
    # the prompt with a null score counts as scored zero and has nothing to reject
    assert picked(mining.Policy(), "mine") == [(1, "ok", 3), (1, "ok", 2), (2, "min_cond", None), (3, "no_reject", None)]
    assert picked(mining.Policy(), "remine") == [(1, "ok", 2), (2, "min_cond", None), (3, "no_reject", None)]
    assert picked(mining.Policy(), "sweep") == [(1, "ok", 3), (2, "min_cond", None), (3, "no_valid_reject", None)]
    assert picked(mining.Policy(uahe_cap=0.0), "mine")[0][1] == "ok" and picked(mining.Policy(uahe_cap=0.0), "remine")[0][1] == "uahe_cap"
    assert picked(mining.Policy(margin=0.95), "sweep")[0][1] == "no_valid_reject" and mining.mine(df.limit(0), mining.Policy()).count() == 0


def test_sweep_falls_with_margin(spark):
    rng = random.Random(1)
    rows = [(i // 5, i % 5, i % 5, rng.random(), rng.random() * 3, rng.random(), rng.choice("abcd")) for i in range(200)]
    got = mining.sweep(spark.createDataFrame(rows, CANDIDATES), spark).collect()
    assert len(got) == 900 and all(r.reject_below_quality_floor + r.reject_uahe_cap + r.reject_min_cond + r.reject_no_valid_reject + r.prompts_kept == r.prompts_total for r in got)
    by = {(r.margin, r.quality_floor, r.uahe_cap, r.min_cond): r.pairs for r in got}
    assert all(by[0.01, *k[1:]] >= v for k, v in by.items())


def test_topk_ties_and_exclusion(spark):
    scores = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 1, 0.9), (1, 4, 0.4)], "q long, doc long, score double")
    groups = spark.createDataFrame([(1, "g"), (2, "h"), (3, "g"), (4, None)], "id long, group_id string")
    assert [(r.doc, r["rank"]) for r in retrieval.top_k(scores, "q", "doc", 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert {r.doc for r in retrieval.without_own(scores, groups).collect()} == {2, 4}


def test_group_split(spark):
    rows = spark.createDataFrame([(i, f"g{i % 50}") for i in range(500)] + [(999, None)], "id long, g string")
    got = sampling.group_split(rows, "g", 42)
    sizes = {r.split_new: r.n for r in got.groupBy("split_new").agg(F.count_distinct("g").alias("n")).collect()}
    assert sizes == {"train": 40, "val": 5, "test": 5} and sampling.leaks(got, "g", "split_new").count() == 0


def test_random_k(spark):
    docs = spark.createDataFrame([(i, f"g{i % 7}") for i in range(200)], "id long, group_id string")
    rows = retrieval.random_k(docs, docs, 3, 42, tries=8).collect()
    assert all(r.q % 7 != r.doc % 7 for r in rows) and len({(r.q, r.doc) for r in rows}) == len(rows) and len(rows) > 500


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", [1, 2]), (2, None, None)], "row_id long, t string, k array<int>")
    writers.json_lines(df, f"{tmp_path}/j")
    assert readers.json_lines(spark, f"{tmp_path}/j", df.schema).count() == 2
    writers.csv(writers.flat(df, ["t"]), f"{tmp_path}/c")
    back = readers.csv(spark, f"{tmp_path}/c")
    assert back.columns == ["t", "k", "row_id"] and {r.t for r in back.collect()} == {"a\nb", None}
    writers.with_metadata(df, f"{tmp_path}/m", {"seed": 1})
    assert writers.verified(spark, f"{tmp_path}/m").first().same
    assert readers.with_synonyms(spark.createDataFrame([(1,)], " Label int"), {"extraction": ("label",)}).columns == ["extraction"]
    with pytest.raises(KeyError):
        readers.report_columns(df, "t", "nope")
    spots = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "k string, p int")
    assert [r.k for r in readers.non_contiguous(spots, "k", "p").collect()] == ["a"]
