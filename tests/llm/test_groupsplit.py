from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reportloom.llm import groupsplit
from reportloom.session import Scratch

SCHEMA = "row_id long, text string, group_id string, author string, split string, loaded_at timestamp, key string"


def frames(spark, rows):
    splits = spark.createDataFrame([(*r, "train", None, "k") for r in rows], SCHEMA)
    rules = spark.createDataFrame(
        [(42, "group_id", 0.8, 0.1, 0.1), (42, "author", 0.8, 0.1, 0.1)],
        "seed int, group_col string, train_share double, val_share double, test_share double",
    )
    trackers = spark.createDataFrame([("KELP", "Kelp tracker"), ("VEXT", "Vext tracker")], "prefix string, tracker_name string")
    nothing = spark.createDataFrame([("author", "nobody"), ("author", "deleted user")], "field_name string, placeholder string")
    return splits, rules, trackers, nothing


def linked(spark, rows):
    return {(r.row_id, r.cluster_id) for r in groupsplit.clusters(*frames(spark, rows), Scratch(spark, "t")).collect()}


@pytest.mark.parametrize(
    "text",
    ["See KELP-10101", "kelp_10101.", "Kelp #10101", "KELP10101", "[KELP-10101]", "KELP issue 10101", "Kelp‑10101",
     "https://kelp.tracker.example/issues/10101", "KELP 10101 has", "KELP#10101"],
)
def test_issue_forms(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(groupsplit.issue_keys(F.col("t"), F.lit("KELP|VEXT")).alias("k"))
    assert df.first().k == ["kelp-10101"]


@pytest.mark.parametrize("text", ["KELP 2.1 is affected", "KELP-1010", "xkelp-10101", "KELP-10101a", "", "ticket 8758276"])
def test_no_issue(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(groupsplit.issue_keys(F.col("t"), F.lit("KELP|VEXT")).alias("k"))
    assert df.first().k == []


def test_links(spark):
    rows = [
        (1, None, "AB c", None), (2, "x", "abc ", "nobody"), (3, "KELP-10101", None, "@Ann_1"), (4, "kelp 10101", "", " ann_1@bugs.example "),
        (5, None, None, "Nobody "), (6, None, None, "Deleted User"), (7, None, " ", "deleted user"), (8, "KELP-10101", "zz", None),
        (8, "KELP-10101", "zz", None), (None, "KELP-10101", "zz", None),
    ]
    assert linked(spark, rows) == {(1, 1), (2, 1), (3, 3), (4, 3), (8, 3)}


def test_empty_and_unlinked(spark):
    assert linked(spark, []) == set()
    assert linked(spark, [(1, "a", "g", None), (2, "b", "h", None)]) == set()


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {(r.row_id, r.cluster_id) for r in groupsplit.components(df, Scratch(spark, "t")).collect()}
    assert got == {(x, find(x)) for x in parent}


def test_no_cluster_is_cut(spark):
    rows = [(i, None, f"g{i // 3}", f"a{i % 40}" if i < 80 else None) for i in range(600)]
    splits, rules, trackers, nothing = frames(spark, rows)
    out = groupsplit.assign(splits, groupsplit.clusters(splits, rules, trackers, nothing, Scratch(spark, "t")), rules)
    got = out.collect()
    assert len(got) == 600
    assert out.groupBy("cluster_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split for r in got} == {"train", "val", "test"}
