from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

from reportloom.llm import topn

SCHEMA = "row_id long, candidate_index int, prefscore double, scored_at timestamp, rank int, score string"


def t(n: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def run(spark, rows, n=3):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)
    return {(r.row_id, r.candidate_index, r["rank"]) for r in topn.top_n(topn.latest_scored(df), n).collect()}


def test_latest_entry_counts_even_without_score(spark):
    rows = [(1, 0, 0.9, t(1)), (1, 0, None, t(2)), (1, 1, 0.5, t(1)), (1, 2, float("nan"), t(1))]
    assert run(spark, rows) == {(1, 1, 1)}


def test_ties_nulls_and_repeats(spark):
    rows = [(1, 2, 0.5, t(1)), (1, 1, 0.5, t(1)), (1, 1, 0.5, t(1)), (None, 1, 0.9, t(1)), (1, None, 0.5, t(1)), (2, 7, 0.1, None)]
    assert run(spark, rows) == {(1, 1, 1), (1, 2, 2), (1, None, 3), (2, 7, 1)}


def test_empty(spark):
    assert run(spark, []) == set()


def test_hot_group_against_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (1 if rng.random() < 0.4 else rng.randrange(50), rng.randrange(200), rng.choice([None, math.nan, round(rng.random(), 1)]), t(i))
        for i in range(4000)
    ]
    last = {}
    for r, c, s, at in rows:
        if (r, c) not in last or last[r, c][1] < at:
            last[r, c] = (s, at)
    groups = defaultdict(list)
    for (r, c), (s, _) in last.items():
        if s is not None and not math.isnan(s):
            groups[r].append((-s, c))
    want = {(r, c, i + 1) for r, g in groups.items() for i, (_, c) in enumerate(sorted(g)[:3])}
    assert run(spark, rows) == want
