from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reportloom.llm import consensus
from reportloom.session import Scratch

SCHEMA = "entity_id long, annotator string, at timestamp, extraction string, attribution string, label string, votes int"


def t(d: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


@pytest.mark.parametrize(
    ("kind", "raw", "want"),
    [("extraction", x, "TP") for x in ("TP", " tp. ", "True Positive", "TP:not_fp", "true positive (not a FP)", "TP - looks right")]
    + [("extraction", x, "FP") for x in ("FP ", "F.P.", "false-positive, no TP", "FP:not_tp", "FP - number only", "False positive")]
    + [("extraction", x, None) for x in ("", " ", "?", "NA", "n/a", "unsure", None)]
    + [("attribution", x, "input") for x in ("Input", "from input", "input; not retrieval", "INPUT (report text)")]
    + [("attribution", x, "retrieval") for x in ("RETRIEVAL ", "retrieved example", "retrieval, absent from input")]
    + [("attribution", x, "unattributed") for x in ("UNATTRIBUTED", "not attributed", "unattributed (neither input nor retrieval)")]
    + [("attribution", x, None) for x in ("", "unsure", "?", None)],
)
def test_labels(spark, kind, raw, want):
    df = spark.createDataFrame([(raw,)], "x string").select(consensus.label_of(kind, F.col("x")).alias("l"))
    assert df.first().l == want


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    fitted = consensus.fit(consensus.votes(df), Scratch(spark, "t"))
    return fitted, {(r.entity_id, r.label_kind): r for r in consensus.consensus(fitted).collect()}


def test_vote_rules(spark):
    rows = [
        (1, "a", t(1), "TP", None), (1, "b", t(1), "tp", "input"), (1, "c", t(1), "FP", "from input"),
        (2, "a", t(1), "TP", None), (2, "b", t(1), "FP", None),
        (3, "a", t(1), "FP", None), (3, "a", t(2), "TP", None), (3, "a", t(3), "unsure", None), (3, "a", t(2), "TP", None), (3, "b", t(0), "TP", None),
        (4, "a", t(1), "TP", None), (None, "a", t(1), "TP", None), (5, None, t(1), "TP", None), (6, "a", None, "?", ""),
        (7, "a", None, "FP", None), (7, "a", t(1), "TP", None), (7, "b", t(1), "TP", None), (7, "c", t(1), "FP", None), (7, "d", t(1), "FP", None),
    ]
    _, got = run(spark, rows)
    assert {k: (r.votes, r.consensus_label) for k, r in got.items()} == {
        (1, "extraction"): (3, "TP"), (1, "attribution"): (2, "input"), (2, "extraction"): (2, None), (3, "extraction"): (2, "TP"),
        (4, "extraction"): (1, None), (7, "extraction"): (4, None),
    }
    assert got[1, "extraction"].agreement == pytest.approx(1 / 3) and got[4, "extraction"].agreement is None


def test_empty(spark):
    fitted, got = run(spark, [])
    assert got == {} and consensus.annotators(fitted).count() == 0
    assert consensus.agreement(consensus.votes(spark.createDataFrame([], SCHEMA))).count() == 0


def test_reliability_on_simulated_annotators(spark):
    rng = random.Random(4)
    accuracy = {"a": 0.95, "b": 0.9, "c": 0.85, "d": 0.55, "few": 0.9}
    truth = {i: rng.choice(["TP", "TP", "FP"]) for i in range(600)}
    rows = []
    for i, true in truth.items():
        for who, p in accuracy.items():
            if who == "few" and i >= 6:
                continue
            said = true if rng.random() < p else ("FP" if true == "TP" else "TP")
            rows.append((i, who, t(1), said, None))
    fitted, got = run(spark, rows)
    rate = {r.annotator: r.reliability for r in consensus.annotators(fitted).collect()}
    assert rate["a"] > rate["c"] > rate["d"] + 0.1 and abs(rate["a"] - 0.95) < 0.05 and 0.6 < rate["few"] < 1
    right = sum(got[i, "extraction"].model_label == true for i, true in truth.items())
    votes = defaultdict(Counter)
    for i, _, _, said, _ in rows:
        votes[i][said] += 1
    by_votes = sum(votes[i].most_common(1)[0][0] == true for i, true in truth.items())
    assert right >= by_votes and right >= 0.95 * len(truth)


def test_alpha_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, w, t(1), rng.choice(["TP", "TP", "FP"]), None) for i in range(40) for w in "abcd" if rng.random() < 0.7]
    got = consensus.agreement(consensus.votes(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))).first()
    units = defaultdict(list)
    for i, _, _, said, _ in rows:
        units[i].append(said)
    units = {i: u for i, u in units.items() if len(u) > 1}
    n = Counter(x for u in units.values() for x in u)
    total = sum(n.values())
    apart = sum(sum(a != b for k, a in enumerate(u) for m, b in enumerate(u) if k != m) / (len(u) - 1) for u in units.values()) / total
    chance = sum(n[a] * n[b] for a in n for b in n if a != b) / (total * (total - 1))
    assert got.items == len(units) and got.alpha == pytest.approx(1 - apart / chance, abs=1e-5)
