from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from reportloom.operators import retrieval
from reportloom.plans import queries


def test_bootstrap_takes_all_rows(spark, tmp_path):
    rows = [(i, "a", 0.0 if i < 200 else 1.0) for i in range(1000)] + [(2000 + i, "b", float("nan") if i % 2 else 3.0) for i in range(20)] + [(5000, "b", None)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.g: (r.ci_lo, r.ci_hi) for r in queries.QUERIES["sta01_bootstrap"](spark, str(tmp_path)).collect()}
    half = 1.96 * (0.8 * 0.2 / 1000) ** 0.5
    assert got["a"] == pytest.approx((0.8 - half, 0.8 + half), abs=0.002) and got["b"] == (3.0, 3.0)


def test_tokens_of_long_texts(spark, tmp_path):
    texts = {1: "Ab, c_1!", 2: "Größe: 3,5 ok " * 400, 3: "x" * 30_000, 4: None, 5: "", 6: "a" * 2999, 7: "b" * 3000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.tokens for r in queries.QUERIES["txt01_tokens"](spark, str(tmp_path)).collect()}
    assert got == {i: [w.lower() for w in re.findall(r"\w+", t)] for i, t in texts.items() if t is not None}


@pytest.mark.parametrize("share", [0, 0.3, 0.9, 0.995])
def test_random_k_fills_every_query(spark, share):
    n, k = 600, 4
    group = {i: "hot" if i < share * n else (None if i % 50 == 0 else f"g{i % 9}") for i in range(n)}
    docs = spark.createDataFrame(list(group.items()), "id long, group_id string")
    got = {}
    for r in retrieval.random_k(docs, docs, k, 42).collect():
        got.setdefault(r.q, []).append((r["rank"], r.doc))
    place = lambda seed, i: int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:8], 16)
    for q, g in group.items():
        pool = [d for d, h in group.items() if d != q and (g is None or h is None or g != h)]
        after = sorted(pool, key=lambda d: ((place(42, d) - place(43, q)) % 2**32, d))
        assert [d for _, d in sorted(got.get(q, []))] == after[:k]


def test_exemplars_are_whole(spark, tmp_path):
    long = "kernel panic " * 500 + "the end"
    spark.createDataFrame([(1, long, "P"), (2, "kernel panic here", None), (3, "other words", "Q")], "doc_id long, text string, product string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "kernel panic")], "item_id long, text string").write.parquet(f"{tmp_path}/test_items.parquet")
    got = queries.QUERIES["ret12_exemplars"](spark, str(tmp_path)).collect()
    assert len(got) == 1 and set(got[0].examples.split(" ## ")) == {f"P:{long}", ":kernel panic here"}


def _weights(text, idf):
    w = [x.lower() for x in re.findall(r"\w+", text or "")]
    raw = {t: n * idf[t] for t, n in Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]).items() if t in idf}
    z = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / z for t, x in raw.items()}


@pytest.mark.parametrize("most", [None, 15])
def test_tfidf_has_word_pairs(spark, most):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choice(["Red", "fox", "ran", "far", "fast", "out"]) for _ in range(rng.randrange(1, 12))) for i in range(30)} | {30: None, 31: "", 32: "one"}
    asked = {1: "red fox ran", 2: "fast fox, fast fox!", 3: "fox"}
    counts = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, t in docs.items() for w in [[x.lower() for x in re.findall(r"\w+", t or "")]]}
    df, cf = Counter(t for c in counts.values() for t in c), sum(counts.values(), Counter())
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in sorted(df, key=lambda t: (-cf[t], t))[:most]}
    d, q = (spark.createDataFrame(list(x.items()), "id long, text string") for x in (docs, asked))
    assert {r.term: (r.df, round(r.idf, 9)) for r in retrieval.tfidf_terms(d, "id", "text", most).collect()} == {t: (df[t], round(x, 9)) for t, x in idf.items()}
    got = {(r.q, r.doc): r.score for r in retrieval.tfidf(q, d, "id", "id", "text", most).collect()}
    want = {(i, j): sum(x * v[t] for t, x in u.items() if t in v) for i, a in asked.items() for j, b in docs.items() for u, v in [(_weights(a, idf), _weights(b, idf))] if u.keys() & v.keys()}
    assert got == pytest.approx(want)


def test_tfidf_queries_have_word_pairs(spark, tmp_path):
    spark.createDataFrame([(1, "fox red"), (2, "red fox")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "red fox")], "item_id long, text string").write.parquet(f"{tmp_path}/test_items.parquet")
    assert {r.term for r in queries.QUERIES["ret01_tfidf_terms"](spark, str(tmp_path)).collect()} == {"red", "fox", "red fox", "fox red"}
    assert [r.doc_id for r in queries.QUERIES["ret05_tfidf_topk"](spark, str(tmp_path)).orderBy("rank").collect()] == [2, 1]
