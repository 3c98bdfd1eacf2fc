from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reportloom.functions import scoring, sections
from reportloom.functions import text as tx


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [(None, ""), (" NaN ", ""), ("none", ""), (" a b ", "a b"), ("null?", "null?")])
def test_clean_cell(spark, raw, want):
    assert one(spark, raw, tx.clean_cell) == want


def test_tokens_and_lines(spark):
    assert one(spark, "été_1 ok", tx.tokens) == ["été_1", "ok"]
    assert one(spark, "a\nb\r\nc\n", tx.lines) == ["a", "b", "c"]
    assert one(spark, "", tx.lines) == []
    assert one(spark, "1. a\n2) b\n- c\n* d\n3.x\n-e", tx.step_count) == 4


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("my-file.txt", "FILE", ["my-file.txt"]), ("my-file.txt", "FLAG", ["file.txt"]), ("file.txt", "FLAG", []),
        ("https://example.com/a", "URL", ["https://example.com/a"]), ("https://example.com/a", "FLAG", ["example.com"]),
        ("1234567", "HASH", ["1234567"]), ("123456", "HASH", []), ("dom.ipc.x:true", "FLAG", ["dom.ipc.x:true"]), ("", "URL", []),
    ],
)
def test_entities(spark, text, kind, want):
    assert one(spark, text, lambda c: tx.entities(c, kind)) == want


def test_attribution_is_a_partition(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a"], ["a", "b"])], "o array<string>, i array<string>, r array<string>")
    r = df.select(tx.attribution(F.col("o"), F.col("i"), F.col("r")).alias("a")).first().a
    assert (r.input, r.retrieval, r.unattributed) == (1, 1, 1)


def test_masks_and_names(spark):
    assert one(spark, "see www.a.b and x.log at abcdef1", tx.masked) == "see <URL> and <FILE> at <HASH>"
    assert one(spark, " a//b  c ", tx.safe_name) == "a_b_c" and one(spark, None, tx.safe_name) == "none"
    assert one(spark, "a|b|c", tx.last_part) == "c" and one(spark, "a|b|c", tx.before_last) == "a|b"


def test_truncation_and_prompt(spark):
    df = spark.createDataFrame([(list("abcdef"), [3, 4, 5])], "t array<string>, s array<int>")
    r = df.select(
        tx.truncated(F.col("t"), 3, "head").alias("h"), tx.truncated(F.col("t"), 3, "tail").alias("l"), tx.truncated(F.col("t"), 3, "head_tail").alias("b"),
        tx.fitting_examples(F.col("s"), F.lit(8)).alias("k"),
        tx.prompt(F.lit("S"), F.array(F.struct(F.lit("i").alias("given"), F.lit("o").alias("made"))), F.lit("x")).alias("p"),
    ).first()
    assert (r.h, r.l, r.b, r.k) == (["a", "b", "c"], ["d", "e", "f"], ["a", "e", "f"], 2)
    assert r.p == "S\n\n### Example Input:\ni\n\n### Example Bug Report:\no\n\n\n### Input:\nx\n\n### Response:\n"


def parse(spark, text):
    rows = sections.with_sections(spark.createDataFrame([(text, "z")], "t string, name string"), "t", "parts")
    m = sections.section_metrics(F.col("t"), F.col("parts"))
    return rows.select("parts", *[c.alias(k) for k, c in m.items()]).first()


def test_sections(spark):
    r = parse(spark, "before\n**Actual result**: it fails\nmore\n[guide](http://a.b)\n**notes**\n**notes**\nx")
    assert [(s.name, s.body) for s in r.parts] == [("actual", "it fails\nmore"), ("guide", "(http://a.b)"), ("notes", ""), ("notes", "x")]
    assert r.dup_sections == 1 and r.sec_presence == 0.25 and r.placeholder_rate == 0.75 and r.unknown_rate == 0.75


def test_two_steps_and_placeholders(spark):
    assert parse(spark, "**Steps to Reproduce**\n1. one").sec_filled == 0 and parse(spark, "**Steps to Reproduce**\n1. one\n2. two").sec_filled == 0.25
    assert one(spark, "see <URL> for more words here", sections.is_placeholder) and one(spark, "N/A", sections.is_placeholder) and not one(spark, "fine", sections.is_placeholder)
    assert parse(spark, None).parts == [] and parse(spark, "").word_count == 0


def test_no_signals(spark):
    rows = sections.with_sections(spark.createDataFrame([("plain words", "")], "i string, t string"), "t", "parts")
    a = sections.alignment(sections.signals(F.col("i")), F.col("parts"))
    r = rows.select(*[c.alias(k) for k, c in a.items()]).first()
    assert (r.signal_count, r.signal_filled, r.nosignal_filled, r.cond_filled) == (0.0, 1.0, 1.0, 1.0)


@pytest.mark.parametrize(("tokens", "loss"), [(100, 0.05), (700, 0.0), (2200, 0.25)])
def test_length_penalty(spark, tokens, loss):
    zero = {k: F.lit(0.0) for k in ("pres", "sig", "nosig", "filled", "placeholder", "unknown", "dup", "ua", "iu")}
    score = scoring.preference_score("balanced", "v2", zero | {"cond": F.lit(1.0), "tokens": F.lit(tokens)})
    assert spark.range(1).select(score.alias("s")).first().s == pytest.approx(0.55 - 0.05 * loss)


def test_rouge(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b", "c"])], "a array<string>, b array<string>")
    r = df.select(*[c.alias(k) for k, c in scoring.rouge1(F.col("a"), F.col("b")).items()]).first()
    assert r.rouge1_r == pytest.approx(2 / 3) and r.rouge1_f1 == pytest.approx(2 * (2 / 4) * (2 / 3) / (2 / 4 + 2 / 3))


@pytest.mark.parametrize("text", ["", "no entity", "a.b and c.d", "x.y", "see https://e.x/a.b, then www.q.r!", "é a.b漢 c.d"])
def test_spans(spark, text):
    for kind in tx.KINDS:
        got = one(spark, text, lambda c, k=kind: tx.spans(c, k))
        assert all(text[s.start : s.end] == s.surface for s in got)
        assert [s.surface for s in got] == one(spark, text, lambda c, k=kind: tx.all_matches(c, k))
