from __future__ import annotations

import datetime as dt
import random

import pytest

from reportloom.llm import defects

EN = ["the window stays blank after a restart and the list never loads again", "users report that nothing happens when they open the file",
      "the menu should close when the button is pressed", "memory grows while the page is loading and the tab hangs"]
DE = ["nach dem neustart bleibt das fenster leer und die liste wird nicht geladen", "die nutzer melden dass beim öffnen der datei nichts geschieht",
      "das menü soll sich schließen wenn der knopf gedrückt wird", "der speicher wächst während die seite lädt und der reiter hängt"]


def report(rng: random.Random, sentences: list[str] = EN) -> str:
    s = [rng.choice(sentences).capitalize() + "." for _ in range(4)]
    return f"**Summary**\n{s[0]}\n**Steps to Reproduce**\n1. {s[1]}\n2. {s[2]}\n**Actual Result**\n{s[3]}\n**Environment**\nVersion {rng.randrange(9)}.{rng.randrange(9)}.1"


@pytest.fixture(scope="module")
def models():
    rng = random.Random(1)
    texts = [(lang, " ".join(rng.choice(s) for _ in range(20))) for lang, s in (("en", EN), ("de", DE)) for _ in range(10)]
    return defects.Languages(texts), defects.Endings([report(rng) for _ in range(200)])


def verdicts(models, pairs):
    return defects.classify([p for p, _ in pairs], [a for _, a in pairs], *models)


def test_kinds(models):
    rng = random.Random(2)
    prompt = "When I drag the folder, the panel of the archive turns blurry. It worked in 3.1. Why does it lock the column?"
    good = report(rng)
    cases = [
        (good, None), ("Unfortunately the log is partial, but the rest is clear.\n" + good, None), (good.replace("**Env", "It reads “" + DE[0] + "”.\n**Env"), None),
        (None, "empty"), ("", "empty"), (" ​", "empty"), ("<br><br/>", "empty"), ("N/A", "empty"), ("```\n```", "empty"),
        ("**Summary**\n\n**Steps to Reproduce**\n", "empty"), ("[Summary]\nN/A\n[Actual]\nN/A", "empty"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("Sorry — I won’t write this report.", "refusal"),
        ("**Summary**\nI must decline. My guidelines do not allow me to write this.", "refusal"),
        ("Unfortunately it would not be appropriate for me to do so.", "refusal"), ("Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"),
        ("I cannot see the screenshot; the text was enough.\n" + good, None),
        (prompt, "copy"), ("Rewritten:\n" + prompt.lower().replace(" ", "\n") + "\nEnd.", "copy"), (prompt.replace("folder", "fodler"), "copy"),
        (report(rng, DE), "other_language"), (" ".join(DE) + ".", "other_language"),
        (good[: good.index("2.") + 2], "truncated"), (good[: good.index("**Actual") - 9], "truncated"), (good[: good.index("\nVersion")], "truncated"),
    ]
    assert verdicts(models, [(prompt, a) for a, _ in cases]) == [d for _, d in cases]


def test_prompt_without_text(models):
    good = report(random.Random(3))
    assert verdicts(models, [(None, good), ("", good), (None, good[:40])]) == [None, None, "truncated"]


def test_held_out_languages(models):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(s) for _ in range(3)) for s in [EN, DE] * 50]
    scores, _ = models[0].likelihoods(texts)
    assert [models[0].names[k] for k in scores.argmax(axis=1)] == ["en", "de"] * 50


def test_held_out_endings(models):
    rng = random.Random(11)
    whole = [report(rng) for _ in range(100)]
    assert all(models[1].of(t) >= defects.END_CHANCE for t in whole)
    cut = [t[: rng.randrange(20, len(t) - 20)] for t in whole]
    assert sum(models[1].of(t) < defects.END_CHANCE for t in cut) >= 95


def test_latest_row_counts(spark, models):
    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    good = report(random.Random(5))
    rows = [("o", 1, "p", "", t[0], 1), ("o", 1, "p", good, t[1], 1), ("o", 2, "p", good, t[0], 1), ("o", 2, "p", "", t[1], 1), ("o", 2, "p", "", t[1], 1),
            ("o", None, "p", "", t[0], 1), ("o", 3, None, None, None, 1), ("o", 4, "p", "x. " * 100000, t[0], 1)]
    df = spark.createDataFrame(rows, "origin string, record_id long, prompt string, answer string, at timestamp, defect int")
    assert {tuple(r) for r in defects.find(df, *models).collect()} == {("o", 2, "empty"), ("o", 3, "empty")}
    assert defects.find(df.limit(0), *models).count() == 0


def test_samples(spark):
    rows = [(i, (EN if i % 2 else DE)[i % 4] * 3, ("en-US" if i % 2 else " DE")) for i in range(40)] + [(99, None, "en"), (98, EN[0] * 3, None), (97, EN[0] * 3, "und")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = defects.language_sample(docs, rows=8)
    assert sorted({lang for lang, _ in got}) == ["de", "en"] and len(got) == 16
    assert len(defects.ending_sample(docs.select("text"), rows=3)) == 3


def test_no_caps(models):
    good = report(random.Random(4))
    offer = " You could ask the maintainers of the product, who know the matter and may describe it." * 12
    long_refusal = "I'm sorry, but I can't write this report." + offer
    prose = "I cannot open the archive since the update. " + " ".join(s.capitalize() + "." for s in EN * 10)
    tag = "<span style='" + "x" * 5000 + "'>"
    cases = [
        (long_refusal, "refusal"), ("**Summary**\nI'm sorry, but I can't help with that.\n**Steps**\nI cannot write this section." + offer, "refusal"),
        ("N/A " * 400, "empty"), (tag + "</span>", "empty"), (tag + long_refusal, "refusal"),
    ]
    assert verdicts(models, [("Describe it", a) for a, _ in cases]) == [d for _, d in cases]
    assert not defects.declines(prose) and not defects.declines("I'm sorry, but I can't read the log.\n" + good)


def test_models_are_fitted_on_all_texts(spark, monkeypatch):
    rng = random.Random(12)
    texts = [report(rng, rng.choice([EN, DE])) for _ in range(150)] + [". ".join(rng.choice(EN).capitalize() for _ in range(5)) + "." for _ in range(40)]
    texts += ["**Summary**\nA table ``` of a | b. And c.\n``` follows here, it is long enough to count among the texts ;)", texts[0]]
    docs = [(i, t, lang) for i, (t, lang) in enumerate((" ".join(rng.sample(s, 3)), lang) for s, lang in ((EN, "en-US"), (DE, " DE")) for _ in range(300))]
    monkeypatch.setattr(defects, "HELD", 50)  # tasks hand on their counts in several pieces
    got = defects.all_endings(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = defects.Endings(sorted(set(texts)))
    assert got.chance == want.chance and got.running and want.running
    model = defects.all_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3))
    whole = defects.Languages([(lang.strip()[:2].lower(), t) for _, t, lang in docs])
    assert model.names == whole.names == ["de", "en"] and (model.table == whole.table).all()


def test_query_takes_no_sample(spark, monkeypatch):
    from reportloom.llm import queries

    def sampled(*_):
        raise AssertionError("a model is fitted on a sample")

    monkeypatch.setattr(defects, "language_sample", sampled)
    monkeypatch.setattr(defects, "ending_sample", sampled)
    assert queries.p4_found(spark, "/root/testdata/sf0.001").count() > 0


def test_strange_words_weigh_the_same_in_many_texts():
    counted = defects.Languages.tally([("en", " ".join(EN)), ("de", " ".join(DE))])
    few, many = (defects.Languages.of_counts({k: v * n for k, v in counted.items()}) for n in (1000, 100_000))
    strange = "zanbopertel quirivor xihafa vitorfawen"
    assert abs(few.likelihoods([strange])[0] - many.likelihoods([strange])[0]).max() < 0.01 * len(strange)
