from __future__ import annotations

import random

from reportloom.llm import leak

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(4)) for _ in range(4000)]


def passage(n: int) -> list[str]:
    return [RNG.choice(WORDS) for _ in range(n)]


ITEM = passage(60)
ITEM_B = passage(40)


def edited(words: list[str], every: int) -> list[str]:
    out = []
    for i, w in enumerate(words):
        if i % every == every - 1:
            out += ["changed"] if i % 2 else [w, "added"]
        else:
            out.append(w)
    return out


def find(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, " ".join(ITEM)), (2, " ".join(ITEM_B)), (3, None), (4, ""), (5, "too short")], "item_id long, text string")
    return docs, items


def test_cases(spark):
    text = " ".join
    docs, items = find(
        spark,
        [
            text(passage(50) + ITEM + passage(50)),
            text(passage(5) + ITEM[20:45] + passage(300)),
            text(passage(5) + ITEM[20:39] + passage(30)),
            "<p>" + "</p>\n**".join(w.upper() for w in edited(ITEM, 11)) + "</p>",
            text(ITEM[10:36] + passage(40) + ITEM_B[:26]),
            None,
            "",
            " ",
            text(w + "​" for w in ITEM[:30]),
            text(passage(40) + ITEM[:19] + passage(8) + ITEM[30:49]),
            text(passage(20000) + edited(ITEM, 10)),
        ],
    )
    spans = leak.passages(docs, items)
    got = {(r.doc_id, r.item_id) for r in leak.found(spans).collect()}
    assert got == {(0, 1), (1, 1), (3, 1), (4, 1), (4, 2), (8, 1), (10, 1)}
    blocks = leak.passages(docs, items, block_chars=100)
    assert {(r.doc_id, r.item_id) for r in leak.found(blocks).collect()} == got


def test_cleaned(spark):
    before, after = "Keep this. ", " And that too, please, as it is not part of it at all, nor is this sentence or the next one here."
    docs, items = find(spark, [before * 30 + " ".join(ITEM) + after, "Untouched.", None, " ".join(ITEM), ""])
    rows = {r.doc_id: r for r in leak.cleaned(docs, items).collect()}
    assert rows[0].text == before * 30 + after and rows[0].removed_chars == len(" ".join(ITEM)) and not rows[0].dropped
    assert rows[1].text == "Untouched." and rows[2].text is None and rows[4].text == ""
    assert rows[3].text is None and rows[3].dropped
    assert {r.doc_id: r for r in leak.cleaned(docs, items, block_chars=100).collect()} == rows


def test_span_and_changes():
    index = leak.Index([(1, " ".join(ITEM))])
    hit = lambda words: [r[1] for r in index.scan([" ".join([*passage(9), *words, *passage(9)])])]
    changed = lambda at: ["new" if i in at else w for i, w in enumerate(ITEM[:25])]
    assert hit(ITEM[:25]) == hit(changed({24})) == hit(changed({0, 12})) == hit(changed({0, 1, 24})) == [1]
    assert hit(ITEM[:21]) == hit(changed({4, 9, 14, 19})) == []
    assert leak.without("abcdefgh", [(4, 6), (1, 3), (2, 5)]) == "agh"


def test_empty(spark):
    docs, items = find(spark, ["a b c"])
    assert leak.passages(docs.limit(0), items).count() == 0
    assert leak.passages(docs, items.limit(0)).count() == 0
