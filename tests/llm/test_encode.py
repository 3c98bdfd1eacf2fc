from __future__ import annotations

import random

import pytest

from reportloom.llm import encode

VOCABULARY = f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json"
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello world", "<|endoftext|> is text", "naïve café “quotes” 東京 привет", "a" * 5000, " " * 3000, "aaaa aaa aa",
    "0x58b70ab3 don't WE'LL it's", "​zero​width", "😀👍🏽", "==========", "\r\n\r\n", "\x00\x01",
]


@pytest.fixture(scope="module")
def own() -> encode.Encoder:
    return encode.Encoder(open(VOCABULARY, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_same_as_library(own, library):
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS]
    letters = "abcdeinorst ABC'.,-_0123456789éß漢字\n"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinsr") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    assert own.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pair_check_against_merging(own):
    rng = random.Random(2)
    tokens = list(own.proposable.items())
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(20000)]
    import numpy as np

    got = own.compatible(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    assert got.tolist() == [own.merge(a[0] + b[0]) == [a[1], b[1]] for a, b in pairs]


def test_proposable_tokens_encode_to_themselves(own):
    assert all(own.merge(s) == [i] for s, i in own.proposable.items())


def test_documents(spark):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None)], "doc_id long, text string, ids string, lang array<int>")
    rows = encode.encode_documents(df).collect()
    assert len(rows) == len(TEXTS) + 1
    by = {r.doc_id: r.ids for r in rows}
    assert by[0] == [] and by[1] == [] and by[2] == [220]
    back = {i: s for s, i in encode.Encoder(open(VOCABULARY, encoding="utf-8").read()).spelled.items()}
    for i, t in enumerate(TEXTS):
        assert b"".join(back[x] for x in by[i]).decode() == (t or "")
    assert encode.encode_documents(df.limit(0)).count() == 0
