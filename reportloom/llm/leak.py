"""Evaluation passages inside training documents: n-gram seeds, then verified alignment."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.session import ship

#: Words of a seed. A passage of 25 words with three of them changed keeps at least six seeds.
SEED = 5
SEEDS = 5
#: A passage counts from so many words of the item in a row ...
SPAN = 25
#: ... with at most so many words changed, added or left out among them: one in ten, rounded up.
ERRORS = 3
#: How far insertions may shift a passage.
BAND = 6
#: Characters of items that one broadcast may hold; more items are scanned in blocks.
BLOCK_CHARS = 8_000_000

INVISIBLE = "​‌‍⁠﻿­"
_WORD = re.compile(rf"[^\W_]+(?:[{INVISIBLE}]+[^\W_]+)*")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&#?\w{1,10};")
_DROP = str.maketrans("", "", INVISIBLE)


def unmarked(text: str) -> str:
    """The text with markup blanked out; every other character keeps its place."""
    if "<" not in text and "&" not in text:
        return text
    return _MARKUP.sub(lambda m: " " * len(m[0]), text)


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, white space and markup."""
    if not text:
        return []
    words = [w.lower() for w in _WORD.findall(unmarked(text))]
    if any(c in text for c in INVISIBLE):
        words = [w.translate(_DROP) for w in words]
    return words


class Index:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for at, code in enumerate(self.codes(np.array(ids, np.int64))):
                places[int(code)].append((len(self.items), at))
            self.items.append((item_id, ids))
        keys = sorted(places)
        self.keys = np.array(keys, np.int64)
        self.starts = np.cumsum([0] + [len(places[k]) for k in keys])
        flat = np.array([p for k in keys for p in places[k]], np.int64).reshape(-1, 2)
        self.item_of, self.at_of = flat[:, 0], flat[:, 1]

    @staticmethod
    def codes(ids: np.ndarray) -> np.ndarray:
        """A 64-bit code of each window of ``SEED`` words."""
        n = len(ids) - SEED + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            code = np.zeros(n, np.int64)
            for k in range(SEED):
                code = code * np.int64(6364136223846793005) + ids[k : k + n] * np.int64(1442695040888963407) + 1
                code ^= code >> np.int64(29)
        return code

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item_id, first word, last word) of every passage found in ``texts``."""
        get = self.vocabulary.get
        rows = [[get(w, 0) for w in words_of(t)] for t in texts]
        sizes = [len(r) for r in rows]
        starts = np.cumsum([0] + sizes)
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(starts[-1]))
        if len(flat) < SEED or not len(self.keys):
            return
        # only windows made of item words can be seeds, and none may cross two texts
        strange = np.cumsum(np.concatenate(([0], flat == 0)))
        at = np.flatnonzero(strange[SEED:] == strange[:-SEED])
        owner = np.searchsorted(starts, at, side="right") - 1
        keep = at + SEED <= starts[owner + 1]
        at, owner = at[keep], owner[keep]
        if not len(at):
            return
        code = self.codes(flat)[at]
        slot = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        hit = self.keys[slot] == code
        at, owner, slot = at[hit], owner[hit], slot[hit]
        times = self.starts[slot + 1] - self.starts[slot]
        first = np.repeat(self.starts[slot] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(int(times.sum()))
        at, owner = np.repeat(at - starts[owner], times), np.repeat(owner, times)
        item, place = self.item_of[first], self.at_of[first]
        group = owner * np.int64(len(self.items)) + item
        order = np.lexsort((at, group))
        group, at, place = group[order], at[order], place[order]
        bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= SEEDS:
                text, item_no = divmod(int(group[a]), len(self.items))
                item_id, words = self.items[item_no]
                for lo, hi in self.passages(rows[text], words, at[a:b].tolist(), place[a:b].tolist()):
                    yield text, item_id, lo, hi

    def passages(self, doc: list[int], item: list[int], at: list[int], place: list[int]) -> Iterator[tuple[int, int]]:
        """Verified passages (first, last word) among the seeds of one document and item."""
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, q in zip(at, place):
            by[(p - q) // BAND].append((p, q))
        found: list[tuple[int, int]] = []
        for cell in sorted(by):
            seeds = sorted(by[cell] + by.get(cell + 1, []))
            at0 = 0
            while at0 < len(seeds):  # runs of seeds without a wide gap
                to = at0
                while to + 1 < len(seeds) and seeds[to + 1][0] - seeds[to][0] <= SPAN:
                    to += 1
                run = seeds[at0 : to + 1]
                if len(run) >= SEEDS and not any(lo <= run[0][0] and run[-1][0] <= hi for lo, hi in found):
                    middle = sorted(p - q for p, q in run)[len(run) // 2]
                    spot = align(doc, item, max(0, run[0][0] - SPAN), min(len(doc), run[-1][0] + SEED + SPAN), middle)
                    if spot:
                        found.append(spot)
                        yield spot
                at0 = to + 1


def align(doc: list[int], item: list[int], start: int, stop: int, shift: int) -> tuple[int, int] | None:
    """The widest stretch of ``doc[start:stop]`` that repeats the item, or None.

    Local alignment near the diagonal ``shift``; ``SPAN`` words of the item in a row with at
    most ``ERRORS`` edits must be found. They may reach over the ends of the alignment, which
    leaves out changed words at its edges; words of the item there count as edits.
    """
    width = 2 * BAND
    best, best_at = 0, None
    score: dict[tuple[int, int], int] = {}
    step: dict[tuple[int, int], int] = {}
    for p in range(start, stop):
        w = doc[p]
        for q in range(max(0, p - shift - width), min(len(item), p - shift + width + 1)):
            match = w == item[q]
            s = score.get((p - 1, q - 1), 0) + (1 if match else -1)
            move = 0
            up, side = score.get((p - 1, q), 0) - 1, score.get((p, q - 1), 0) - 1
            if up > s:
                s, move = up, 1
            if side > s:
                s, move = side, 2
            if s > 0:
                score[p, q], step[p, q] = s, move
                if s > best:
                    best, best_at = s, (p, q)
    path: list[tuple[int, int, bool, bool]] = []  # word of doc, of item, edited, uses a word of the item
    cell = best_at
    while cell in score:
        p, q = cell
        move = step[cell]
        path.append((p, q, move != 0 or doc[p] != item[q], move != 1))
        cell = (p - 1, q - 1) if move == 0 else (p - 1, q) if move == 1 else (p, q - 1)
    path.reverse()
    if not path:
        return None
    ends = path[0][0], path[-1][0]
    edge = (0, 0, True, True)
    path = [edge] * min(ERRORS, path[0][1]) + path + [edge] * min(ERRORS, len(item) - 1 - path[-1][1])
    lo = used = edits = 0
    for hi in range(len(path)):
        used += path[hi][3]
        edits += path[hi][2]
        while used > SPAN or (used == SPAN and not path[lo][3]):
            used -= path[lo][3]
            edits -= path[lo][2]
            lo += 1
        if used == SPAN and edits <= ERRORS:
            return ends
    return None


_INDEXES: dict[str, Index] = {}


def _index(name: str, rows: list[tuple[int, str]]) -> Index:
    """The index of a block, built once for each Python worker."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(rows)
    return _INDEXES[name]


def _blocks(items: DataFrame, block_chars: int) -> list[tuple[str, Broadcast]]:
    """Named broadcasts of the items, of at most ``block_chars`` characters each, or of one item that is longer."""
    key = F.xxhash64("item_id", "text")
    total = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = max(1, -(-int(total) // block_chars))
    while True:
        sizes = items.groupBy(F.pmod(key, F.lit(parts)).alias("part")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
        if not sizes.where((F.col("n") > 1) & (F.col("chars") > block_chars)).limit(1).count():
            break
        parts *= 2
    out = []
    for k in range(parts):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(key, F.lit(parts)) == k).collect()]  # of checked size
        out.append((uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(rows)))
    return out


def _found_in(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """(text, item_id, first character, one behind the last) of every passage."""
    out = []
    places: dict[int, list[tuple[int, int]]] = {}
    for t, item, lo, hi in index.scan(texts):
        if t not in places:
            places[t] = [m.span() for m in _WORD.finditer(unmarked(texts[t]))]
        out.append((t, item, places[t][lo][0], places[t][hi][1]))
    return out


def _wanted(items: DataFrame, item_id: str, text: str) -> DataFrame:
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return rows.where("item_id is not null and text is not null").distinct()


def passages(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, first_char, last_char): each item passage that a document contains.

    A passage is 25 or more consecutive words of the item with at most one in ten changed or
    added, regardless of case, punctuation, white space and markup. Null and empty texts
    contain none; items shorter than that are contained in none. One pass over the documents
    for each ``block_chars`` characters of items, so the broadcast has a bound; no shuffle.
    """
    ship(documents.sparkSession)
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    result = None
    for name, shared in _blocks(_wanted(items, item_id, item_text), block_chars):

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    out = [(ids[t], *rest) for t, *rest in _found_in(index, texts)]
                    columns = list(zip(*out)) if out else [[]] * 4
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "first_char", "last_char"]
                    )

        found = source.mapInArrow(run, "doc_id bigint, item_id bigint, first_char int, last_char int")
        result = found if result is None else result.unionByName(found)
    return result


def found(spans: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id)."""
    return spans.select("doc_id", "item_id").distinct()


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the stretches ``cuts``, which may overlap."""
    out, at = [], 0
    for lo, hi in sorted(cuts):
        out.append(text[at : max(at, lo)])
        at = max(at, hi)
    return "".join(out) + text[at:]


def cleaned(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_chars: int = BLOCK_CHARS, most: float = 0.5,
) -> DataFrame:
    """(doc_id, text, removed_chars, dropped): the documents without their passages.

    Passages are cut out of the text; a document of which they make up more than the share
    ``most`` is dropped: its text becomes null. Documents without passages stay as they are.
    One pass over the documents without a shuffle; further blocks of items are further steps
    of the same pass, which hand the cuts on.
    """
    ship(documents.sparkSession)
    blocks = _blocks(_wanted(items, item_id, item_text), block_chars)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<int>").alias("cuts"))
    for name, shared in blocks:

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    cuts = part.column(2).to_pylist()
                    for t, _, lo, hi in _found_in(index, part.column(1).to_pylist()):
                        cuts[t] += [lo, hi]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cuts, pa.list_(pa.int32()))], ["doc_id", "text", "cuts"])

        rows = rows.mapInArrow(run, "doc_id bigint, text string, cuts array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept = without(t, list(zip(c[::2], c[1::2]))) if c else t
                removed = len(t) - len(kept) if c else 0
                dropped = bool(c) and removed > most * len(t)
                out.append((None if dropped else kept, removed, dropped))
            texts, removed, dropped = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32()), pa.array(dropped, pa.bool_())],
                ["doc_id", "text", "removed_chars", "dropped"],
            )

    return rows.mapInArrow(cut, "doc_id bigint, text string, removed_chars int, dropped boolean")
