"""Byte-level BPE encoding of a whole corpus by speculation and verification.

Each word's bytes are cut greedily into the longest tokens. Such a cut is the exact result
of the merges if and only if no merge would ever cross one of its cuts, which depends on
the two tokens beside the cut alone; all adjacent pairs of a batch are tested at once. Only
words with a failing pair go through the merges themselves.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reportloom.session import ship

#: Folder of the public vocabulary files; a parameter of ``encode_documents``.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pattern that cuts a text into words before any merge.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words a Python worker remembers before it starts anew; affects speed only.
REMEMBERED = 200_000
NEVER = np.int64(1 << 40)


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Encoder:
    """The vocabulary as arrays: how each token was merged, and which pairs merge."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        symbols = _byte_symbols()
        ids: dict[str, int] = model["vocab"]
        size = max(ids.values()) + 1
        self.spelled = {bytes(symbols[c] for c in s): i for s, i in ids.items()}
        self.byte_id = [self.spelled[bytes([b])] for b in range(256)]
        self.rank = np.full(size, -1, np.int64)  # when a token is made; bytes are there from the start
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = ids[a], ids[b], ids[a + b]
            self.merges[x, y] = (r, made)
            if self.rank[made] < 0 and len(a + b) > 1:
                self.rank[made], self.left[made], self.right[made] = r, x, y
        keys = np.array([(x << 20) | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # tokens that the merges don't give for their own bytes can't be proposed
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(size, bool)
        sound[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self.longest: dict[bytes, int] = {}
        self.proposable: dict[bytes, int] = {}
        for s, i in self.spelled.items():
            if sound[i]:
                self.proposable[s] = i
                self.longest[s[:2]] = max(self.longest.get(s[:2], 0), len(s))
        self.known: dict[str, list[int]] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge ranked below ``until`` crosses the cut between tokens a and b.

        Walks back in time: the pieces at the cut meet as pair (x, y) from when the later of
        the two is made until either is merged into its own token. A merge of (x, y) crosses
        if it is ranked before both of those, where on equal ranks the left one goes first.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        end = np.full(len(x), NEVER) if until is None else until.astype(np.int64)
        x_end, y_end = end.copy(), end.copy()
        fine = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            i, j = x[live], y[live]
            key = (i << 20) | j
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merge = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            crossed = (merge < x_end[live]) & ((merge < y_end[live]) | ((merge == y_end[live]) & (y_end[live] != end[live])))
            fine[live[crossed]] = False
            ri, rj = self.rank[i], self.rank[j]
            go = ~crossed & ((ri >= 0) | (rj >= 0))
            undo_left = go & (ri > rj)
            undo_right = go & ~undo_left
            k = live[undo_left]
            x_end[k], x[k] = self.rank[x[k]], self.right[x[k]]
            k = live[undo_right]
            y_end[k], y[k] = self.rank[y[k]], self.left[y[k]]
            live = live[go]
        return fine

    def propose(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        tokens, longest = self.proposable, self.longest
        while at < n:
            stop = min(n, at + longest.get(word[at : at + 2], 1))
            while stop > at + 1:
                t = tokens.get(word[at:stop])
                if t is not None:
                    break
                stop -= 1
            else:
                t = self.byte_id[word[at]]
            out.append(t)
            at = stop
        return out

    def merge(self, word: bytes) -> list[int]:
        """The merges one by one, lowest rank first, leftmost first on equal ranks."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        before, after, alive = [*range(-1, n - 1)], [*range(1, n + 1)], [True] * n
        queue = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, x, y = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = self.merges[x, y][1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merges.get((ids[i], ids[after[i]])):
                    heapq.heappush(queue, (m[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (m := self.merges.get((ids[before[i]], ids[i]))):
                heapq.heappush(queue, (m[0], before[i], ids[before[i]], ids[i]))
        return [t for t, a in zip(ids, alive) if a]

    def learn(self, words: set[str]) -> int:
        """Encode new words; the number of them that had to be merged."""
        new = list(words)
        spelled = [w.encode("utf-8", "surrogatepass") for w in new]
        cuts = [self.propose(s) for s in spelled]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((t for c in cuts for t in c), np.int64, int(sizes.sum()))
        failed: set[int] = set()
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(cuts)), sizes)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique((flat[inside] << 20) | flat[inside + 1], return_inverse=True)
            wrong = ~self.compatible(pairs >> 20, pairs & 0xFFFFF)
            failed = set(owner[inside[wrong[back]]].tolist())
        for i in failed:
            cuts[i] = self.merge(spelled[i])
        self.known.update(zip(new, cuts))
        return len(failed)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, without special tokens; null and empty texts give none."""
        cut = [WORDS.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = {w for words in cut for w in words if w not in known}
        if new:
            self.learn(new)
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def encode_documents(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
    vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json",
) -> DataFrame:
    """(doc_id, ids): every document as ids of the byte-level BPE ``vocabulary``.

    Null and empty texts give an empty list, blank ones are encoded as they are; strings of
    special tokens are ordinary text. Repeated rows stay. No shuffle: one pass over the text.
    The vocabulary file (under 2 MB) is read on the driver and broadcast.
    """
    spark = documents.sparkSession
    ship(spark)
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = encoder.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                flat = np.fromiter((t for r in rows for t in r), np.int32, int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return documents.select(doc_id, text).mapInArrow(run, "doc_id bigint, ids array<int>")
