"""Top-k of a stated query set in one scan: Arrow batches of documents times a broadcast query matrix.

The corpus isn't shuffled. Each batch is scored for all queries by a matrix product, and only
its best k for each query go on. The queries must be few (``SCAN_QUERIES``, ``SCAN_WEIGHTS``),
which is checked; for more there is the join of postings in ``reportloom.operators.retrieval``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.operators import retrieval
from reportloom.session import ship

#: Queries, and weights of terms in queries, that one scan may broadcast.
SCAN_QUERIES, SCAN_WEIGHTS = 4000, 2_000_000
#: Queries of one matrix product, and documents of one.
COLUMNS, ROWS = 256, 500
HITS = "q bigint, doc bigint, score double"


@dataclass
class Asked:
    """The queries: ids, groups, and the weights of their terms (term number, query number, weight)."""

    ids: np.ndarray
    groups: list[str | None]
    terms: list[str]
    term_of: np.ndarray
    query_of: np.ndarray
    weight: np.ndarray

    def blocks(self) -> list[tuple[slice, np.ndarray, np.ndarray]]:
        """(queries, their terms, matrix of terms and queries) of each block of queries."""
        out = []
        for at in range(0, len(self.ids), COLUMNS):
            part = slice(at, min(at + COLUMNS, len(self.ids)))
            inside = (self.query_of >= part.start) & (self.query_of < part.stop)
            used, row = np.unique(self.term_of[inside], return_inverse=True)
            matrix = np.zeros((len(used), part.stop - part.start))
            matrix[row, self.query_of[inside] - part.start] = self.weight[inside]
            out.append((part, used, matrix))
        return out


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-case word tokens of the texts, and the text of each."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{N}_]+")
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), owner.filter(keep).to_numpy().astype(np.int64)


def runs_of(flat: pa.Array, owner: np.ndarray, most_words: int) -> tuple[pa.Array, np.ndarray]:
    """Runs of one to ``most_words`` words of each text, joined by blanks, and the text of each."""
    parts, owners, run, by = [flat], [owner], flat, owner
    for k in range(1, most_words):
        n = max(0, len(flat) - k)
        run = pc.binary_join_element_wise(run[:n], flat[k:], pa.scalar(" ", pa.large_string()))
        same = by[:n] == owner[k:]
        parts.append(run.filter(pa.array(same)))
        owners.append(owner[:n][same])
        by = by[:n]
    return pa.concat_arrays(parts), np.concatenate(owners)


def best_of(scores: np.ndarray, ids: np.ndarray, fine: np.ndarray, k: int, digits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the best k rows of each column among the ``fine`` cells, ties to the smaller id."""
    rounded = np.where(fine, np.round(scores, digits), -np.inf)
    out_q, out_r = [], []
    if len(ids) > k:
        least = np.partition(rounded, len(ids) - k, axis=0)[len(ids) - k]
    else:
        least = np.full(scores.shape[1], -np.inf)
    rows, columns = np.nonzero(fine & (rounded >= least))
    order = np.lexsort((ids[rows], -rounded[rows, columns], columns))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(columns, np.arange(scores.shape[1]))
    keep = np.arange(len(columns)) - first[columns] < k
    out_q, out_r = columns[keep], rows[keep]
    return out_q, out_r


def _allowed(asked: Asked, part: slice, ids: np.ndarray, groups: list[str | None] | None) -> np.ndarray:
    """Documents that each query may have: not itself, none of its group; a null group bans nothing."""
    if groups is None:
        return np.ones((len(ids), part.stop - part.start), bool)
    number = {g: i for i, g in enumerate({g for g in asked.groups if g is not None})}
    theirs = np.array([number.get(g, -1) for g in groups])
    own = np.array([-2 if g is None else number[g] for g in asked.groups[part]])
    return (ids[:, None] != asked.ids[None, part]) & (theirs[:, None] != own[None, :])


def _hits(batches: Iterator[pa.RecordBatch], asked: Asked, k: int, banned: bool, weigh: Callable) -> Iterator[pa.RecordBatch]:
    """The best k hits of each batch; ``weigh`` gives (row, term number, weight) of its documents."""
    blocks = asked.blocks()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            chunk = batch.slice(at, ROWS)
            ids = chunk.column(0).to_numpy(zero_copy_only=False)
            row, term, weight = weigh(chunk.column(1))
            wide = np.zeros((len(ids), len(asked.terms)))
            wide[row, term] = weight
            for part, used, matrix in blocks:
                scores = wide[:, used] @ matrix
                fine = (scores > 0) & _allowed(asked, part, ids, chunk.column(2).to_pylist() if banned else None)
                q, r = best_of(scores, ids, fine, k)
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids[part][q]), pa.array(ids[r]), pa.array(scores[r, q])], ["q", "doc", "score"])


def _asked(queries: DataFrame, query: str, text: str, group: str | None, most_words: int) -> Asked | None:
    """The queries with the frequencies of their terms as weights, or None if they are too many."""
    rows = queries.select(F.col(query).alias("q"), (F.col(group) if group else F.lit(None).cast("string")).alias("g"), F.col(text).alias("t"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    # a word takes two characters at least
    if size.n > SCAN_QUERIES or size.chars * most_words > 2 * SCAN_WEIGHTS:
        return None
    found = rows.orderBy("q").toArrow()  # of checked size
    ids = found.column("q").to_numpy()
    flat, owner = tokens_of(found.column("t").combine_chunks())
    runs, owner = runs_of(flat, owner, most_words)
    coded = runs.dictionary_encode()
    terms = coded.dictionary.to_pylist()
    keys, counts = np.unique(owner * max(1, len(terms)) + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    return Asked(ids, found.column("g").to_pylist(), terms, keys % max(1, len(terms)), keys // max(1, len(terms)), counts.astype(float))


def _with_weights(asked: Asked, factor: np.ndarray) -> Asked:
    """The queries with each term's weight times ``factor``."""
    return Asked(asked.ids, asked.groups, asked.terms, asked.term_of, asked.query_of, asked.weight * factor[asked.term_of])


def _source(docs: DataFrame, doc: str, text: str, group: str | None) -> DataFrame:
    return docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"), *([F.col(group).alias("g")] if group else []))


def bm25_topk(
    queries: DataFrame, docs: DataFrame, query: str, doc: str, text: str, k: int, group: str | None = None, query_group: str | None = None, k1: float = 1.5, b: float = 0.75
) -> DataFrame:
    """(q, doc, score, rank): the best k documents of each query by BM25, ties to the smaller document.

    With ``group`` a query has neither itself nor documents of its group. Two scans: one counts
    documents, tokens and the document frequencies of the queries' terms, one scores.
    """
    spark = docs.sparkSession
    asked = _asked(queries, query, text, query_group, 1)
    if asked is None:
        scores = retrieval.bm25(queries, docs, query, doc, text, k1, b)
        if group:
            scores = retrieval.without_own(scores, docs.select(F.col(doc).alias("id"), F.col(group).alias("group_id")))
        return retrieval.top_k(scores, "q", "doc", k)
    ship(spark)
    vocabulary = pa.array(asked.terms, pa.large_string())
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        df, n, length = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            flat, owner = tokens_of(batch.column(1))
            n, length = n + batch.num_rows, length + len(flat)
            at = pc.fill_null(pc.index_in(flat, known), -1).to_numpy().astype(np.int64)
            pairs = np.unique(owner[at >= 0] * max(1, len(known)) + at[at >= 0])
            df += np.bincount(pairs % max(1, len(known)), minlength=len(known))
        terms = np.concatenate([np.flatnonzero(df), [-1, -2]])
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.concatenate([df[df > 0], [n, length]]))], ["term", "n"])

    source = _source(docs, doc, text, group)
    counts = dict(source.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())  # as many as terms of queries
    n, length = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(len(asked.terms))
    for t, c in counts.items():
        df[t] = c
    average = length / n if n else 1.0
    weighted = spark.sparkContext.broadcast(_with_weights(asked, np.log(1 + (n - df + 0.5) / (df + 0.5))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def weigh(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            flat, owner = tokens_of(texts)
            dl = np.bincount(owner, minlength=len(texts))
            at = pc.fill_null(pc.index_in(flat, known), -1).to_numpy().astype(np.int64)
            keys, tf = np.unique(owner[at >= 0] * max(1, len(known)) + at[at >= 0], return_counts=True)
            row, term = keys // max(1, len(known)), keys % max(1, len(known))
            return row, term, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / average))

        yield from _hits(batches, weighted.value, k, group is not None, weigh)

    return retrieval.top_k(source.mapInArrow(score, HITS), "q", "doc", k)


def tfidf_terms(docs: DataFrame, doc: str, text: str, most: int | None = retrieval.MOST_TERMS, most_words: int = 2) -> DataFrame:
    """(term, df, idf) of the ``most`` frequent terms, ties in the order of the alphabet, or of all.

    Terms are counted within each batch of documents, so that only its different terms are shuffled.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, owner = runs_of(*tokens_of(batch.column(1)), most_words)
            coded = runs.dictionary_encode()
            size, at = max(1, len(coded.dictionary)), coded.indices.to_numpy().astype(np.int64)
            cf = np.bincount(at, minlength=len(coded.dictionary))
            df = np.bincount(np.unique(owner * size + at) % size, minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(df), pa.array(cf)], ["term", "df", "cf"])

    counted = _source(docs, doc, text, None).mapInArrow(count, "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    if most is not None:
        counted = counted.orderBy(F.desc("cf"), "term").limit(most)
    total = docs.agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def tfidf_topk(
    queries: DataFrame, docs: DataFrame, query: str, doc: str, text: str, k: int, most: int | None = retrieval.MOST_TERMS, most_words: int = 2
) -> DataFrame:
    """(q, doc, score, rank): the best k documents of each query by sparse cosine in the documents' vocabulary.

    The vocabulary is a sum over the corpus, up to ``MOST_TERMS`` terms are broadcast; then one scan.
    """
    spark = docs.sparkSession
    asked = _asked(queries, query, text, None, most_words) if most is not None and most <= retrieval.MOST_TERMS else None
    if asked is None:
        return retrieval.top_k(retrieval.tfidf(queries, docs, query, doc, text, most, most_words), "q", "doc", k)
    ship(spark)
    terms = tfidf_terms(docs, doc, text, most, most_words).select("term", "idf").toArrow()  # at most ``most``
    known, idf = terms.column("term").combine_chunks().cast(pa.large_string()), terms.column("idf").to_numpy()
    place = pc.fill_null(pc.index_in(pa.array(asked.terms, pa.large_string()), known), -1).to_numpy().astype(np.int64)
    asked = _with_weights(asked, np.where(place >= 0, idf[place], 0.0) if len(idf) else np.zeros(len(place)))
    norm = np.sqrt(np.bincount(asked.query_of, asked.weight**2, minlength=len(asked.ids)))
    asked.weight = asked.weight / np.where(norm > 0, norm, 1.0)[asked.query_of]
    column = np.full(len(idf), -1, np.int64)  # number of each known term among the queries' terms
    column[place[place >= 0]] = np.flatnonzero(place >= 0)
    shared = spark.sparkContext.broadcast((known, idf, column, asked))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, column, asked = shared.value

        def weigh(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            runs, owner = runs_of(*tokens_of(texts), most_words)
            at = pc.fill_null(pc.index_in(runs, known), -1).to_numpy().astype(np.int64)
            keys, tf = np.unique(owner[at >= 0] * max(1, len(idf)) + at[at >= 0], return_counts=True)
            row, term = keys // max(1, len(idf)), keys % max(1, len(idf))
            raw = tf * idf[term]
            z = np.sqrt(np.bincount(row, raw**2, minlength=len(texts)))
            asked_for = column[term] >= 0
            return row[asked_for], column[term[asked_for]], raw[asked_for] / z[row[asked_for]]

        yield from _hits(batches, asked, k, False, weigh)

    return retrieval.top_k(_source(docs, doc, text, None).mapInArrow(score, HITS), "q", "doc", k)


def dense_topk(queries: DataFrame, base: DataFrame, query: str, key: str, vec: str, k: int, block: int = SCAN_QUERIES) -> DataFrame:
    """(q, key, score, rank) by inner product, for a stated query set in blocks of ``block`` rows, never a row with itself.

    Each block is a matrix that is broadcast; every base row meets it in one product. Rows
    without vector, or with one of another length than the query's, have no product.
    """
    spark = base.sparkSession
    ship(spark)
    rows = queries.where(F.col(vec).isNotNull() & F.col(query).isNotNull()).select(F.col(query).cast("bigint").alias("q"), F.col(vec).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // block))
    source = base.where(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(vec).cast("array<double>").alias("v"))
    out = None
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow()  # about ``block`` rows
        lists = part.column("v").combine_chunks()
        ids, vectors = part.column("q").to_numpy(), [np.asarray(v, float) for v in lists.to_pylist()]
        shared = spark.sparkContext.broadcast((ids, vectors))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            sizes = np.array([len(v) for v in vectors])
            for batch in batches:
                size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for n in np.unique(sizes):
                    asked = np.flatnonzero(sizes == n)
                    fit = batch.filter(pa.array(size == n))
                    if not fit.num_rows:
                        continue
                    docs = fit.column(0).to_numpy()
                    scores = fit.column(1).flatten().to_numpy().reshape(-1, n) @ np.array([vectors[j] for j in asked]).T
                    q, r = best_of(scores, docs, docs[:, None] != ids[asked][None, :], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asked][q]), pa.array(docs[r]), pa.array(scores[r, q])], ["q", "doc", "score"])

        found = source.mapInArrow(score, HITS)
        out = found if out is None else out.unionByName(found)
    return retrieval.top_k(out.withColumnRenamed("doc", key), "q", key, k)


def topk(backend: str, queries: DataFrame, docs: DataFrame, query: str, doc: str, text: str, k: int) -> DataFrame:
    """Dispatch by name: tfidf (the default of an empty name), bm25 or dense (``text`` then names the vectors)."""
    by = {"tfidf": tfidf_topk, "": tfidf_topk, "bm25": bm25_topk, "dense": dense_topk}
    if backend.lower() not in by:
        raise ValueError(f"unknown retrieval backend {backend}")
    return by[backend.lower()](queries, docs, query, doc, text, k)


def for_each_k(hits: DataFrame, ks: list[int]) -> DataFrame:
    """(k, and the hits of rank k at most) for each positive k of a list, from one search of the greatest."""
    wanted = sorted({k for k in ks if k > 0})
    return hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in wanted]))).where(F.col("rank") <= F.col("k"))
