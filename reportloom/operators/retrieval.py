"""Retrieval: BM25, TF-IDF and dense top-k as joins, exclusion, random control, dereferencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.scoring import cosine
from reportloom.functions.text import tokens
from reportloom.session import Scratch

#: Bytes of query vectors that one broadcast block may hold.
BLOCK_ROWS = 2000
#: Fixed value: terms in the vocabulary of TF-IDF, few enough to broadcast.
MOST_TERMS = 200_000


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, dl, term, tf): tokens of each document, tokenised once; null texts have none."""
    return (
        docs.select(F.col(doc).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        .select("doc", F.size("t").alias("dl"), F.explode("t").alias("term"))
        .groupBy("doc", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def bm25_index(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, term statistics (term, df, idf) and corpus statistics (n, avgdl; one row)."""
    post = postings(docs, doc, text)
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    terms = df.crossJoin(F.broadcast(size.select("n"))).select(  # one row
        "term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    return post, terms, size


def bm25(queries: DataFrame, docs: DataFrame, query: str, doc: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(q, doc, score) of every document that shares a term with a query. Postings meet the query terms only."""
    post, terms, size = bm25_index(docs, doc, text)
    asked = postings(queries, query, text).select(F.col("doc").alias("q"), "term", F.col("tf").alias("qtf"))
    met = asked.join(terms, "term").join(post, "term").crossJoin(F.broadcast(size))  # one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("q", "doc").agg(F.sum(part).alias("score"))


def grams(docs: DataFrame, doc: str, text: str, most_words: int = 2) -> DataFrame:
    """(doc, term, tf): runs of one to ``most_words`` words of each document, joined by blanks; null texts have none."""
    rows = docs.select(F.col(doc).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    runs = [F.col("t")]
    for k in range(2, most_words + 1):  # the lists side by side; a captured list would be made anew for each word
        both = F.zip_with(runs[-1], F.slice("t", k, F.greatest(F.size("t"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(F.filter(both, lambda x: x.isNotNull()))
    return rows.select("doc", F.explode(F.concat(*runs)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def tfidf_terms(docs: DataFrame, doc: str, text: str, most: int | None = MOST_TERMS, most_words: int = 2) -> DataFrame:
    """(term, df, idf) of the ``most`` frequent terms, ties in the order of the alphabet, or of all."""
    total = docs.agg(F.count("*").alias("n"))
    per = grams(docs, doc, text, most_words).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if most is not None:
        per = per.orderBy(F.desc("cf"), "term").limit(most)
    return per.crossJoin(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def tfidf(queries: DataFrame, docs: DataFrame, query: str, doc: str, text: str, most: int | None = MOST_TERMS, most_words: int = 2) -> DataFrame:
    """(q, doc, score): sparse cosine of queries and documents in the documents' vocabulary.

    The vocabulary is made once; up to ``MOST_TERMS`` terms it is broadcast. Of the documents' terms only
    those that some query has are shuffled, and a sum of squares for each document.
    """
    terms = Scratch(docs.sparkSession, "terms").keep(tfidf_terms(docs, doc, text, most, most_words).select("term", "idf"))
    weighed = lambda g, v: g.join(F.broadcast(v) if most is not None and most <= MOST_TERMS else v, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norms = lambda g: g.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("z"))
    asked, given = grams(queries, query, text, most_words), grams(docs, doc, text, most_words)
    left = weighed(asked, terms)
    left = left.join(norms(left), "doc").select(F.col("doc").alias("q"), "term", (F.col("raw") / F.col("z")).alias("wq"))
    met = weighed(given, terms.join(asked.select("term").distinct(), "term", "left_semi"))
    dots = left.join(met.select("doc", "term", "raw"), "term").groupBy("q", "doc").agg(F.sum(F.col("wq") * F.col("raw")).alias("dot"))
    return dots.join(norms(weighed(given, terms)), "doc").select("q", "doc", (F.col("dot") / F.col("z")).alias("score"))


def dense_topk(queries: DataFrame, base: DataFrame, query: str, key: str, vec: str, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """(q, key, score, rank) by inner product, for a stated query set in blocks of ``block`` rows.

    Each block is small enough to broadcast; every base row meets it once, and each task
    keeps its best k of every query before anything is shuffled.
    """
    number = queries.agg(F.count("*").alias("n")).first().n
    blocks = max(1, -(-number // block))
    out = None
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == i).select(F.col(query).alias("q"), F.col(vec).alias("_vq"))
        scored = base.select(F.col(key), F.col(vec)).join(F.broadcast(part), F.col("q") != F.col(key))
        scored = scored.select("q", key, cosine(F.col("_vq"), F.col(vec)).alias("score"))
        best = top_k(scored, "q", key, k)
        out = best if out is None else out.unionByName(best)
    return out


def top_k(scores: DataFrame, query: str, doc: str, k: int, digits: int = 6) -> DataFrame:
    """The k best documents of each query by the rounded score, ties to the smaller document."""
    order = Window.partitionBy(query).orderBy(F.round("score", digits).desc(), F.col(doc))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def without_own(scores: DataFrame, groups: DataFrame, query: str = "q", doc: str = "doc") -> DataFrame:
    """Leave out the query itself and documents of its group; ``groups`` has id and group_id, null bans nothing."""
    gq = groups.select(F.col("id").alias(query), F.col("group_id").alias("_gq"))
    gd = groups.select(F.col("id").alias(doc), F.col("group_id").alias("_gd"))
    met = scores.where(F.col(query) != F.col(doc)).join(gq, query, "left").join(gd, doc, "left")
    return met.where(F.col("_gq").isNull() | F.col("_gd").isNull() | (F.col("_gq") != F.col("_gd"))).drop("_gq", "_gd")


def draw(*parts: Column) -> Column:
    """A uniform 32-bit number from the md5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("bigint")


def random_k(queries: DataFrame, groups: DataFrame, k: int, seed: int, tries: int = 4) -> DataFrame:
    """(q, doc, rank): k documents of other groups for each query, or all there are, by hash.

    Each query has a place on a hash ring and takes the documents whose own places follow next.
    A group that holds more than half of the documents (one at most) gets a ring without them, so
    that at least about half of what any query meets counts.
    """
    top = groups.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1).collect()
    total = groups.count()
    if not top or 2 * top[0].n <= total:
        return _next_k(queries, groups, total, k, seed, tries)
    own = F.col("group_id").eqNullSafe(F.lit(top[0].group_id))
    rest = _next_k(queries.where(~own), groups, total, k, seed, tries)
    return rest.unionByName(_next_k(queries.where(own), groups.where(~own), total - top[0].n, k, seed, tries))


def _next_k(queries: DataFrame, groups: DataFrame, total: int, k: int, seed: int, tries: int) -> DataFrame:
    """(q, doc, rank): the next k documents of other groups on the ring.

    The first round searches a span that holds ``tries * k`` documents on average; each further one twice
    the span for the queries still short of k, until none is or the span is the whole ring.
    """
    scratch, whole = Scratch(queries.sparkSession, "random"), 1 << 32
    ring = groups.select(F.col("id").alias("doc"), F.col("group_id").alias("_gd"), draw(F.lit(seed), F.col("id")).alias("at"))
    left = queries.where("id is not null").select(F.col("id").alias("q"), F.col("group_id").alias("_gq"), draw(F.lit(seed + 1), F.col("id")).alias("p"))
    span = min(whole, max(1, whole * tries * k // max(1, total)))
    order = Window.partitionBy("q").orderBy("away", "doc")
    out = None
    while True:
        # the span's first cell, the next and that of its end, which differs where the last cell is narrow
        first, cells = F.floor(F.col("p") / span), -(-whole // span)
        touched = F.array_distinct(F.array(first, F.pmod(first + 1, F.lit(cells)), F.floor(F.pmod(F.col("p") + span, F.lit(whole)) / span)))
        met = left.withColumn("cell", F.explode(touched)).join(ring.withColumn("cell", F.floor(F.col("at") / span)), "cell")
        met = met.withColumn("away", F.pmod(F.col("at") - F.col("p"), F.lit(whole))).where(F.col("away") < span)
        fine = met.where((F.col("q") != F.col("doc")) & (F.col("_gq").isNull() | F.col("_gd").isNull() | (F.col("_gq") != F.col("_gd"))))
        found = scratch.keep(fine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "doc", "rank"))
        if span < whole:
            left = scratch.keep(left.join(found.where(F.col("rank") == k).select("q"), "q", "left_anti"))
            more = not left.isEmpty()
            found = found.join(left.select("q"), "q", "left_anti") if more else found
        else:
            more = False
        out = found if out is None else out.unionByName(found)
        if not more:
            return out
        span = min(whole, 2 * span)


def exemplars(hits: DataFrame, docs: DataFrame, doc: str, columns: list[str], query: str = "q") -> DataFrame:
    """(q, examples): the named columns of each query's documents in order of rank; hits without document are dropped."""
    rows = hits.join(docs.select(F.col(doc).alias("doc"), *columns), "doc")
    packed = F.array_sort(F.collect_list(F.struct("rank", *columns)))  # at most k for each query
    return rows.groupBy(query).agg(F.transform(packed, lambda e: F.struct(*[e[c].alias(c) for c in columns])).alias("examples"))
