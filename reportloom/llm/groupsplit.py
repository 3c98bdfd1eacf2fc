"""Splits that keep related records together: connected components, then hashed ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.session import Scratch

#: What may stand between an issue's prefix and its number.
ISSUE_GAP = r"(?:\s+(?:issue|ticket|bug)|\.[\w.\-]+(?::\d+)?(?:/[\w\-]+)*/)?[\s\-_#:\[\]‐-―−]*"
#: Parts that a key is cut into at least, and all keys' rows for each part beyond.
KEY_SALTS, SALT_ROWS = 64, 1_000_000


def blank_free(value: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(value), r"(?U)\s+", "")


def handle_key(value: Column) -> Column:
    """An author handle without case, blanks, leading mark and mail domain."""
    return F.regexp_replace(F.regexp_replace(blank_free(value), r"^[@~]+", ""), r"@[^@]*$", "")


def issue_keys(text: Column, prefixes: Column) -> Column:
    """Distinct ``prefix-number`` of all issues named in ``text``, however written.

    ``prefixes`` is the alternation of the known prefixes. Numbers have five or more digits.
    """
    pattern = F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}])("), prefixes, F.lit(")" + ISSUE_GAP + r"(\d{5,})(?![\p{L}\p{N}])"))
    # the text is searched once, what was found is taken apart again
    part = lambda m, k: F.call_function("regexp_extract", m, pattern, F.lit(k))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.concat(F.lower(part(m, 1)), F.lit("-"), part(m, 2))))


def latest_rows(splits: DataFrame) -> DataFrame:
    """One row per ``row_id``, the one loaded last; rows without id are left out."""
    columns = [c for c in splits.columns if c != "row_id"]
    newest = F.max_by(F.struct(*columns), F.struct("loaded_at", F.xxhash64(*[c for c in columns])))
    return splits.where("row_id is not null").groupBy("row_id").agg(newest.alias("r")).select("row_id", "r.*")


def link_keys(splits: DataFrame, group_cols: list[str], trackers: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(row_id, key): everything by which a record can be linked to others.

    Keys are the values of ``group_cols`` and the issues named in ``text``. Null, blank and
    placeholder values give no key. ``trackers`` and ``placeholders`` are small fixed tables.
    A re-loaded row repeats its keys and so needs no separate treatment here.
    """
    nothing = placeholders.where(F.col("field_name").isin(group_cols)).select(
        "field_name", blank_free(F.col("placeholder")).alias("placeholder")
    )
    prefixes = trackers.where("prefix is not null").agg(
        F.array_join(F.sort_array(F.collect_set(F.upper("prefix"))), "|").alias("prefixes")
    )
    named = []
    for c in group_cols:
        key = handle_key(F.col(c)) if c == "author" else blank_free(F.col(c))
        named.append(F.struct(F.lit(c).alias("field"), blank_free(F.col(c)).alias("raw"), key.alias("value")))
    issues = F.when(F.coalesce(F.col("prefixes"), F.lit("")) != "", issue_keys(F.coalesce("text", F.lit("")), F.col("prefixes")))
    issue_structs = F.transform(
        F.coalesce(issues, F.array().cast("array<string>")),
        lambda x: F.struct(F.lit("issue").alias("field"), x.alias("raw"), x.alias("value")),
    )
    keys = (
        splits.where("row_id is not null")
        .crossJoin(F.broadcast(prefixes))  # one row
        .select("row_id", F.explode(F.concat(F.array(*named), issue_structs) if named else issue_structs).alias("k"))
        .select("row_id", "k.*")
        .where("value is not null and value <> ''")
    )
    # the placeholders are a fixed table of a few rows
    keys = keys.join(
        F.broadcast(nothing), (keys.field == nothing.field_name) & (keys.raw == nothing.placeholder), "left_anti"
    )
    return keys.select("row_id", F.concat_ws(":", "field", "value").alias("key")).distinct()


def star_edges(keys: DataFrame, salts: int = KEY_SALTS) -> DataFrame:
    """Edges (u, v), u > v, that connect the records of each key, as many as records.

    Each key is cut into ``salts`` parts; the records of a part point to its smallest, these
    point to the smallest of all. No task holds more than a part of a key.
    """
    salted = keys.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    part = Window.partitionBy("key", "_salt")
    local = salted.withColumn("low", F.min("row_id").over(part))
    tops = local.groupBy("key", "_salt").agg(F.min("row_id").alias("u"))
    tops = tops.withColumn("v", F.min("u").over(Window.partitionBy("key"))).select("u", "v")
    inner = local.select(F.col("row_id").alias("u"), F.col("low").alias("v"))
    return inner.unionByName(tops).where("u > v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_id, cluster_id) of every node of ``edges``; the cluster is its smallest node.

    Alternates large-star and small-star until the edges stay the same, which they do after at
    most about the square of the logarithm of the largest component's size. Each round's edges
    are written to the shared folder, the ones before are removed. Both stars reduce with
    a combining minimum; the join back to the edges of a hot node is split by AQE.
    """
    current, path = scratch.save(edges)
    before = None
    while True:
        following, next_path = scratch.save(_small_star(_large_star(current)))
        mark = following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(path)
        current, path = following, next_path
        if (mark.n, mark.h) == before:
            break
        before = (mark.n, mark.h)
    return current.select(F.col("u").alias("row_id"), F.col("v").alias("cluster_id")).unionByName(
        current.select(F.col("v").alias("row_id"), F.col("v").alias("cluster_id")).distinct()
    )


def clusters(splits: DataFrame, rules: DataFrame, trackers: DataFrame, placeholders: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_id, cluster_id) of every record linked to another one."""
    group_cols = [r.group_col for r in rules.select("group_col").distinct().orderBy("group_col").collect()]  # a few rows
    group_cols = [c for c in group_cols if c in splits.columns]
    keys, at = scratch.save(link_keys(splits, group_cols, trackers, placeholders))
    salts = max(KEY_SALTS, -(-keys.count() // SALT_ROWS))
    found = components(star_edges(keys, salts), scratch)
    scratch.drop(at)
    return found


def assign(splits: DataFrame, linked: DataFrame, rules: DataFrame) -> DataFrame:
    """(row_id, cluster_id, split): each cluster hashed into the shares of ``rules``.

    A record linked to none is its own cluster. The draw is the md5 of seed and cluster, so
    it is the same on every run. Shares are scaled to sum to one.
    """
    share = rules.agg(
        F.max("seed").alias("seed"), F.max("train_share").alias("a"), F.max("val_share").alias("b"), F.max("test_share").alias("c")
    )
    whole = splits.where("row_id is not null").select("row_id").distinct().join(linked, "row_id", "left")
    whole = whole.withColumn("cluster_id", F.coalesce("cluster_id", "row_id")).crossJoin(F.broadcast(share))  # one row
    key = F.concat_ws("|", F.coalesce("seed", F.lit(0)).cast("string"), F.col("cluster_id").cast("string"))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    total = reduce(lambda x, y: x + y, [F.coalesce(F.col(c), F.lit(0.0)) for c in "abc"])
    at = draw * total
    split = F.when(at < F.col("a"), "train").when(at < F.col("a") + F.col("b"), "val").otherwise("test")
    return whole.select("row_id", "cluster_id", split.alias("split"))
