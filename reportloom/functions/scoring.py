"""Column functions that score texts: word overlap, vector cosine, quality indicators, preference score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.text import word_count

#: Words that the quality indicators look for, with their points.
ENVIRONMENT_WORDS = ("android", "ios", "chrome", "firefox", "windows", "macos")
SCREENSHOT_WORDS = ("screenshot", "attached image", "see attachment")
GUIDELINE_WORDS = ("please see", "as shown in the image", "attachment")
#: The list shipped with the indicators, and the one that stands in where no list is given.
SYSTEM_DEFECT_WORDS = tuple(
    """blocked broke broken crash critical defeats defect defective degrades delayed destroy dirty discarded emergency empty error
    excluded exhaustive failed failure fatal fault faulty forbidden freezes freezing ignore ignored ignoring ineffectiveness insecure
    interrupted interruption isolated lack lag lagging lags leak loss lost missing mistake mistakes negative no obsolete obstacle overload
    panic panicked poison poisoned postponed problem problematic problems rejected rejection risk stop stopped stuck suspended trivial
    trouble unstable unsupported violation vulnerability vulnerable warning weakness weaknesses wrong""".split()
)
DEFECT_WORDS = ("crash", "down", "flashback", "overlap", "too big", "too small", "freeze")
DIRECT_VERBS = ("login", "register", "logout")
QUALITY_DIVISOR = 16.0


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two vectors of norm one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def common_tokens(a: Column, b: Column) -> Column:
    """Tokens that two lists share, counted with repetition.

    Of most shared tokens one side has a single occurrence; only the rest is counted, token by token.
    """
    both = F.array_intersect(a, b)
    again = lambda xs: F.size(xs) - F.size(F.array_distinct(xs))
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    whole = F.aggregate(both, F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))
    return F.when((again(a) == 0) | (again(b) == 0), F.size(both)).otherwise(whole)


def rouge1_rows(rows: DataFrame, key: str, reference: str, made: str) -> DataFrame:
    """(key, rouge1_r, rouge1_f1) of the token lists of each row, in time linear in their lengths.

    The rows are spread by key once; tokens are counted where they lie. Empty or null lists score zero.
    """
    rows = rows.select(key, F.coalesce(reference, F.array().cast("array<string>")).alias("a"), F.coalesce(made, F.array().cast("array<string>")).alias("b"))
    spread = rows.repartition(key)
    end = F.lit(None).cast("string")  # keeps rows without tokens
    sides = F.concat(
        F.transform("a", lambda w: F.struct(w.alias("w"), F.lit(1).alias("x"), F.lit(0).alias("y"))), F.transform("b", lambda w: F.struct(w.alias("w"), F.lit(0).alias("x"), F.lit(1).alias("y"))),
        F.array(F.struct(end.alias("w"), F.lit(0).alias("x"), F.lit(0).alias("y"))),
    )
    each = spread.select(key, F.explode(sides).alias("t")).groupBy(key, "t.w").agg(F.sum("t.x").alias("x"), F.sum("t.y").alias("y"))
    per = each.groupBy(key).agg(F.sum(F.least("x", "y")).cast("double").alias("hit"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    recall = F.when(F.col("nx") > 0, F.col("hit") / F.col("nx")).otherwise(0.0)
    precision = F.when(F.col("ny") > 0, F.col("hit") / F.col("ny")).otherwise(0.0)
    return per.select(key, recall.alias("rouge1_r"), F.when(F.col("hit") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("rouge1_f1"))


def rouge1(reference: Column, made: Column) -> dict[str, Column]:
    """Recall and F1 of single tokens, without stemming; empty lists score zero."""
    hit = common_tokens(reference, made).cast("double")
    recall = F.when(F.size(reference) > 0, hit / F.size(reference)).otherwise(0.0)
    precision = F.when(F.size(made) > 0, hit / F.size(made)).otherwise(0.0)
    return {"rouge1_r": recall, "rouge1_f1": F.when(hit > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)}


def names_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit


def syllables(words: Column) -> Column:
    """Vowel groups of all words, one at least for each."""
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.lower(w), F.lit("[aeiouy]+"), F.lit(0)))))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease with vowel-group syllables and sentences ended by ``.!?``; null without words."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    n = F.size(words)
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: s.rlike("[A-Za-z]"))))
    return F.when(n > 0, 206.835 - 1.015 * n / sentences - 84.6 * syllables(words) / n)


def mean_sentence_length(text: Column) -> Column:
    pieces = F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != "")
    return F.when(F.size(pieces) > 0, word_count(text) / F.size(pieces))


def quality_indicators(text: Column, defects: tuple[str, ...] = SYSTEM_DEFECT_WORDS, verbs: tuple[str, ...] = DIRECT_VERBS) -> dict[str, Column]:
    """Points of the indicators that need no parser. A sentence piece with a line break fails RM3.

    ``defects`` and ``verbs`` are word lists; empty ones fall back to the short lists.
    """
    defects, verbs = defects or DEFECT_WORDS, verbs or DIRECT_VERBS
    points = lambda c, p=1: F.when(F.coalesce(c, F.lit(False)), p).otherwise(0)
    pieces = F.filter(F.transform(F.split(F.trim(text), r"[.!?]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    return {
        "rm1": points(word_count(text).between(50, 300)),
        "rm2": points(reading_ease(text).between(30, 100)),
        "rm3": points(F.forall(pieces, lambda s: ~s.contains("\n"))),
        "rm4": points(mean_sentence_length(text).between(5, 40)),
        "rr1": points(text.rlike(r"(?m)^(?:\d+\)|-|\*)")),
        "rr2": points(text.rlike(r"(?m)^[-*]")),
        "rr3": points(names_any(text, ENVIRONMENT_WORDS), 2),
        "rr4": points(names_any(text, SCREENSHOT_WORDS)),
        "rr5": points(names_any(text, GUIDELINE_WORDS)),
        "ra2": points(names_any(text, verbs), 2),
        "ra3": points(names_any(text, defects), 2),
    }


def preference_score(profile: str | Column, version: str, m: dict[str, Column]) -> Column:
    """Preference score of a candidate in [0, 1].

    ``m`` has cond, pres, sig, nosig, filled, placeholder, unknown, dup, tokens, ua and iu
    (the last two as rates per thousand tokens). Any profile but structure and hard is balanced.
    """
    profile = F.lit(profile) if isinstance(profile, str) else F.coalesce(profile, F.lit("balanced"))
    by = lambda structure, hard, other: F.when(profile == "structure", structure).when(profile == "hard", hard).otherwise(other)
    t = F.greatest(F.lit(1.0), m["tokens"].cast("double"))
    length = F.when(t < 200, (200 - t) / 2000).when(t > 1200, (t - 1200) / 4000).otherwise(0.0)
    dup = F.least(F.lit(0.2), 0.03 * m["dup"])
    if version == "v2":
        gain = by(F.lit(0.65), F.lit(0.45), F.lit(0.55)) * m["cond"] + 0.10 * m["pres"] + 0.10 * m["sig"] + 0.05 * m["nosig"]
        loss = 0.08 * m["placeholder"] + 0.06 * m["unknown"]
    else:
        gain = by(F.lit(0.55), F.lit(0.35), F.lit(0.45)) * m["filled"] + by(F.lit(0.25), F.lit(0.15), F.lit(0.20)) * m["pres"]
        loss = 0.10 * m["placeholder"] + 0.08 * m["unknown"]
    entity = by(
        F.least(F.lit(0.25), 0.03 * m["ua"]),
        F.least(F.lit(0.60), 0.06 * m["ua"]) + F.least(F.lit(0.25), 0.02 * (m["iu"] - m["ua"])),
        F.least(F.lit(0.45), 0.045 * m["ua"]),
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), gain - loss - 0.10 * dup - 0.05 * length - entity))
