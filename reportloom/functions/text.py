"""Column functions on text: cleaning, tokens, lines, names, excerpts, entities, masks, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of the four kinds of hard entities, regardless of case.
ENTITY_PATTERNS = {
    "URL": r"https?://\S+|www\.\S+",
    "HASH": r"\b[a-f0-9]{7,40}\b",
    "FILE": r"\b[\w\-.]+\.(?:gif|png|jpg|jpeg|webp|mp4|mov|avi|log|txt|csv|json|xml)\b",
    "FLAG": r"\b[a-zA-Z_]+\.[a-zA-Z0-9_.]+\b(?::(?:true|false))?",
}
KINDS = tuple(ENTITY_PATTERNS)
WORD = r"[\p{L}\p{N}_]+"


#: Spellings of the three splits.
SPLIT_NAMES = {"train": ("train", "training", "trn"), "val": ("val", "valid", "validation", "dev"), "test": ("test", "testing", "tst")}


def split_name(x: Column) -> Column:
    """train, val or test for any of its spellings, regardless of case and of all but letters; else null."""
    bare = F.regexp_replace(F.lower(x), "[^a-z]+", "")
    out = F.lit(None).cast("string")
    for name, spellings in SPLIT_NAMES.items():
        out = F.when(bare.isin(*spellings), name).otherwise(out)
    return out


def fold(pattern: str) -> str:
    """The pattern regardless of case, with Unicode classes."""
    return "(?iU)" + pattern


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_cell(x: Column) -> Column:
    """Stripped text; null and the words nan, none and null become empty."""
    t = strip(F.coalesce(x, F.lit("")))
    return F.when(F.lower(t).isin("nan", "none", "null"), F.lit("")).otherwise(t)


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, stripped."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def text_key(x: Column) -> Column:
    """Group key of a text: the full SHA-1 of its squeezed form."""
    return F.sha1(squeeze(x).cast("binary"))


def short_key(x: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, n)


def safe_name(x: Column) -> Column:
    """A file-name part: other characters as single underscores, trimmed, ``none`` if nothing is left."""
    t = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, r"_+", "_"), r"^_+|_+$", "")
    return F.when(t == "", F.lit("none")).otherwise(t)


def joined_names(*parts: Column) -> Column:
    """Safe names of the non-empty parts, joined by double underscores."""
    return F.array_join(F.transform(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != ""), safe_name), "__")


def condition_key(*parts: Column) -> Column:
    """All parts as text joined by a bar; a null part is empty but keeps its place."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def last_part(x: Column) -> Column:
    return F.substring_index(x, "|", -1)


def before_last(x: Column) -> Column:
    """What stands before the last bar; empty if there is none."""
    n = F.length(x) - F.length(last_part(x)) - 1
    return F.when(n > 0, F.substring(x, F.lit(1), n)).otherwise(F.lit(""))


def excerpt(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def window_around(text: Column, needle: Column, margin: int = 80) -> Column:
    """The surroundings of the first occurrence, with dots where the text was cut; null if absent."""
    at = F.instr(text, needle)
    lo = F.greatest(F.lit(1), at - margin)
    hi = F.least(F.length(text), at + F.length(needle) - 1 + margin)
    cut = F.concat(
        F.when(lo > 1, "...").otherwise(""), F.substring(text, lo, hi - lo + 1), F.when(hi < F.length(text), "...").otherwise("")
    )
    return F.when(at > 0, cut)


def tokens(x: Column) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def word_count(x: Column) -> Column:
    """Pieces between white space."""
    return F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


def lines(x: Column) -> Column:
    """The lines without an empty one after the last line end."""
    parts = F.split(x, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))).otherwise(parts)


def step_count(x: Column) -> Column:
    """Lines that begin with ``1.``, ``1)``, ``-`` or ``*`` and a blank."""
    return F.size(F.filter(lines(x), lambda line: strip(line).rlike(r"(?U)^(?:\d+[.)]|[-*])\s")))


def all_matches(x: Column, kind: str) -> Column:
    return F.regexp_extract_all(x, F.lit(fold(ENTITY_PATTERNS[kind])), F.lit(0))


def entities(x: Column, kind: str, any_case: bool = False) -> Column:
    """Distinct surfaces of a kind. Flags that are file surfaces are left out, on request regardless of case."""
    found = F.array_distinct(all_matches(x, kind))
    if kind != "FLAG":
        return found
    files = all_matches(x, "FILE")
    if not any_case:
        return F.array_except(found, files)
    low = F.transform(files, F.lower)
    return F.filter(found, lambda f: ~F.array_contains(low, F.lower(f)))


def attribution(out: Column, given: Column, retrieved: Column) -> Column:
    """How many of the output's entities stem from the input, else from retrieval, else from nowhere."""
    rest = F.array_except(out, given)
    return F.struct(
        F.size(F.array_intersect(out, given)).alias("input"), F.size(F.array_intersect(rest, retrieved)).alias("retrieval"),
        F.size(F.array_except(rest, retrieved)).alias("unattributed"),
    )


def ratio(x: Column, d: Column) -> Column:
    """x over d, where d counts as one at least."""
    return x / F.greatest(F.lit(1.0), d)


def masked(x: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Entities replaced by their kind in angle brackets, in the order of ``kinds``."""
    for k in kinds:
        x = F.regexp_replace(x, fold(ENTITY_PATTERNS[k]), f"<{k}>")
    return x


def similarity_form(x: Column) -> Column:
    """The text as it is compared: all entities but flags masked."""
    return masked(x, ("URL", "HASH", "FILE"))


def truncated(toks: Column, most: int, mode: str) -> Column:
    """At most ``most`` tokens from the head, the tail, or half of either."""
    n = F.size(toks)
    if mode == "head":
        cut = F.slice(toks, 1, most)
    elif mode == "tail":
        cut = F.slice(toks, F.greatest(F.lit(1), n - most + 1), F.lit(most))
    else:
        head = most // 2
        tail = most - head
        cut = F.concat(F.slice(toks, 1, head), F.slice(toks, F.greatest(F.lit(1), n - tail + 1), F.lit(tail)))
    return F.when(n <= most, toks).otherwise(cut)


#: The headings of a prompt's blocks.
EXAMPLE_INPUT, EXAMPLE_OUTPUT = "### Example Input:\n", "\n\n### Example Bug Report:\n"
INPUT, RESPONSE = "### Input:\n", "\n\n### Response:\n"


def prompt(system: Column, examples: Column, given: Column) -> Column:
    """System text, example blocks (structs of given and made) and the input block, all stripped, with blank lines between."""
    block = lambda e: F.concat(F.lit(EXAMPLE_INPUT), strip(e["given"]), F.lit(EXAMPLE_OUTPUT), strip(e["made"]), F.lit("\n"))
    last = F.concat(F.lit(INPUT), strip(given), F.lit(RESPONSE))
    return F.array_join(F.concat(F.array(strip(system)), F.transform(examples, block), F.array(last)), "\n\n")


def fitting_examples(sizes: Column, room: Column) -> Column:
    """How many leading examples fit into ``room`` tokens."""
    sums = F.transform(F.sequence(F.lit(0), F.size(sizes)), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    return F.array_max(F.transform(F.filter(F.sequence(F.lit(0), F.size(sizes)), lambda k: (k == 0) | (sums[k] <= room)), lambda k: k))


def spans(x: Column, kind: str) -> Column:
    """Array of (surface, start, end) of all matches; places come from the lengths of what lies between them."""
    pattern = fold(ENTITY_PATTERNS[kind])
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    gaps = F.split(x, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.greatest(F.lit(1), F.size(found))), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<surface:string,start:int,end:int>>").alias("out"))
    walked = F.aggregate(
        F.arrays_zip(found.alias("f"), sizes.alias("z")), start,
        lambda acc, e: F.struct(
            (acc["at"] + e["z"]["g"] + e["z"]["m"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct(e["f"].alias("surface"), (acc["at"] + e["z"]["g"]).alias("start"), (acc["at"] + e["z"]["g"] + e["z"]["m"]).alias("end"))),
            ).alias("out"),
        ),
    )
    return F.when(F.size(found) > 0, walked["out"]).otherwise(start["out"])
