"""Sections of structured reports: headings, fill states, signals and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.text import lines, step_count, strip, word_count

#: A heading is ``**name**: rest`` or ``[name]: rest`` on a stripped line.
BOLD, BRACKET = r"(?U)^\*\*(.+?)\*\*\s*:?\s*(.*)$", r"(?U)^\[(.+?)\]\s*:?\s*(.*)$"
#: What tells that an input names steps, an expectation, an observation or an environment.
SIGNALS = {
    "steps": r"\b(?:steps?|repro|reproduce)\b|\d+\.\s",
    "expected": r"\bexpected\b|should\b|supposed to\b",
    "actual": r"\bactual\b|instead\b|but\b|error\b|exception\b|crash\b|fails?\b",
    "environment": r"\b(?:os|windows|linux|ubuntu|macos|android|ios|version|v\d+(?:\.\d+)+|build|device|browser|chrome|firefox|safari)\b",
}
#: Sections of which repetitions count.
COUNTED = ("steps", "expected", "actual", "environment", "env_versions", "env_platforms", "regression", "notes", "evidence")
LEAST_WORDS = 5
ENVIRONMENT = ("env_versions", "env_platforms", "environment")


def canonical(name: Column) -> Column:
    """The section that a heading names; the first rule that holds decides."""
    low = F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))
    has = low.contains
    return (
        F.when(has("step") & (has("reproduce") | has("repro")), "steps")
        .when(has("expected"), "expected")
        .when(has("actual"), "actual")
        .when(has("affected version") | low.isin("version", "versions"), "env_versions")
        .when(has("platform") | (low == "os"), "env_platforms")
        .when(has("environment"), "environment")
        .when(has("regression"), "regression")
        .when(has("note") | has("additional"), "notes")
        .when(has("evidence") | has("attachment") | has("log"), "evidence")
        .when(has("summary"), "summary")
        .otherwise(low)
    )


def with_sections(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: an array of (name, body) in order of appearance; a repeated heading gives another entry.

    Lines before the first heading belong to none. Works inside each row without a shuffle,
    in steps that each take their input from a column, so that nothing is computed twice.
    """
    raw = rows.withColumn("_raw", lines(F.coalesce(F.col(text), F.lit(""))))
    raw = raw.withColumn("_line", F.transform("_raw", lambda x: F.when(strip(x).rlike(r"^(?:\*\*.+\*\*|\[.+\])"), strip(x)).otherwise(F.lit(""))))
    head = lambda x, n: F.when(x.rlike(BOLD), F.regexp_extract(x, BOLD, n)).when(x.rlike(BRACKET), F.regexp_extract(x, BRACKET, n))
    starts = F.filter(F.transform("_line", lambda x, i: F.when(x.rlike(BOLD) | x.rlike(BRACKET), i + 1)), lambda i: i.isNotNull())
    found = raw.withColumn("_from", starts)
    found = found.withColumn("_to", F.concat(F.slice("_from", 2, F.greatest(F.lit(1), F.size("_from"))), F.array(F.size("_raw") + 1)))
    whole = F.zip_with(
        "_from", "_to",
        lambda a, b: F.struct(
            F.col("_line")[a - 1].alias("line"), F.array_join(F.slice(F.col("_raw"), a + 1, b - a - 1), "\n").alias("more")
        ),
    )
    found = found.withColumn("_whole", F.when(F.size("_from") > 0, whole).otherwise(F.slice(whole, 1, 0)))
    parts = F.transform(
        "_whole",
        lambda s: F.struct(
            canonical(head(s["line"], 1)).alias("name"), strip(F.concat(head(s["line"], 2), F.lit("\n"), s["more"])).alias("body")
        ),
    )
    return found.withColumn(out, parts).drop("_raw", "_line", "_from", "_to", "_whole")


def body(parts: Column, name: str) -> Column:
    """The first body of a section; null if it is missing."""
    found = F.filter(parts, lambda s: s["name"] == name)
    return F.when(F.size(found) > 0, found[0]["body"])


def is_placeholder(x: Column) -> Column:
    """Empty, or holds a mask in angle brackets, tbd, todo, n/a or na, or is only dots."""
    t = strip(F.coalesce(x, F.lit("")))
    return (t == "") | t.rlike(r"<[^>]{1,100}>") | t.rlike(r"(?iU)\b(?:tbd|todo|n/a|na)\b") | t.rlike(r"(?U)^[.\s]+$")


def is_unknown(x: Column) -> Column:
    """Empty, or says that nothing was provided."""
    t = strip(F.coalesce(x, F.lit("")))
    return (t == "") | t.rlike(r"(?iU)\b(?:not provided|unknown|unspecified|not available)\b")


def _some_words(x: Column, least: int = LEAST_WORDS) -> Column:
    return word_count(F.coalesce(x, F.lit(""))) >= least


def _environment(parts: Column) -> tuple[Column, Column, Column, Column]:
    """Whether any environment section is there, and whether they are all unknown, all placeholders, any filled."""
    env = [body(parts, k) for k in ENVIRONMENT]
    present = env[0].isNotNull() | env[1].isNotNull() | env[2].isNotNull()
    every = lambda test: (env[0].isNull() | test(env[0])) & (env[1].isNull() | test(env[1])) & (env[2].isNull() | test(env[2]))
    fine = lambda e: e.isNotNull() & ~is_placeholder(e) & ~is_unknown(e) & (_some_words(e, 2) | F.coalesce(e, F.lit("")).rlike(r"\d"))
    return present, every(is_unknown), every(is_placeholder), fine(env[0]) | fine(env[1]) | fine(env[2])


def section_metrics(text: Column, parts: Column) -> dict[str, Column]:
    """Presence, fill and rates over steps, expected, actual and environment (denominator four).

    A missing section counts as placeholder and as unknown.
    """
    steps, expected, actual = (body(parts, k) for k in ("steps", "expected", "actual"))
    env_present, env_unknown, env_placeholder, env_filled = _environment(parts)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    filled = {
        "steps": steps.isNotNull() & (step_count(F.coalesce(steps, F.lit(""))) >= 2),
        "expected": expected.isNotNull() & ~is_placeholder(expected) & _some_words(expected),
        "actual": actual.isNotNull() & ~is_placeholder(actual) & _some_words(actual),
        "environment": env_filled,
    }
    names = F.filter(F.transform(parts, lambda s: s["name"]), lambda n: n.isin(*COUNTED))
    return {
        "sec_presence": (one(steps.isNotNull()) + one(expected.isNotNull()) + one(actual.isNotNull()) + one(env_present)) / 4,
        "sec_filled": sum((one(filled[k]) for k in ("expected", "actual", "environment")), one(filled["steps"])) / 4,
        "placeholder_rate": (one(is_placeholder(steps)) + one(is_placeholder(expected)) + one(is_placeholder(actual)) + one(env_placeholder)) / 4,
        "unknown_rate": (one(is_unknown(steps)) + one(is_unknown(expected)) + one(is_unknown(actual)) + one(env_unknown)) / 4,
        "dup_sections": (F.size(names) - F.size(F.array_distinct(names))).cast("double"),
        "word_count": word_count(F.coalesce(text, F.lit(""))).cast("double"),
        "steps_count": step_count(F.coalesce(steps, F.lit(""))).cast("double"),
    }


def signals(text: Column) -> dict[str, Column]:
    """1.0 where the input gives the signal, else 0.0."""
    t = F.coalesce(text, F.lit(""))
    return {k: t.rlike("(?iU)" + p).cast("double") for k, p in SIGNALS.items()}


def alignment(given: dict[str, Column], parts: Column) -> dict[str, Column]:
    """How well the sections follow the input's signals.

    Sections with a signal should be filled, those without should be left unknown or as a
    placeholder; the rates weigh 0.7 to 0.3, and a side without sections leaves its weight
    to the other.
    """
    sound = lambda x: x.isNotNull() & ~is_placeholder(x) & ~is_unknown(x)
    one_of = {k: body(parts, k) for k in ("steps", "expected", "actual")}
    _, env_unknown, env_placeholder, env_filled = _environment(parts)
    filled = {k: sound(x) & (step_count(F.coalesce(x, F.lit(""))) >= 2 if k == "steps" else _some_words(x)) for k, x in one_of.items()}
    left = {k: is_unknown(x) | is_placeholder(x) for k, x in one_of.items()}
    filled["environment"], left["environment"] = env_filled, env_unknown | env_placeholder
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    total = lambda parts_: sum(parts_[1:], parts_[0])
    n_with = total([given[k] for k in SIGNALS])
    n_without = F.lit(4.0) - n_with
    with_rate = F.when(n_with > 0, total([given[k] * flag(filled[k]) for k in SIGNALS]) / n_with).otherwise(1.0)
    without_rate = F.when(n_without > 0, total([(1 - given[k]) * flag(left[k]) for k in SIGNALS]) / n_without).otherwise(1.0)
    cond = F.when(n_with == 0, without_rate).when(n_without == 0, with_rate).otherwise(0.7 * with_rate + 0.3 * without_rate)
    return {
        "signal_count": n_with, "nosignal_count": n_without, "signal_filled": with_rate, "nosignal_filled": without_rate, "cond_filled": cond,
    }
