"""Labels that rules give to extracted entities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportloom.functions.text import strip

#: Words that decide a label.
ABBREVIATIONS = ("e.g", "i.e", "etc.", "vs.", "fig.", "eq.", "ref.", "no.", "st.", "nd.", "rd.", "th.")
COLOUR_WORDS = ("color", "colour", "#", "rgb", "hex")
SETTING_WORDS = ("config", "setting", "enable", "disable", "preference", "pref", "flag", "option")
PREFERENCE_PATHS = (
    "browser.", "dom.", "network.", "layout.", "security.", "privacy.", "toolkit.", "devtools.", "media.", "gfx.", "ui.", "general.", "services.", "extensions.",
)
REVISION_WORDS = ("regress", "fix for", "introduced", "commit", "changeset")
BUILD_WORDS = ("build id", "build:", "buildid")
TRACKER_WORDS = ("bug", "issue", "ticket", "report")


def _any(x: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | x.contains(w)
    return hit


def _forms(surface: Column, context: Column) -> tuple[Column, Column, Column]:
    s = strip(F.coalesce(surface, F.lit("")))
    return s, F.lower(s), F.lower(F.coalesce(context, F.lit("")))


def _alphabetic(s: Column, joint: str) -> Column:
    """Whether all dotted parts are letters but for ``joint`` characters."""
    return s.rlike(rf"^[\p{{L}}{joint}]*\p{{L}}[\p{{L}}{joint}]*(?:\.[\p{{L}}{joint}]*\p{{L}}[\p{{L}}{joint}]*)+$")


def extraction_label(kind: Column, surface: Column, context: Column) -> Column:
    """TP or FP with its reason, by kind, surface and context; nulls count as empty."""
    s, low, ctx = _forms(surface, context)
    digits = s.rlike(r"^[0-9]*$")
    hashed = (
        F.when(s.rlike(r"(?i)^[a-f0-9]{6}$") & _any(ctx, COLOUR_WORDS), "FP:color_code")
        .when((F.length(s) <= 8) & (F.length(s) > 0) & digits, "FP:decimal_number")
        .when(digits, "TP:likely_bugid_or_revision")
        .when(F.length(s) >= 12, "TP:likely_commit_hash")
        .otherwise("TP:likely_short_hash")
    )
    short_start = F.lit(False)
    for a in ABBREVIATIONS:
        short_start = short_start | low.startswith(a)
    flag = (
        F.when(short_start, "FP:abbreviation")
        .when(s.rlike(r"^\d+\.\d+"), "FP:version_number")
        .when(s.rlike(r"^[^.]{0,2}\.[^.]{0,2}$"), "FP:too_short")
        .when(_any(low, SETTING_WORDS), "TP:likely_setting")
        .when(_alphabetic(s, "_"), "TP:likely_property")
        .otherwise("TP:dotted_name")
    )
    return F.when(kind == "HASH", hashed).when(kind == "FLAG", flag).otherwise("TP")


def refined_hash(surface: Column, context: Column) -> Column:
    """Label of a hash with its context: commits, attachments, issues, builds, revisions."""
    s, low, ctx = _forms(surface, context)
    n = F.length(s)
    after = lambda word: F.rlike(ctx, F.concat(F.lit(word + r"\s+\Q"), low, F.lit(r"\E")))
    stamp = (n == 14) & s.rlike(r"^\d+$") & F.substring(s, 1, 4).try_cast("int").between(2000, 2030) & F.substring(s, 5, 2).try_cast("int").between(1, 12)
    return (
        F.when(s.rlike("(?i)[a-f]"), F.when(n >= 12, "TP:commit_hash").when(n >= 7, "TP:short_hash").otherwise("FP:too_short_hex"))
        .when((s == "20100101") & ctx.contains("gecko"), "FP:gecko_epoch")
        .when(after("attachment"), "TP:attachment_id")
        .when(after("bug"), "TP:bug_id")
        .when(F.coalesce(stamp, F.lit(False)), "TP:build_id")
        .when(_any(ctx, REVISION_WORDS), "TP:revision_id")
        .when(_any(ctx, BUILD_WORDS), "TP:build_id")
        .when(n.between(5, 8) & _any(ctx, TRACKER_WORDS), "TP:bug_id")
        .when(n.between(7, 8) & _any(ctx, ("attachment", "screenshot")), "TP:attachment_id")
        .when(n < 7, "FP:ambiguous_number")
        .otherwise("TP:likely_identifier")
    )


def refined_flag(surface: Column, context: Column) -> Column:
    """Label of a dotted name with its context: abbreviations, versions, settings, name spaces."""
    s, low, ctx = _forms(surface, context)
    bare = F.regexp_replace(low, r"\.+$", "")
    return (
        F.when(bare.isin(*[a.rstrip(".") for a in ABBREVIATIONS]), "FP:abbreviation")
        .when(s.rlike(r"^\d+\.\d+"), "FP:version_number")
        .when(s.rlike(r"^[^.]{0,2}\.[^.]{0,2}$"), "FP:too_short")
        .when(_any(low, PREFERENCE_PATHS), "TP:mozilla_pref")
        .when(_any(low, SETTING_WORDS), "TP:setting")
        .when(_any(ctx, ("about:config", "preference")), "TP:likely_pref")
        .when(_alphabetic(F.regexp_replace(s, r"\.+", "."), "_\\-"), "TP:namespace")
        .otherwise("TP:dotted_name")
    )


def binary_extraction(raw: Column) -> Column:
    """TP for whatever begins with it, regardless of case and outer blanks; anything else, null included, is FP."""
    return F.when(F.upper(strip(F.coalesce(raw, F.lit("")))).startswith("TP"), "TP").otherwise("FP")


def plain_attribution(raw: Column) -> Column:
    """input, retrieval or unattributed, the first that the text contains; else NA."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low.contains("input"), "input").when(low.contains("retrieval"), "retrieval").when(low.contains("unattributed"), "unattributed").otherwise("NA")


#: Short names of where an entity comes from.
SHORT = {"input": "IAHE", "retrieval": "RAHE", "unattributed": "UAHE"}


def attribution_check(given: Column, in_input: Column, in_retrieval: Column, in_gen: Column) -> Column:
    """Whether a given attribution (long or short name) is right: NA, Y or N with its reason; a null flag is no."""
    yes = lambda c: F.coalesce(c == 1, F.lit(False))
    is_ = lambda name: F.coalesce(given.isin(name, SHORT[name]), F.lit(False))
    i, r = yes(in_input), yes(in_retrieval)
    expected = F.when(i, SHORT["input"]).when(r, SHORT["retrieval"]).otherwise(SHORT["unattributed"])
    return (
        F.when(~yes(in_gen), "NA:not_in_gen")
        .when(is_("input") & i, "Y:correct_input_attr")
        .when(is_("retrieval") & ~i & r, "Y:correct_retrieval_attr")
        .when(is_("unattributed") & ~i & ~r, "Y:correct_unattributed")
        .otherwise(F.concat(F.lit("N:mismatch_expected_"), expected))
    )


def attribution_label(in_input: Column, in_retrieval: Column) -> Column:
    """input before retrieval before unattributed."""
    return F.when(in_input == 1, "input").when(in_retrieval == 1, "retrieval").otherwise("unattributed")
