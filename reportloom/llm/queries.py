"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm import consensus, defects, encode, groupsplit, leak, overlap, pii, topn
from reportloom.llm.sql import ORACLE_SQL  # noqa: F401
from reportloom.session import Scratch, table


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return overlap.links(table(spark, d, "splits"), table(spark, d, "placeholders"), Scratch(spark, "p1"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(*_p1(spark, d))


def p1_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(*_p1(spark, d))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return overlap.memberships(*_p1(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(*_p1(spark, d))


def p2_linked(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.clusters(
        table(spark, d, "splits"), table(spark, d, "split_seed42"), table(spark, d, "trackers"),
        table(spark, d, "placeholders"), Scratch(spark, "p2"),
    )


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.assign(table(spark, d, "splits"), p2_linked(spark, d), table(spark, d, "split_seed42"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return p2_splits(spark, d).groupBy("split").agg(
        F.count("*").alias("records"), F.count_distinct("cluster_id").alias("clusters")
    )


def p3_topn(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(topn.latest_scored(table(spark, d, "candidates")), 3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_topn(spark, d).select("row_id", "candidate_index")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    sheet, pairs = table(spark, d, "annotation_sheet"), table(spark, d, "dpo_pairs")
    answers = sheet.select(
        F.lit("annotation_sheet").alias("origin"), F.col("sheet_id").alias("record_id"), F.col("input_text").alias("prompt"),
        F.col("gen_text").alias("answer"), F.col("generated_at").alias("at"),
    ).unionByName(
        pairs.select(
            F.lit("dpo_pairs").alias("origin"), F.col("pair_id").alias("record_id"), "prompt", F.col("rejected").alias("answer"),
            F.col("mined_at").alias("at"),
        )
    )
    languages = defects.all_languages(table(spark, d, "documents"))
    endings = defects.all_endings(pairs.select(F.col("chosen").alias("text")))
    return defects.find(answers, languages, endings)


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("origin", "defect").agg(F.count("*").alias("records"))


def _p5_votes(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "entity_level_annota")
    parts = [
        both.select(
            "entity_id", F.lit(who.upper()).alias("annotator"), F.col("labelled_at").alias("at"),
            F.col(f"annot{who}_extraction").alias("extraction"), F.col(f"annot{who}_attribution").alias("attribution"),
        )
        for who in "ab"
    ]
    for name in ("gpt", "gemini"):
        parts.append(
            table(spark, d, f"result_{name}_merged").select(
                "entity_id", F.lit(name).alias("annotator"), F.col("labelled_at").alias("at"), "extraction", "attribution"
            )
        )
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    return consensus.votes(entries)


def p5_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(consensus.fit(_p5_votes(spark, d), Scratch(spark, "p5")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_consensus(spark, d).where("consensus_label is not null").select("entity_id", "label_kind", "consensus_label")


def p5_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.annotators(consensus.fit(_p5_votes(spark, d), Scratch(spark, "p5")))


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(_p5_votes(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_documents(table(spark, d, "documents"))


def _p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leak.passages(table(spark, d, "documents"), table(spark, d, "test_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.found(_p7_spans(spark, d))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leak.cleaned(table(spark, d, "documents"), table(spark, d, "test_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents")).select("doc_id", "kind", "found_text").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_overlaps": p1_overlaps,
    "p1_members": p1_members,
    "p1_report": p1_report,
    "p2_found": p2_linked,
    "p2_splits": p2_splits,
    "p2_shares": p2_shares,
    "p3_found": p3_found,
    "p3_topn": p3_topn,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_consensus": p5_consensus,
    "p5_annotators": p5_annotators,
    "p5_agreement": p5_agreement,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_cleaned": p7_cleaned,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}
