"""Registered queries of the llm subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm import duplicates, entities, names, packing, pii, tokens
from tracefold.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.reference_copies(table(spark, d, "bib_refs"), table(spark, d, "venues"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.reference_records(table(spark, d, "bib_refs"), table(spark, d, "venues"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.matched_records(table(spark, d, "resolved_sources")).select("source_id_a", "source_id_b")


def p4_confidence(spark: SparkSession, d: str) -> DataFrame:
    return entities.matched_records(table(spark, d, "resolved_sources"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return entities.record_classes(table(spark, d, "resolved_sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "resolved_sources"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.name_clusters(table(spark, d, "resolved_sources"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p7_windows(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_mentions(table(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_text(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p4_found": p4_found,
    "p4_confidence": p4_confidence,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_ids": p6_ids,
    "p7_windows": p7_windows,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

SQL: dict[str, str] = {}
