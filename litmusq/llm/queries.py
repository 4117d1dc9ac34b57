"""Queries of the training-data operators for texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litmusq.llm import bpe, cross_split, leakage, near_duplicates, pair_defects, sentences, truncation
from litmusq.llm.oracle import SQL  # noqa: F401
from litmusq.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split.found_pairs(cross_split.cross_split_overlaps(table(spark, folder, "adversarial_pairs")))


def p1_by_split_source(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "adversarial_pairs")
    return cross_split.overlap_report(pairs, cross_split.cross_split_overlaps(pairs))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "adversarial_pairs"))


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_links(table(spark, folder, "adversarial_pairs"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_values(table(spark, folder, "stage_results"))


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(table(spark, folder, "stage_results"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.found_defects(table(spark, folder, "adversarial_pairs"))


def p6_triggered(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.defect_report(table(spark, folder, "adversarial_pairs"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p8_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(p8_found(spark, folder), table(spark, folder, "eval_items", "item_id", "split", "suite"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents", "doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_by_split_source": p1_by_split_source,
    "p2_found": p2_found,
    "p2_links": p2_links,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p6_found": p6_found,
    "p6_triggered": p6_triggered,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_leaked_items": p8_leaked_items,
    "p9_found": p9_found,
}

