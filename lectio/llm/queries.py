"""The pN_ queries: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import encode, garble, leaks, pages, residue, terms, truncation


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.standing_lines(_table(spark, d, "crawled"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return pages.without_standing_lines(_table(spark, d, "crawled"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.most_distinctive(_table(spark, d, "postings"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.distinctiveness(_table(spark, d, "postings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.find_garbled(_table(spark, d, "crawled")).select("page_id", "field").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.find_garbled(_table(spark, d, "crawled"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.keyword_pages(_table(spark, d, "crawled"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(_table(spark, d, "crawled")).select("page_id", "field").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.outside_body(_table(spark, d, "crawled"))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    return pages.body(_table(spark, d, "crawled"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.mark_terms(_table(spark, d, "postings")).where("mark is not null").select("term", "mark")


def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.mark_terms(_table(spark, d, "postings"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(_table(spark, d, "documents").select("doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cut(_table(spark, d, "documents"))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_by_source(_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        p1_found, p1_texts, p2_found, p2_scores, p3_found, p3_restored, p4_found, p5_found, p6_found, p6_frequencies, p7_found, p7_texts, p8_ids, p9_found,
        p10_found, p10_sources,
    )
}
