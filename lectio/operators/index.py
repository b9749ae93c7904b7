"""The inverted index as tables: postings, document lengths, statistics, and changes to them.

``docs`` has (doc_id, content, ...). ``postings`` has (term, doc_id, tf, positions), positions counted from 0 over kept
tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analysis


def documents(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the columns of ``schema`` (doc_id, content, ...), absent ones null, under their types; the last row of
    each doc_id stays (the order is that of the rows), rows without doc_id fall out."""
    kinds = dict(x.split(" ") for x in schema.split(", "))
    full = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
    full = full.where("doc_id is not null").withColumn("last_indexed_at", F.coalesce("last_indexed_at", F.current_timestamp())).withColumn("_at", F.monotonically_increasing_id())
    rest = [c for c in kinds if c != "doc_id"]
    last = full.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "_at").alias("d"))
    return last.select("doc_id", "d.*").select(*kinds)


def build_postings(docs: DataFrame, analyzer: analysis.Analyzer = analysis.STANDARD) -> DataFrame:
    """One row a term and document. The rows of a document are in one task, so the partial aggregate already completes
    each group and the shuffle moves finished postings."""
    return (
        analysis.stemmed(docs, analyzer=analyzer)
        .groupBy("term", "doc_id")
        .agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    )


def doc_lengths(docs: DataFrame, analyzer: analysis.Analyzer = analysis.STANDARD) -> DataFrame:
    """(doc_id, doc_len) in kept tokens; no shuffle, no stemming."""
    return docs.select("doc_id", F.size(analyzer.tokens(F.col("content"))).alias("doc_len"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row (n, avgdl); documents without tokens count."""
    return doc_lengths(docs).agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"))


def term_df(postings: DataFrame) -> DataFrame:
    """(term, df): postings hold one row a term and document."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def term_idf(postings: DataFrame, n) -> DataFrame:
    """(term, df, idf) with ``n`` documents (a number or a scalar column)."""
    df = F.col("df").cast("double")
    n = F.lit(n) if isinstance(n, int) else n
    return term_df(postings).select("term", "df", F.log((n - df + 0.5) / (df + 0.5) + 1.0).alias("idf"))


def doc_terms(postings: DataFrame) -> DataFrame:
    """(doc_id, terms): the sorted distinct terms of each document."""
    return postings.groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def delete_docs(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings without the documents of ``ids`` (doc_id); terms left without documents vanish."""
    return postings.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def upsert_docs(docs: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """``docs`` with ``changes`` (doc_id, ``order``, and columns of ``docs``) put in place of or beside them; the last change
    of a document wins, and equal orders go to the row that sorts last. Columns that the changes lack become null."""
    rest = [c for c in docs.columns if c != "doc_id"]
    full = changes.select("doc_id", order, *((F.col(c) if c in changes.columns else F.lit(None)).cast(docs.schema[c].dataType).alias(c) for c in rest))
    last = full.groupBy("doc_id").agg(F.max(F.struct(order, *rest)).alias("c")).select("doc_id", *(F.col(f"c.{c}").alias(c) for c in rest))
    return docs.join(last.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(last)


def upsert_postings(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with those of the documents ``changed`` (doc_id, content) replaced: only these are analysed again."""
    return delete_docs(postings, changed).unionByName(build_postings(changed))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row by ``order`` for each ``key``. A minimum of structs is kept per partition before the shuffle, so a
    key with many rows is no hot spot."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("first"))
    return first.select(key, "first.*").select(*df.columns)
