"""Term statistics of a postings table: frequencies (problem 6) and distinctiveness (problem 2).

A postings row is (term, doc_id, tf, positions). Common rules of both operators:

* exact copies of a row count once; rows of one (term, doc_id) that differ are added;
* a null ``tf`` falls back to the number of positions, and to 0 where these are null too;
* a null, empty or blank term names no term, but its record still counts as a record;
* a null ``doc_id`` is no record: the row is ignored;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-partitions of one term: even a term that holds a third of all rows is sorted in this many tasks.
SALTS = 64


def _rows(postings: DataFrame) -> DataFrame:
    """The narrow form of the postings: term, record, occurrences and a hash of the whole row."""
    return postings.where(F.col("doc_id").isNotNull()).select(
        "term",
        "doc_id",
        F.coalesce(F.col("tf").cast("long"), F.size("positions").cast("long"), F.lit(0)).alias("occ"),
        F.xxhash64("tf", "positions").alias("row_key"),
    ).withColumn("occ", F.greatest("occ", F.lit(0)))


def _named(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim("term") != "")


def n_records(postings: DataFrame) -> Column:
    """Number of distinct records as a scalar subquery."""
    return (
        postings.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.lit(1).alias("one")).agg(F.count("one").alias("n")).scalar()
    )


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(term, occurrences, records) of every term by last-seen counters.

    Rows are hash-partitioned by (term, salt of the record) and ordered by record; each run keeps only its last
    record and row identifiers, so a record is counted when its identifier differs from the one seen last and a copy
    is skipped when the whole row does not. No set of records is ever held. A record falls in exactly one salt of a
    term, so the partial counters add up.
    """
    rows = _named(_rows(postings)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    seen = Window.partitionBy("term", "salt").orderBy("doc_id", "row_key")
    flagged = rows.select(
        "term",
        "occ",
        F.lag("doc_id").over(seen).eqNullSafe(F.col("doc_id")).alias("same_record"),
        F.lag("row_key").over(seen).eqNullSafe(F.col("row_key")).alias("same_row"),
    )
    return flagged.groupBy("term").agg(
        F.sum(F.when(F.col("same_record") & F.col("same_row"), 0).otherwise(F.col("occ"))).alias("occurrences"),
        F.sum((~F.col("same_record")).cast("long")).alias("records"),
    )


def mark_terms(postings: DataFrame, rare_below: int = 4, common_share: float = 0.25) -> DataFrame:
    """:func:`term_frequencies` with ``mark``: ``rare`` below ``rare_below`` records, ``common`` above the share
    ``common_share`` of all records, else null. A term that is both (tiny collections) is ``rare``."""
    n = n_records(postings)
    return term_frequencies(postings).withColumn(
        "mark",
        F.when(F.col("records") < rare_below, "rare").when(F.col("records") > n * F.lit(common_share), "common"),
    )


def distinctiveness(postings: DataFrame) -> DataFrame:
    """(doc_id, term, tf, score) of every term of every record.

    score = tf * (observed idf - idf expected from a Poisson spread of the term's occurrences), rounded to 6 digits.
    A term spread evenly scores about 0; one concentrated in few records scores high.
    """
    per = (
        _named(_rows(postings))
        .groupBy("term", "doc_id", "row_key")
        .agg(F.first("occ").alias("occ"))
        .groupBy("term", "doc_id")
        .agg(F.sum("occ").alias("tf"))
    )
    n = n_records(postings).cast("double")
    stats = term_frequencies(postings).select(
        "term",
        (
            F.log2(n / F.col("records")) + F.log2(F.lit(1.0) - F.exp(-F.col("occurrences") / n))
        ).alias("ridf"),
    )
    return per.join(stats, "term").select("doc_id", "term", "tf", F.round(F.col("tf") * F.coalesce("ridf", F.lit(0.0)), 6).alias("score"))


def most_distinctive(postings: DataFrame) -> DataFrame:
    """(doc_id, term): the term with the highest score of each record; equal scores go to the term that sorts first.
    The best is kept per partition before the shuffle, so one record with a third of all rows is no hot spot."""
    best = distinctiveness(postings).groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("term"))).alias("b"))
    return best.select("doc_id", F.col("b.term").alias("term"))
