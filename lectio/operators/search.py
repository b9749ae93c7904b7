"""Ranked search over postings: candidates, required terms, phrases, BM25, top-N, items and batches of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.snippet import snippet
from ..functions.twin import tokenize
from .query import ParsedQuery, parse

K1, B = 1.2, 0.75


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """The score of one term in one document; 0 for an empty collection."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
    part = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / F.nullif(avgdl, F.lit(0.0))))
    return F.coalesce(idf * part, F.lit(0.0))


def postings_of(postings: DataFrame, terms: Iterable[str]) -> DataFrame:
    """Postings of the terms; the literal list is pushed to the scan."""
    terms = sorted(set(terms))
    return postings.where(F.col("term").isin(*terms)) if terms else postings.where("false")


def _in_order(phrase: list[str]) -> Column:
    """Whether the terms of a phrase stand at consecutive positions, given ``at``: term -> positions."""
    first = F.coalesce(F.col("at")[phrase[0]], F.array().cast("array<int>"))

    def here(p: Column) -> Column:
        ok = F.lit(True)
        for i, t in enumerate(phrase[1:], 1):
            ok = ok & F.array_contains(F.coalesce(F.col("at")[t], F.array().cast("array<int>")), p + i)
        return ok

    return F.exists(first, here)


def matches(postings: DataFrame, query: ParsedQuery) -> DataFrame:
    """(doc_id, tf, and doc_len where the postings carry it): documents with all required terms and phrases, with tf of each query term as a map. One shuffle, of
    the postings of the query's terms only; a query without phrases does not read positions."""
    found = postings_of(postings, query.terms)
    sums = [F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tf")]
    held = ["doc_len"] if "doc_len" in postings.columns else []
    sums += [F.first(c).alias(c) for c in held]
    if query.phrases:
        words = {t for p in query.phrases for t in p}
        sums.append(F.map_from_entries(F.collect_list(F.when(F.col("term").isin(*words), F.struct("term", "positions")))).alias("at"))
    docs = found.groupBy("doc_id").agg(*sums)
    for t in sorted(set(query.required)):
        docs = docs.where(F.map_contains_key("tf", t))
    for p in query.phrases:
        docs = docs.where(_in_order(p))
    return docs.select("doc_id", "tf", *held)


#: A ranker: the score of one term from the columns (tf, df, document length, n, average length).
Scorer = Callable[[Column, Column, Column, Column, Column], Column]


def scored(postings: DataFrame, lengths: DataFrame, stats: DataFrame | tuple[int, float], query: ParsedQuery, k1: float = K1, b: float = B, scorer: Scorer | None = None) -> DataFrame:
    """(doc_id, score) of all matches; the sum runs over query terms with repeats. Scores are rounded to 6 digits, so that
    ranks do not hang on the order of a sum. ``scorer`` takes the place of BM25. ``stats`` are (n, avgdl) as numbers or as a
    table of one row. Postings that carry the length of their document are all that is read."""
    score_of = scorer or (lambda tf, df, dl, n, avgdl: bm25(tf, df, dl, n, avgdl, k1, b))
    counts = Counter(query.terms)
    terms = sorted(counts)
    df = {r.term: r.df for r in postings_of(postings, terms).groupBy("term").agg(F.count("*").alias("df")).collect()}  # at most one row a query term
    hits = matches(postings, query)
    hits = hits if "doc_len" in hits.columns else hits.join(lengths, "doc_id")
    n, avgdl = numbers(stats)
    score = F.lit(0.0)
    for t in terms:
        if df.get(t):
            tf = F.coalesce(F.col("tf")[t], F.lit(0)).cast("double")
            score = score + counts[t] * score_of(tf, F.lit(float(df[t])), F.col("doc_len").cast("double"), n, avgdl)
    return hits.select("doc_id", F.round(score, 6).alias("score"))


def numbers(stats: DataFrame | tuple[int, float]) -> tuple[Column, Column]:
    """(n, avgdl) as columns."""
    if isinstance(stats, tuple):
        return F.lit(float(stats[0])), F.lit(float(stats[1]))
    return stats.select(F.col("n").cast("double")).scalar(), stats.select("avgdl").scalar()


def top(ranked: DataFrame, n: int = 10, skip: int = 0) -> DataFrame:
    """(rank, doc_id, score): the best ``n`` after ``skip``, best first, ties by doc_id; a heap per task, no full sort."""
    n, skip = max(n, 0), max(skip, 0)
    cut = ranked.orderBy(F.desc("score"), "doc_id").limit(n + skip)
    order = Window.orderBy(F.desc("score"), "doc_id")
    return cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") > skip).select("rank", "doc_id", "score")


def items(best: DataFrame, docs: DataFrame, query: ParsedQuery) -> DataFrame:
    """Result items of the few best documents: metadata and snippets are read for these only."""
    made = shown(best.join(docs, "doc_id", "left"), query, "rank", "score")
    return made.select("rank", "title", "url", "snippet", "score", "source_type", "is_scholarly", "domain")


def shown(docs: DataFrame, query: ParsedQuery, *more: str) -> DataFrame:
    """(doc_id, ``more``, and what an item shows of its document)."""
    return docs.select(
        "doc_id",
        *more,
        F.coalesce("title", F.col("doc_id").cast("string")).alias("title"),
        F.coalesce("url", "path").alias("url"),
        snippet(F.coalesce("content", F.lit("")), query.terms).alias("snippet"),
        F.coalesce("content_type", F.lit("Markdown")).alias("source_type"),
        F.lit(False).alias("is_scholarly"),
        F.lit(None).cast("string").alias("domain"),
    )


def batch(
    postings: DataFrame, lengths: DataFrame, stats: DataFrame | tuple[int, float], queries: Iterable[tuple[int, str, int]],
    k1: float = K1, b: float = B, scorer: Scorer | None = None, tokenize: Callable[[str], list[str]] = tokenize,
) -> DataFrame:
    """(qid, rank, doc_id, score) of many queries (qid, text, top_n) in one pass: the terms of all queries join the
    postings once; required terms and phrases are checked by counting."""
    spark = postings.sparkSession
    rows, needs = [], []
    for qid, text, n in queries:
        q = parse(text, tokenize)
        if q.is_empty or n <= 0:
            continue
        for t, c in Counter(q.terms).items():
            rows.append((qid, t, c, t in q.required, any(t in p for p in q.phrases)))
        needs.append((qid, len(set(q.required)), q.phrases, n))
    terms = spark.createDataFrame(rows, "qid int, term string, weight int, needed boolean, placed boolean")
    need = spark.createDataFrame(needs, "qid int, needed_n int, phrases array<array<string>>, top_n int")
    wanted = sorted({r[1] for r in rows})
    mine = postings_of(postings, wanted) if len(wanted) <= 5000 else postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = numbers(stats)
    score_of = scorer or (lambda tf, df, dl, n, avgdl: bm25(tf, df, dl, n, avgdl, k1, b))
    one = mine.join(terms, "term").join(df, "term")
    one = one if "doc_len" in mine.columns else one.join(lengths, "doc_id")
    part = F.col("weight") * score_of(F.col("tf").cast("double"), F.col("df").cast("double"), F.col("doc_len").cast("double"), n, avgdl)
    docs = one.groupBy("qid", "doc_id").agg(
        F.round(F.sum(part), 6).alias("score"),
        F.sum(F.col("needed").cast("int")).alias("got"),
        F.map_from_entries(F.collect_list(F.when(F.col("placed"), F.struct("term", "positions")))).alias("at"),
    )
    empty = F.array().cast("array<int>")

    def phrase_ok(p: Column) -> Column:
        return F.exists(
            F.coalesce(F.col("at")[p[0]], empty),
            lambda pos: F.forall(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.array_contains(F.coalesce(F.col("at")[F.element_at(p, i + 1)], empty), pos + i)),
        )

    kept = docs.join(need, "qid").where((F.col("got") == F.col("needed_n")) & F.forall("phrases", phrase_ok))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    # a limit known to the plan lets each task keep its best rows of a query before they are gathered
    most = max((x[3] for x in needs), default=0)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).where(F.col("rank") <= F.col("top_n")).select("qid", "rank", "doc_id", "score")
