"""Live search: discovery, removal of repeats, fetched pages, ranking over just these pages, and fallback."""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis, urls
from ..functions.snippet import snippet
from ..functions.twin import tokenize
from .index import keep_first
from .search import B, K1, bm25

TITLE_BOOST, SCHOLARLY_BOOST = 0.3, 1.5
#: Hits of the discovery that a live search goes on with.
DISCOVERED = 50


def dedupe(discovery: DataFrame, most: int | None = None) -> DataFrame:
    """The first hit of each address by position, spellings taken together; of these the first ``most`` where given."""
    first = keep_first(discovery.withColumn("key", urls.dedupe_key(F.col("url"))), "key", "pos").drop("key")
    return first if most is None else first.orderBy("pos").limit(most)


def fetched(discovery: DataFrame, pages: DataFrame) -> DataFrame:
    """Discovery hits joined with their pages by address without letter case, where the fetch gave text."""
    found = pages.where(F.col("success") & (F.trim(F.coalesce("text_content", F.lit(""))) != "")).select(
        F.lower("url").alias("_url"), "page_id", F.col("title").alias("page_title"), "text_content"
    )
    first = found.groupBy("_url").agg(F.min_by(F.struct("page_id", "page_title", "text_content"), "page_id").alias("p")).select("_url", "p.*")
    return discovery.join(first, F.lower(discovery.url) == first["_url"]).drop("_url", "page_id")


def _counts(text, names: list[str]):
    """struct(dl, tf): kept tokens of a text, and how often each of the stems ``names`` occurs, in one pass over the row.
    A token can only have a stem if it begins with all of the stem but its last four letters (no suffix is replaced by a
    longer one), so the stemmer sees few tokens."""

    def of(tokens):
        if not names:
            return F.struct(F.size(tokens).alias("dl"), F.array().cast("array<int>").alias("tf"))
        begins = [n[: max(1, len(n) - 4)] for n in names]
        near = F.filter(tokens, lambda t: functools.reduce(lambda x, y: x | y, (t.startswith(p) for p in sorted(set(begins)))))
        return F.struct(F.size(tokens).alias("dl"), F.transform(F.array(F.transform(near, analysis.stem)), lambda x: _tf(x, names))[0].alias("tf"))

    return F.transform(F.array(analysis.raw_tokens(text)), of)[0]


def _tf(stems, names: list[str]):
    return F.array(*(F.size(F.filter(stems, lambda s: s == n)) for n in names))


def title_hits(title_terms, terms: list[str]):
    """How many of the query's terms, with repeats, the title has; the title's terms are worked out once a row."""
    if not terms:
        return F.lit(0)
    wanted = F.array(*(F.lit(t) for t in terms))
    return F.transform(F.array(title_terms), lambda held: F.size(F.filter(wanted, lambda t: F.array_contains(held, t))))[0]


def ranked(pages: DataFrame, query: str, domains: tuple[str, ...] = urls.SCHOLARLY_DOMAINS, k1: float = K1, b: float = B) -> DataFrame:
    """Every page with its score, zero included: BM25 over these pages only, times boosts for title words and preferred
    domains. The query language does not apply: all tokens of the text count."""
    terms = tokenize(query)
    counts = Counter(terms)
    names = sorted(counts)
    rows = pages.withColumnRenamed("pos", "hit").withColumn("seen", _counts(F.col("text_content"), names))
    one = F.lit(1.0)
    sums = [F.sum((F.col("seen.tf")[i] > 0).cast("double")) for i in range(len(names))]
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("seen.dl"), F.lit(0.0)).alias("avgdl"), F.array(F.lit(0.0), *(F.coalesce(x, F.lit(0.0)) for x in sums)).alias("df")).first()
    score = F.lit(0.0)
    for i, t in enumerate(names):
        if stats.df[i + 1]:
            tf = F.col("seen.tf")[i].cast("double")
            score = score + counts[t] * bm25(tf, one * stats.df[i + 1], F.col("seen.dl").cast("double"), one * stats.n, one * stats.avgdl, k1, b)
    shown = F.when(F.trim(F.coalesce("page_title", F.lit(""))) != "", F.col("page_title")).otherwise(F.col("title"))
    title_terms = analysis.tokenize(F.coalesce(shown, F.lit("")))
    hits = title_hits(title_terms, terms)
    scholarly = urls.is_scholarly(F.col("url"), domains)
    boost = F.lit(1.0) + TITLE_BOOST * hits / max(len(terms), 1)
    return rows.select(
        F.col("hit").alias("pos"),
        "url",
        shown.alias("title"),
        "text_content",
        F.round(score * boost * F.when(scholarly, SCHOLARLY_BOOST).otherwise(1.0), 6).alias("score"),
        scholarly.alias("is_scholarly"),
        urls.domain(F.col("url")).alias("domain"),
    )


def top_items(scored: DataFrame, query: str, n: int = 10) -> DataFrame:
    """The best ``n`` pages as items; snippets are made for these only."""
    order = (F.desc("score"), F.col("pos"))
    cut = scored.orderBy(*order).limit(max(n, 0))
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(
        "rank", "title", "url", snippet(F.col("text_content"), tokenize(query)).alias("snippet"), "score", F.lit("Html").alias("source_type"), "is_scholarly", "domain"
    )


def fallback_items(discovery: DataFrame, n: int = 10) -> DataFrame:
    """Discovery hits as items without scores, for when no page could be fetched."""
    cut = discovery.orderBy("pos").limit(max(n, 0))
    return cut.select(
        F.row_number().over(Window.orderBy("pos")).alias("rank"),
        "title",
        "url",
        "snippet",
        F.lit(0.0).alias("score"),
        F.lit("Html").alias("source_type"),
        F.lit(False).alias("is_scholarly"),
        F.lit(None).cast("string").alias("domain"),
    )


def phases(discovery: DataFrame, pages: DataFrame, query: str, n: int = 10, most: int | None = DISCOVERED):
    """Yields ("discovery", items) at once and then ("scored", items); a blank query gives one empty "scored"."""
    hits = dedupe(discovery, most)
    if not query or query.isspace():
        yield "scored", fallback_items(hits, 0)
        return
    yield "discovery", fallback_items(hits, n)
    found = fetched(hits, pages)
    yield "scored", fallback_items(hits, n) if found.isEmpty() else top_items(ranked(found, query), query, n)
