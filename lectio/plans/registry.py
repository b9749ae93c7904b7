"""Queries over the test tables: one for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, html, robots, urls
from ..functions.snippet import highlight, prefix, snippet, window_start
from ..functions.twin import tokenize
from ..operators import crawl, index, live, search
from ..operators.query import parse
from ..sources import files, sinks
from ..sources.store import IndexStore
from ..streaming import index as stream_index_ops
from ..streaming import state
from .sql import SQL as _SQL
from .sql import (
    AND_QUERY,
    BATCH_QUERIES,
    DUP_QUERY,
    LIVE_QUERY,
    MULTI_PHRASE_QUERY,
    OR_QUERY,
    PHRASE_QUERY,
    ROBOTS_AGENT,
    SEED_HOST,
    SNIPPET_TERMS,
    TEST_DOMAINS,
    TOP_N,
)
from .tables import shared_dir, spread, table

SQL = _SQL
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` as the engine's documents."""
    t = spread(table(spark, d, "documents"))
    content = F.coalesce("text", F.lit(""))
    kind = F.element_at(F.array(F.lit("Pdf"), F.lit("Markdown"), F.lit("Html")), (F.col("doc_id") % 3).cast("int") + 1)
    return t.select(
        "doc_id",
        F.substring_index(content, "\n", 1).alias("title"),
        F.lit(None).cast("string").alias("url"),
        F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("path"),
        kind.alias("content_type"),
        content.alias("content"),
    )


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs, postings, lengths, stats) of ``documents``."""
    docs = docs_of(spark, d)
    lengths = index.doc_lengths(docs)
    return docs, index.build_postings(docs), lengths, index.corpus_stats(docs)


def served(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, float]]:
    """(docs, postings, lengths, numbers) as the engine serves them: an index of ``documents`` built once into a store in
    the shared folder and read back, so that a search reads the postings of its terms."""
    path = f"{d}/documents.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    changed = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    key = (spark.sparkContext.applicationId, path, changed)
    if key not in _served:
        docs = docs_of(spark, d)
        store = IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
        store.save({"docs": docs, "postings": index.build_postings(docs), "lengths": index.doc_lengths(docs)})
        _served[key] = store
    held = _served[key].load()
    return held["docs"], held["postings"], held["lengths"], _served[key].stats()


_served: dict[tuple, IndexStore] = {}


def ranked(spark: SparkSession, d: str, text: str) -> DataFrame:
    _, postings, lengths, stats = served(spark, d)
    return search.scored(postings, lengths, stats, parse(text))


def crawled(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "crawled"))


# ---- text analysis


@query
def tokenize_docs(spark, d):
    docs = docs_of(spark, d)
    terms = analysis.stemmed(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return docs.select("doc_id").join(terms, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("t.term", " "), F.lit("")).alias("tokens"))


@query
def stopword_filter(spark, d):
    return docs_of(spark, d).select("doc_id", F.array_join(analysis.raw_tokens(F.col("content")), " ").alias("tokens"))


@query
def stem_vocab(spark, d):
    return analysis.stem_vocabulary(analysis.exploded(docs_of(spark, d)))


# ---- index


@query
def build_postings(spark, d):
    return index.build_postings(docs_of(spark, d)).select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query
def doc_lengths(spark, d):
    return index.doc_lengths(docs_of(spark, d))


@query
def corpus_stats(spark, d):
    return index.corpus_stats(docs_of(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def term_df(spark, d):
    return index.term_df(index.build_postings(docs_of(spark, d)))


@query
def term_idf(spark, d):
    docs = docs_of(spark, d)
    n = index.corpus_stats(docs).select(F.col("n").cast("double")).scalar()
    return index.term_idf(index.build_postings(docs), n).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def doc_terms(spark, d):
    return index.doc_terms(index.build_postings(docs_of(spark, d))).select("doc_id", F.array_join("terms", " ").alias("terms"))


@query
def all_doc_ids(spark, d):
    return docs_of(spark, d).select("doc_id")


@query
def postings_lookup(spark, d):
    """On the given postings table, where the filter reaches the scan."""
    p = table(spark, d, "postings")
    return search.postings_of(p, ["grace", "natur"]).select("term", "doc_id", F.coalesce("tf", F.size("positions")).alias("tf")).distinct()


@query
def posting_point(spark, d):
    p = table(spark, d, "postings")
    least = p.where("term = 'natur'").agg(F.min("doc_id")).scalar()
    return p.where((F.col("term") == "natur") & (F.col("doc_id") == least)).select("term", "doc_id", F.coalesce("tf", F.size("positions")).alias("tf")).distinct()


@query
def delete_docs(spark, d):
    docs, postings, *_ = parts(spark, d)
    return index.delete_docs(postings, docs.where("content_type = 'Pdf'")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def upsert_docs(spark, d):
    """The texts of every third document are put in place of those of the document before."""
    docs = docs_of(spark, d)
    changes = docs.where("doc_id % 3 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("seq"), "title", "content")
    after = index.upsert_docs(docs, changes)
    return index.doc_lengths(after)


@query
def stream_index(spark, d):
    """The same index by a stream of changes into a versioned store."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "documents").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    raw = reader.parquet(f"{d}/documents.parquet") if whole else reader.option("pathGlobFilter", "documents.parquet").parquet(d)
    changes = raw.select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.lit("upsert").alias("op"), F.lit(0).alias("seq"))
    store = IndexStore(spark, f"{folder}/index")
    stream_index_ops.start(changes, store, f"{folder}/checkpoint").awaitTermination()
    held = store.load()
    return held["postings"].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def store_round_trip(spark, d):
    docs, postings, lengths, stats = parts(spark, d)
    base = shared_dir(spark)
    store = IndexStore(spark, f"{base}/store-{uuid.uuid4().hex}")
    store.save({"docs": docs, "postings": postings, "lengths": lengths, "stats": stats})
    return store.load()["stats"].select("n", F.round("avgdl", 6).alias("avgdl"))


# ---- local search


@query
def search_any(spark, d):
    _, postings, *_ = served(spark, d)
    return search.postings_of(postings, parse(AND_QUERY).terms).select("doc_id").distinct()


@query
def search_and(spark, d):
    return ranked(spark, d, AND_QUERY)


@query
def and_intersect(spark, d):
    """The same set by intersection."""
    _, postings, *_ = served(spark, d)
    out = None
    for t in parse(AND_QUERY).required:
        ids = search.postings_of(postings, [t]).select("doc_id")
        out = ids if out is None else out.intersect(ids)
    return out


@query
def docs_missing_term(spark, d):
    docs, postings, *_ = served(spark, d)
    return docs.select("doc_id").join(search.postings_of(postings, [parse(AND_QUERY).required[0]]), "doc_id", "left_anti")


@query
def search_or(spark, d):
    return ranked(spark, d, OR_QUERY)


@query
def bm25_scores(spark, d):
    """Scores of all documents with any of the terms."""
    _, postings, lengths, stats = served(spark, d)
    q = parse(AND_QUERY)
    return search.scored(postings, lengths, stats, type(q)([], q.required, []))


@query
def search_dup_terms(spark, d):
    return ranked(spark, d, DUP_QUERY)


@query
def search_phrase(spark, d):
    return ranked(spark, d, PHRASE_QUERY)


@query
def search_multi_phrase(spark, d):
    return ranked(spark, d, MULTI_PHRASE_QUERY)


@query
def search_content_type(spark, d):
    docs = docs_of(spark, d)
    return ranked(spark, d, AND_QUERY).join(docs.where("content_type = 'Html'").select("doc_id"), "doc_id", "left_semi")


@query
def search_total(spark, d):
    return ranked(spark, d, OR_QUERY).agg(F.count("*").alias("total_matches"))


@query
def search_topn(spark, d):
    return search.top(ranked(spark, d, OR_QUERY), TOP_N)


@query
def search_page2(spark, d):
    return search.top(ranked(spark, d, OR_QUERY), TOP_N, TOP_N)


@query
def search_items(spark, d):
    docs, postings, lengths, stats = served(spark, d)
    q = parse(OR_QUERY)
    return search.items(search.top(search.scored(postings, lengths, stats, q), TOP_N), docs, q)


@query
def batch_search(spark, d):
    _, postings, lengths, stats = served(spark, d)
    return search.batch(postings, lengths, stats, BATCH_QUERIES)


@query
def empty_query(spark, d):
    return ranked(spark, d, "the of")


def _result(spark: SparkSession, d: str, pascal: bool) -> DataFrame:
    docs, postings, lengths, stats = served(spark, d)
    q = parse(OR_QUERY)
    found = search.scored(postings, lengths, stats, q)
    items = search.items(search.top(found, TOP_N), docs, q).withColumn("snippet", F.lit(""))
    return sinks.result_json(items, OR_QUERY, found.count(), 0.0, pascal)


@query
def result_json(spark, d):
    """A whole result as one object (its snippets, checked by search_items, and its time left out)."""
    return _result(spark, d, False)


@query
def sse_frames(spark, d):
    return _result(spark, d, True).select(sinks.sse_frame(F.lit("scored"), F.col("json")).alias("frame"))


# ---- snippets


def _snippet_docs(spark, d):
    return docs_of(spark, d).select("doc_id", "content")


@query
def snippet_prefix(spark, d):
    return _snippet_docs(spark, d).select("doc_id", prefix(F.col("content")).alias("snippet"))


@query
def snippet_window(spark, d):
    return _snippet_docs(spark, d).select("doc_id", window_start(F.col("content"), SNIPPET_TERMS).alias("start"))


@query
def snippet_highlight(spark, d):
    return _snippet_docs(spark, d).select("doc_id", highlight(F.col("content"), SNIPPET_TERMS).alias("marked"))


@query
def snippet_text(spark, d):
    return _snippet_docs(spark, d).select("doc_id", snippet(F.col("content"), SNIPPET_TERMS).alias("snippet"))


# ---- urls


@query
def url_normalize(spark, d):
    return crawled(spark, d).select("page_id", urls.dedupe_key(F.col("url")).alias("key"))


@query
def seed_normalize(spark, d):
    return crawled(spark, d).select("page_id", urls.seed(F.regexp_replace("url", "^https://", "")).alias("seed"))


@query
def url_domain(spark, d):
    return crawled(spark, d).select("page_id", urls.domain(F.col("url")).alias("domain"))


@query
def is_scholarly(spark, d):
    return crawled(spark, d).select("page_id", urls.is_scholarly(F.col("url"), TEST_DOMAINS).alias("is_scholarly"))


@query
def unwrap_redirect(spark, d):
    wrapped = F.concat(F.lit("//go.example/l/?uddg="), F.replace(F.replace(F.replace("url", F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F")), F.lit("&"), F.lit("%26")), F.lit("&rut=1"))
    return crawled(spark, d).select("page_id", urls.unwrap_redirect(wrapped).alias("target"))


@query
def augment_query(spark, d):
    return table(spark, d, "query_log").select("query", urls.augment_query(F.col("query")).alias("augmented")).distinct()


@query
def cache_key(spark, d):
    log = table(spark, d, "query_log")
    return log.select(urls.cache_key(F.coalesce("mode", F.lit("live")), F.coalesce("top_n", F.lit(10)), F.coalesce("query", F.lit(""))).alias("cache_key")).groupBy("cache_key").agg(F.count("*").alias("n"))


@query
def dedupe_urls(spark, d):
    hits = crawled(spark, d).select(F.col("page_id").alias("pos"), "url", "title")
    return live.dedupe(hits)


@query
def dedupe_exact(spark, d):
    hits = crawled(spark, d).select(F.col("page_id").alias("pos"), F.lower("url").alias("key"), "url")
    return index.keep_first(hits, "key", "pos").select("pos", "url")


# ---- html


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """HTML written around the crawled pages: title, styles, scripts, navigation, paragraphs and links."""
    t, x = _escaped(F.coalesce("title", F.lit(""))), _escaped(F.coalesce("text_content", F.lit("")))
    anchors = F.array_join(F.transform(F.coalesce("out_links", F.array().cast("array<string>")), lambda u: F.concat(F.lit('<a href="'), _escaped(u), F.lit('">more</a>'))), " ")
    body = F.concat(F.lit("<p>"), F.replace(x, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>"))
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><title> "), t, F.lit(" </title><style>p {color: red}</style></head><body><nav>Home | About</nav><h1>"), t,
        F.lit('</h1><!-- note --><script>var a = "<p>";</script>'), body, F.lit('<a href="#top">top</a> <a href="mailto:a@b.example">mail</a> <a href="next?p=2#f">next</a> '),
        anchors, F.lit("<footer>&copy; all</footer></body></html>"),
    )
    return crawled(spark, d).select("page_id", "url", page.alias("html"))


@query
def html_title(spark, d):
    return html_pages(spark, d).select("page_id", html.title(F.col("html")).alias("title"))


@query
def html_text(spark, d):
    return html_pages(spark, d).select("page_id", html.text(F.col("html")).alias("text"))


@query
def extract_links(spark, d):
    pages = html_pages(spark, d).select("page_id", F.posexplode(html.links(F.col("html"), F.col("url"))).alias("ordinal", "link"))
    return pages


@query
def html_extract(spark, d):
    e = html.extract(html_pages(spark, d))
    return e.select("page_id", "page_title", F.length("page_text").alias("text_length"), F.size("page_links").alias("links"))


@query
def html_extract_any(spark, d):
    """The general parser gives the same counts."""
    e = html.extract_any(html_pages(spark, d), "page_id")
    return e.select("page_id", "page_title", F.length("page_text").alias("text_length"), F.size("page_links").alias("links"))


# ---- robots


@query
def robots_parse(spark, d):
    r = robots.parse(table(spark, d, "robots_txt"), ROBOTS_AGENT)
    return r.select("host", F.array_join("allow", " ").alias("allow"), F.array_join("disallow", " ").alias("disallow"))


@query
def robots_gate(spark, d):
    rules = robots.parse(table(spark, d, "robots_txt"), ROBOTS_AGENT)
    hosts = rules.withColumn("host", F.explode(F.array("host", F.concat(F.lit("www."), "host"))))
    return robots.gate(crawled(spark, d).select("page_id", "url"), hosts).select("page_id", "robots_allowed")


@query
def robots_allowed(spark, d):
    """Every distinct path of the crawl against fixed rules of each form."""
    paths = crawled(spark, d).select(F.when(urls.part(F.col("url"), 3) == "", "/").otherwise(urls.part(F.col("url"), 3)).alias("path")).distinct()
    allow = F.array(F.lit("/library/law"), F.lit("/a*poverty"), F.lit("/read$"))
    deny = F.array(F.lit("/library"), F.lit("/a"), F.lit("/READ"), F.lit("/*.pdf$"), F.lit("*grace"))
    return paths.select("path", robots.allowed(F.col("path"), allow, deny).alias("allowed"))


# ---- fetching, crawling


@query
def fetch_gate(spark, d):
    pages = crawled(spark, d)
    status = F.regexp_extract(F.coalesce("error", F.lit("")), r"^HTTP (\d{3})", 1)
    media = F.regexp_extract(F.coalesce("error", F.lit("")), r"^Non-HTML content type: (.*)$", 1)
    snapshot = pages.select(
        "url", F.when(status != "", status.cast("int")).otherwise(200).alias("status"), F.lit("Error").alias("reason"), F.when(media != "", media).otherwise("text/html").alias("media_type")
    )
    return files.fetch_gate(snapshot)


@query
def content_type_by_ext(spark, d):
    ext = F.element_at(F.array(*(F.lit(x) for x in (".md", ".HTML", ".pdf", ".txt", "", ".htm"))), (F.col("page_id") % 6).cast("int") + 1)
    return crawled(spark, d).select("page_id", files.content_type(F.concat(F.lit("/data.v1/f"), F.col("page_id").cast("string"), ext)).alias("content_type"))


@query
def index_url(spark, d):
    first = crawled(spark, d).where("success and trim(text_content) != ''").agg(F.min_by("url", "page_id").alias("url")).first()
    return files.index_url(crawled(spark, d), first.url if first else "").select("doc_id", "url", "content_type")


@query
def crawl_report(spark, d):
    return crawl.report(crawled(spark, d))


@query
def crawl_bfs(spark, d):
    pages = crawled(spark, d)
    seed = pages.where((urls.host(F.col("url")) == SEED_HOST) & F.col("success") & (F.size("out_links") > 2)).agg(F.min("url").alias("url")).first()
    return crawl.crawl(pages, table(spark, d, "links"), crawl.CrawlOptions(seed.url or f"https://{SEED_HOST}", 20, True, 2))


@query
def crawl_depths(spark, d):
    links = table(spark, d, "links")
    seeds = links.where(urls.host(F.col("src")) == SEED_HOST).agg(F.min("src").alias("url"))
    return crawl.depths(links, seeds, 3)


# ---- live search


def discovery_of(spark: SparkSession, d: str) -> DataFrame:
    return crawled(spark, d).select(F.col("page_id").alias("pos"), "url", "title", F.left(F.coalesce("text_content", F.lit("")), F.lit(160)).alias("snippet"))


def live_pages(spark: SparkSession, d: str) -> DataFrame:
    return live.fetched(live.dedupe(discovery_of(spark, d)), crawled(spark, d))


@query
def live_search(spark, d):
    return live.ranked(live_pages(spark, d), LIVE_QUERY, TEST_DOMAINS).select("pos", "url", "score", "is_scholarly", "domain")


@query
def live_items(spark, d):
    return live.top_items(live.ranked(live_pages(spark, d), LIVE_QUERY, TEST_DOMAINS), LIVE_QUERY, TOP_N).select("rank", "title", "url", "score", "source_type", "is_scholarly", "domain")


@query
def live_fallback(spark, d):
    return live.fallback_items(live.dedupe(discovery_of(spark, d)), TOP_N)


@query
def live_stream_phases(spark, d):
    """Both phases of the two-step answer as one table."""
    out = None
    for name, items in live.phases(discovery_of(spark, d), crawled(spark, d), LIVE_QUERY, TOP_N, None):
        rows = items.select(F.lit(name).alias("phase"), "rank", "url", "title")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def title_boost(spark, d):
    terms = tokenize(LIVE_QUERY)
    title = analysis.tokenize(F.coalesce("title", F.lit("")))
    n = live.title_hits(title, terms)
    return crawled(spark, d).select("page_id", F.round(1.0 + live.TITLE_BOOST * n / len(terms), 6).alias("boost"))


# ---- state


@query
def debounce_flushes(spark, d):
    return state.flush_times(table(spark, d, "events"))


@query
def cache_hits(spark, d):
    log = table(spark, d, "query_log").where("ts is not null and trim(query) != ''").distinct()
    key = urls.cache_key(F.coalesce("mode", F.lit("live")), F.coalesce("top_n", F.lit(10)), F.col("query"))
    return state.cache_hits(log.select(key.alias("key"), "ts"), seconds=300)


@query
def response_cache(spark, d):
    """The same with the life of the outer cache."""
    log = table(spark, d, "query_log").where("ts is not null and trim(query) != ''").distinct()
    key = urls.cache_key(F.coalesce("mode", F.lit("live")), F.coalesce("top_n", F.lit(10)), F.col("query"))
    return state.cache_hits(log.select(key.alias("key"), "ts"), seconds=120).groupBy("hit").agg(F.count("*").alias("n"))


@query
def recent_history(spark, d):
    return state.recent(table(spark, d, "query_log"))


@query
def health(spark, d):
    return spark.range(1).select(F.lit(sinks.health()).alias("status"))


QUERIES["tokenize"] = QUERIES.pop("tokenize_docs")
