"""The engine in one object: index, remove, search, live search, crawl, save and load."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import STANDARD, Analyzer
from .operators import crawl, index, live, search
from .operators.query import ParsedQuery, parse
from .schemas import DOCS, ITEMS, LENGTHS, POSTINGS
from .sources import files
from .sources.store import IndexStore, read_legacy, with_lengths


@dataclass
class SearchResult:
    query: str
    total_matches: int
    elapsed_ms: float
    items: DataFrame


class SearchEngine:
    """``SearchEngine.create(spark, path)``. With a path the index is loaded from and flushed to it; as a context manager
    it is flushed at the end.

    ``k1``, ``b`` and ``scorer`` set the ranking of :meth:`search` and :meth:`search_many`, ``analyzer`` how texts and
    queries become terms. With ``save_after`` the index is flushed so many seconds after the last change. Results are
    kept for CACHED seconds and dropped by any change. Ids are strings (paths, urls); other types are cast.
    """

    #: Tag of the jobs of searches; :meth:`cancel` ends them.
    TAG = "lectio-search"
    #: Seconds that a result is kept for the same query, number and type, and how many results are kept.
    CACHED, MOST_CACHED = 300.0, 1000
    #: Results up to which ids are written into the look-up of texts; more are joined.
    LISTED = 2000

    def __init__(
        self, spark: SparkSession, path: str | None = None, k1: float = search.K1, b: float = search.B, scorer: search.Scorer | None = None,
        analyzer: Analyzer = STANDARD, save_after: float | None = None,
    ):
        self.spark, self.k1, self.b, self.scorer, self.analyzer, self.save_after = spark, k1, b, scorer, analyzer, save_after
        self.store = IndexStore(spark, path) if path else None
        self._timer: threading.Timer | None = None
        self._lock = threading.RLock()
        self._empty()
        if self.store:
            self.load()

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, **options) -> SearchEngine:
        return cls(spark, path, **options)

    def __enter__(self) -> SearchEngine:
        return self

    def __exit__(self, *_) -> None:
        self.flush()

    def _empty(self) -> None:
        self.docs = self.spark.createDataFrame([], DOCS)
        self.postings = self.spark.createDataFrame([], POSTINGS)
        self.lengths = self.spark.createDataFrame([], LENGTHS)
        self._numbers: tuple[int, float] | None = (0, 0.0)
        self._results: dict[tuple, tuple[float, SearchResult]] = {}

    def clear(self) -> None:
        with self._lock:
            self._empty()
            self._changed((0, 0.0))

    def _changed(self, numbers: tuple[int, float] | None = None) -> None:
        """Drops kept results, and starts the time to the next save anew."""
        self._numbers = numbers
        self._results.clear()
        if self.store and self.save_after is not None:
            if self._timer:
                self._timer.cancel()
            self._timer = threading.Timer(self.save_after, self.flush)
            self._timer.daemon = True
            self._timer.start()

    def load(self) -> bool:
        held = self.store.load() if self.store else None
        if held:
            self.docs, self.postings, self.lengths = held["docs"], held["postings"], held["lengths"]
            self._numbers = self.store.stats()
            self._results.clear()
        return bool(held)

    @property
    def numbers(self) -> tuple[int, float]:
        """(documents, average length); known from the store, or counted once after a change."""
        if self._numbers is None:
            r = self.lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl")).first()
            self._numbers = (r.n, r.avgdl)
        return self._numbers

    @property
    def stats(self) -> DataFrame:
        return self.spark.createDataFrame([self.numbers], "n long, avgdl double")

    def index(self, docs: DataFrame) -> None:
        """Adds or replaces documents (doc_id, content and any of title, url, path, content_type, last_indexed_at); of
        several rows of one id the last counts."""
        full = index.documents(docs, DOCS)
        lengths = index.doc_lengths(full, self.analyzer)
        self._add(full, with_lengths(index.build_postings(full, self.analyzer), lengths), lengths)

    def _add(self, docs: DataFrame, postings: DataFrame, lengths: DataFrame) -> None:
        with self._lock:
            self._without(docs)
            self.docs = self.docs.unionByName(docs)
            self.postings = self.postings.unionByName(postings.select(*self.postings.columns))
            self.lengths = self.lengths.unionByName(lengths)
            self._changed()

    def index_files(self, path: str, title: str | None = None) -> None:
        """Indexes the text files of ``path`` under their paths; a title is for a single file."""
        docs = files.read_files(self.spark, path)
        self.index(docs if title is None else docs.withColumn("title", F.lit(title)))

    def index_url(self, pages: DataFrame, url: str, title: str | None = None) -> bool:
        """Indexes the fetched page of ``url``; false where ``pages`` hold no text of it."""
        page = files.index_url(pages, url, title)
        if page.isEmpty():
            return False
        self.index(page)
        return True

    def merge(self, tables: dict[str, DataFrame]) -> None:
        """Adds a whole index (docs, postings, lengths), as of a store or of :func:`read_legacy`, without analysing texts
        again; its documents replace those of the same id."""
        kinds = dict(x.split(" ") for x in DOCS.split(", "))
        docs = tables["docs"].select(*((F.col(c) if c in tables["docs"].columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
        lengths = tables["lengths"].select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_len").cast("int").alias("doc_len"))
        postings = tables["postings"].withColumn("doc_id", F.col("doc_id").cast("string"))
        self._add(docs, with_lengths(postings, lengths), lengths)

    def load_legacy(self, folder: str) -> bool:
        """Merges an index in the older JSON files; false where one is missing."""
        tables = read_legacy(self.spark, folder)
        if tables:
            self.merge(tables)
        return tables is not None

    def remove(self, ids: DataFrame) -> None:
        with self._lock:
            self._without(ids)
            self._changed()

    def _without(self, ids: DataFrame) -> None:
        gone = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        self.docs, self.postings, self.lengths = (t.join(gone, "doc_id", "left_anti").select(*t.columns) for t in (self.docs, self.postings, self.lengths))

    def flush(self) -> None:
        """Saves a version and goes on from its tables, which also ends the lineage of the changes."""
        with self._lock:
            if self._timer:
                self._timer.cancel()
                self._timer = None
            if self.store:
                self.store.save({"docs": self.docs, "postings": self.postings, "lengths": self.lengths})
                self.load()

    def search(self, query: str, top_n: int = 10, content_type: str | None = None, skip: int = 0) -> SearchResult:
        """Ranked items of a query. One job reads the postings of the query's terms and gives the number of matches and the
        best ids; a second one looks the texts of these ids up."""
        began = time.time()
        key = (query.strip().lower() if query else "", top_n, content_type, skip)
        kept = self._results.get(key)
        if kept and kept[0] > began:
            return kept[1]
        parsed = parse(query, self.analyzer.query)
        if parsed.is_empty:
            return SearchResult(query, 0, 0.0, self.spark.createDataFrame([], ITEMS))
        self.spark.addTag(self.TAG)
        try:
            total, items = self._found(parsed, top_n, content_type, skip)
        finally:
            self.spark.removeTag(self.TAG)
        result = SearchResult(query, total, (time.time() - began) * 1000, items)
        if len(self._results) >= self.MOST_CACHED:
            self._results.clear()
        self._results[key] = (time.time() + self.CACHED, result)
        return result

    def _found(self, parsed: ParsedQuery, top_n: int, content_type: str | None, skip: int) -> tuple[int, DataFrame]:
        ranked = search.scored(self.postings, self.lengths, self.numbers, parsed, self.k1, self.b, self.scorer)
        if content_type:
            ranked = ranked.join(self.docs.where(F.col("content_type") == content_type).select("doc_id"), "doc_id", "left_semi")
        if top_n <= 0:
            return ranked.count(), self.spark.createDataFrame([], ITEMS)
        if top_n + max(skip, 0) > self.LISTED:
            return ranked.count(), search.items(search.top(ranked, top_n, skip), self.docs, parsed)
        seen = Observation()
        best = search.top(ranked.observe(seen, F.count(F.lit(1)).alias("total")), top_n, skip).collect()
        if not best:
            return seen.get.get("total", 0), self.spark.createDataFrame([], ITEMS)
        held = self.docs.where(F.col("doc_id").isin(*(r.doc_id for r in best)))
        texts = {r.doc_id: r for r in search.shown(held, parsed).collect()}
        rows = [texts[r.doc_id].asDict() | {"rank": r["rank"], "score": r.score} for r in best if r.doc_id in texts]
        return seen.get["total"], self._table(rows)

    def _table(self, rows: list[dict]) -> DataFrame:
        """Items as a table that is read without a job."""
        import pyarrow as pa

        kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        columns = dict(x.split(" ") for x in ITEMS.split(", "))
        held = pa.table({c: pa.array([r[c] for r in rows], kinds[k]) for c, k in columns.items()})
        return self.spark.createDataFrame(held, ITEMS)

    def cancel(self) -> None:
        """Ends running searches of this session."""
        self.spark.interruptTag(self.TAG)

    def search_many(self, queries: list[tuple[int, str, int]]) -> DataFrame:
        return search.batch(self.postings, self.lengths, self.numbers, queries, self.k1, self.b, self.scorer, self.analyzer.query)

    def live_search(self, query: str, discovery: DataFrame, pages: DataFrame, top_n: int = 10) -> SearchResult:
        """Ranks the pages of the first hits of a discovery (pos, url, title, snippet) among themselves."""
        began = time.time()
        hits = live.dedupe(discovery, live.DISCOVERED)
        found = live.fetched(hits, pages)
        total = found.count() if query and not query.isspace() else 0
        out = live.top_items(live.ranked(found, query), query, top_n) if total else live.fallback_items(hits, top_n if query and not query.isspace() else 0)
        return SearchResult(query, total or out.count(), (time.time() - began) * 1000, out)

    def crawl(
        self, pages: DataFrame, links: DataFrame, seed: str, max_pages: int = 10, max_depth: int = 2, same_domain: bool = True,
        progress: Callable[[int, int, str], None] | None = None,
    ) -> DataFrame:
        """Crawls the snapshot and indexes what was read under its address; a row for each visited page comes back (see
        :func:`crawl.page_report`)."""
        options = crawl.CrawlOptions(seed, crawl.clamp(max_pages, crawl.MAX_PAGES), same_domain, crawl.clamp(max_depth, crawl.MAX_DEPTH))
        visited = crawl.crawl(pages, links, options, progress)
        read = pages.join(visited.where("success").select("url"), "url", "left_semi").where("success").where(F.trim(F.coalesce("text_content", F.lit(""))) != "")
        last = read.groupBy("url").agg(F.min_by(F.struct("title", "text_content"), "page_id").alias("p"))
        title = F.when(F.trim(F.coalesce("p.title", F.lit(""))) != "", F.col("p.title")).otherwise(F.col("url"))
        self.index(last.select(F.col("url").alias("doc_id"), title.alias("title"), "url", F.lit("Html").alias("content_type"), F.col("p.text_content").alias("content")))
        return crawl.page_report(pages, visited)
