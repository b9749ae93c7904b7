"""Breadth-first crawl over a snapshot of pages and their links."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.tables import cut

MAX_PAGES, MAX_DEPTH = (1, 50), (0, 3)


def clamp(value: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], value))


@dataclass(frozen=True)
class CrawlOptions:
    seed: str
    max_pages: int = 20
    same_domain: bool = True
    max_depth: int = 2


def crawl(pages: DataFrame, links: DataFrame, options: CrawlOptions, progress: Callable[[int, int, str], None] | None = None) -> DataFrame:
    """(ord, url, depth, success): the pages a polite crawler visits, in order.

    First in, first out; failed fetches count as pages; nothing is queued once pages and queue reach twice ``max_pages``;
    an address is visited once, letter case aside. Each level looks its pages and links up in one query; frontiers are at
    most twice ``max_pages`` addresses, so the queue itself lives on the driver. ``progress`` is told (pages visited, pages
    queued, address) before each page.
    """
    spark = pages.sparkSession
    seed = options.seed if options.seed.lower().startswith(("http://", "https://")) else f"https://{options.seed}"
    seed = seed.rstrip("/")
    home = (urlsplit(options.seed).hostname or "").lower()  # none for a seed without a scheme: it is held to no domain
    bound = 2 * options.max_pages
    queue: list[tuple[str, int]] = [(seed, 0)]
    seen: set[str] = set()
    out: list[tuple[int, str, int, bool]] = []
    while queue and len(out) < options.max_pages:
        level, depth = [u for u, d in queue if d == queue[0][1]], queue[0][1]
        later = [(u, d) for u, d in queue if d != depth]
        near = list({v for u in level for v in (u, u + "/")})
        ok = {r.url: r.ok for r in pages.where(F.col("url").isin(*near)).groupBy("url").agg(F.max("success").alias("ok")).collect()}
        follow: dict[str, list[str]] = {}
        if depth < options.max_depth:
            key = F.lower("dst")
            own = links.where(F.col("src").isin(*near)).select("src", "ordinal", "dst").distinct().where(~key.isin(*seen) if seen else F.lit(True))
            if options.same_domain and home:
                own = own.where(urls.host(F.col("dst")) == home)
            # of what may still be queued, no page needs more than ``bound``; links to this level are visited by and by
            first = Window.partitionBy("src", F.when(key.isin(*{u.lower() for u in level}), key)).orderBy("ordinal", "dst")
            rows = own.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= bound).select("src", "ordinal", "dst").collect()
            for r in sorted(rows, key=lambda r: (r.ordinal, r.dst)):
                follow.setdefault(r.src, []).append(r.dst)
        queue = later
        for i, url in enumerate(level):
            if len(out) >= options.max_pages:
                break
            if url.lower() in seen:
                continue
            seen.add(url.lower())
            if progress:
                progress(len(out), len(queue) + len(level) - i - 1, url)
            success = bool(ok.get(url, ok.get(url + "/", False)))
            out.append((len(out), url, depth, success))
            if success and depth < options.max_depth:
                for dst in follow.get(url, follow.get(url + "/", [])):
                    if len(out) + len(queue) + (len(level) - i - 1) >= bound:
                        break
                    if dst.lower() not in seen:
                        queue.append((dst, depth + 1))
    return spark.createDataFrame(out, "ord int, url string, depth int, success boolean")


def depths(links: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """(url, depth): the least number of links from any of ``seeds`` (url) within one host, for whole graphs: one join and
    one anti-join a level, each level written so that lineage stays short. Repeated edges count once."""
    edges = links.select("src", "dst").where(urls.host(F.col("src")) == urls.host(F.col("dst"))).distinct()
    reached = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for d in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = cut(step.join(reached, "url", "left_anti").withColumn("depth", F.lit(d)))
        reached = reached.unionByName(frontier)
    return reached


def page_report(pages: DataFrame, visited: DataFrame) -> DataFrame:
    """(ord, url, title, success, error, content_length): what became of each visited page, in order; of several fetches of
    an address the one with the greatest page_id counts, and a page that was never fetched failed."""
    key = F.regexp_replace("url", "/$", "")
    last = pages.groupBy(key.alias("_url")).agg(F.max_by(F.struct("title", "error", F.length(F.coalesce("text_content", F.lit(""))).alias("n")), "page_id").alias("p"))
    joined = visited.withColumn("_url", key).join(last, "_url", "left")
    return joined.select("ord", "url", F.col("p.title").alias("title"), "success", F.col("p.error").alias("error"), F.coalesce("p.n", F.lit(0)).alias("content_length"))


def report(pages: DataFrame) -> DataFrame:
    """One row: how many pages succeeded and failed, and the length of what was read."""
    ok = F.coalesce("success", F.lit(False))
    return pages.agg(
        F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.length("text_content")), F.lit(0)).alias("content_length")
    )
