"""Pages over HTTP, for sessions with a network: a bounded number of parallel fetches, each with its own time limit."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as markup

PARALLEL, TIMEOUT, REDIRECTS = 8, 10.0, 5
SCHEMA = "url string, title string, text_content string, hrefs array<string>, success boolean, error string"


def fetch_one(url: str, timeout: float = TIMEOUT, agent: str = "lectio") -> tuple[str, str | None, str | None, list[str], bool, str | None]:
    """One page as a row of SCHEMA; no failure raises."""
    import http.client
    import socket
    import urllib.error
    import urllib.request

    class Few(urllib.request.HTTPRedirectHandler):
        max_redirections = REDIRECTS

    try:
        request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "text/html"})
        with urllib.request.build_opener(Few).open(request, timeout=timeout) as r:
            media = r.headers.get_content_type() or ""
            if "html" not in media.lower() and "text" not in media.lower():
                return url, None, None, [], False, f"Non-HTML content type: {media}"
            body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return url, None, None, [], False, f"HTTP {e.code} {e.reason}"
    except (TimeoutError, socket.timeout):
        return url, None, None, [], False, "Page fetch timed out"
    except (urllib.error.URLError, http.client.HTTPException, ValueError, OSError) as e:
        late = isinstance(getattr(e, "reason", None), TimeoutError)
        return url, None, None, [], False, "Page fetch timed out" if late else str(getattr(e, "reason", e))
    title, text, hrefs = markup.parse(body)
    return url, title, text, hrefs, True, None


def fetch(addresses: DataFrame, parallel: int = PARALLEL, timeout: float = TIMEOUT, delay: float = 0.0) -> DataFrame:
    """Pages of ``addresses`` (url), fetched by at most ``parallel`` tasks; apply the robots gate first."""

    def run(batches: Iterator) -> Iterator:
        import time

        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string())
        for batch in batches:
            for url in batch.column(0).to_pylist():
                row = fetch_one(url, timeout)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])
                time.sleep(delay)

    from ..functions import urls

    pages = addresses.select("url").where(F.col("url").isNotNull()).distinct().repartition(parallel).mapInArrow(run, SCHEMA)
    links = F.filter(F.transform("hrefs", lambda h: urls.resolve(F.col("url"), h)), lambda u: u.isNotNull())
    return pages.select("url", "title", "text_content", links.alias("out_links"), "success", "error")
