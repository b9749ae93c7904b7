"""Result pages of a web search engine as discovery hits, and the form that leads to the next page."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import parse_qs, quote, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def real_url(href: str) -> str:
    """The target of a redirect link, or an absolute web address as it is, else ""."""
    found = parse_qs(urlsplit(href).query.replace("+", "%2B")).get("uddg")
    if found:
        return unquote(found[0]) if "%" in found[0] else found[0]
    return href if href.lower().startswith(("http://", "https://")) else ""


class _Results(HTMLParser):
    """Collects result blocks with their link and snippet, and forms with their fields."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = 0
        self.blocks: list[dict] = []
        self.open: list[tuple[int, dict]] = []
        self.into: tuple[int, list[str]] | None = None
        self.forms: list[dict] = []
        self.form: dict | None = None

    _VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        css = a.get("class", "")
        if tag == "form":
            self.form = {"class": css, "fields": [], "next": False}
            self.forms.append(self.form)
        if tag == "input" and self.form is not None:
            if a.get("value") == "Next":
                self.form["next"] = True
            if a.get("name"):
                self.form["fields"].append((a["name"], a.get("value", "")))
        if tag in self._VOID:
            return
        self.depth += 1
        inside = self.open and "result__body" in self.open[-1][1]["class"]
        if tag == "div" and "result" in css and "result__snippet" not in css and not inside:
            block = {"class": css, "href": "", "any": "", "title": [], "snippet": []}
            self.blocks.append(block)
            self.open.append((self.depth, block))
        if self.open:
            block = self.open[-1][1]
            if tag == "a" and a.get("href"):
                if "result__a" in css and not block["href"]:
                    block["href"] = a["href"]
                    self.into = (self.depth, block["title"])
                elif not block["any"]:
                    block["any"] = a["href"]
                    if not block["href"]:
                        self.into = (self.depth, block["title"])
            if tag in ("a", "div") and "result__snippet" in css:
                self.into = (self.depth, block["snippet"])

    def handle_endtag(self, tag):
        if tag == "form":
            self.form = None
        if tag in self._VOID:
            return
        if self.into and self.into[0] == self.depth:
            self.into = None
        if self.open and self.open[-1][0] == self.depth:
            self.open.pop()
        self.depth -= 1

    def handle_data(self, data):
        if self.into:
            self.into[1].append(data)


def parse_page(html: str) -> tuple[list[tuple[str, str, str]], str | None]:
    """([(url, title, snippet)], form data of the next page or null)."""
    r = _Results()
    r.feed(html)
    r.close()
    bodies = [b for b in r.blocks if "result__body" in b["class"]] or r.blocks
    hits = []
    for b in bodies:
        url = real_url(b["href"] or b["any"])
        if url:
            hits.append((url, " ".join("".join(b["title"]).split()), " ".join("".join(b["snippet"]).split())))
    forms = [f for f in r.forms if "nav-link" in f["class"]] or [f for f in r.forms if f["next"]]
    data = "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in forms[-1]["fields"]) if forms else None
    return hits, data


def discover(pages: DataFrame, html: str = "html", order: str = "page", limit: int = 50) -> DataFrame:
    """(pos, url, title, snippet) of stored result pages in order; the first of equal addresses stays, up to ``limit``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p, i, *hit) for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, hit in enumerate(parse_page(h or "")[0])]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c) for c in cols[2:])], ["page", "i", "url", "title", "snippet"]
                )

    hits = pages.select(F.col(order).cast("int"), html).mapInArrow(run, "page int, i int, url string, title string, snippet string")
    first = hits.groupBy(F.lower("url").alias("k")).agg(F.min(F.struct("page", "i", "url", "title", "snippet")).alias("h")).select("h.*")
    ranked = first.orderBy("page", "i").limit(limit)
    from pyspark.sql import Window

    return ranked.select((F.row_number().over(Window.orderBy("page", "i")) - 1).alias("pos"), "url", "title", "snippet")
