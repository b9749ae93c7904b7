"""Titles, visible text and links of HTML: a native chain for regular pages, and a parser for any page."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls

# Elements whose text is not visible content.
SKIPPED = ("script", "style", "noscript", "svg", "path", "iframe", "nav", "footer", "header")
#: Named entities of the native chain, from the standard library's table of HTML 4.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


#: The rest of a tag before its end, whose quoted values may hold one; without a way back, so linear.
_REST = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
#: White space of any script.
_SPACE = r"[\s\x85\p{Z}]"


#: The entities that nearly all pages get by with; the ampersand comes last.
_COMMON = ("lt", "gt", "quot", "#39", "nbsp", "copy", "middot", "amp")
_OTHER = rf"&(?!(?:{'|'.join(_COMMON)});)(?:#[0-9xX]|[A-Za-z])[0-9A-Za-z]*;"


def decode(text: Column) -> Column:
    """``text`` with its entities, named and numbered, as characters, once; what is no entity stays. Only texts with others
    than the common ones are taken apart."""
    plain = text
    for name in _COMMON:
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(ENTITIES.get(name, "'")))
    return F.when(text.rlike(_OTHER), _decode_any(text)).otherwise(plain)


def _decode_any(text: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    common = ("amp", "lt", "gt", "quot")

    def piece(p: Column, i: Column, name: Column) -> Column:
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10).cast("int")).when(name.startswith("#"), F.substring(name, 2, 7).cast("int"))
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        known = functools.reduce(lambda out, n: out.when(name == n, F.lit(ENTITIES[n])), common[1:], F.when(name == common[0], F.lit("&"))).otherwise(names[name])
        char = F.when(number.isNull(), known).when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        after = F.transform(F.array(char), lambda c: F.when(c.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(c, F.substr(p, F.length(name) + 2))))[0]
        return F.when(i == 0, p).otherwise(after)

    def cut(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        return F.transform(F.array(name), lambda n: piece(p, i, n))[0]

    return F.array_join(F.transform(F.split(text, "&"), cut), "")


def title(html: Column) -> Column:
    """The trimmed text of the first title element even if empty; only without one the first h1; else ""."""
    first = F.trim(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    h1 = F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "(?s)<[^>]*>", "")
    return F.when(html.rlike(r"(?is)<title[^>]*>"), first).otherwise(F.trim(decode(h1)))


def text(html: Column) -> Column:
    """Visible text: nodes joined by a space, two and more white spaces as one space, trimmed."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>", " ")
    for tag in SKIPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, rf"""(?s)</?[A-Za-z!]{_REST}>|<[^>]*>""", " ")
    return F.regexp_replace(F.regexp_replace(decode(t), f"{_SPACE}{{2,}}", " "), f"^{_SPACE}+|{_SPACE}+$", "")


def links(html: Column, base: Column) -> Column:
    """Absolute targets of all anchors in order, with repeats."""
    anchors = F.regexp_extract_all(html, F.lit(rf"""(?i)<a\s{_REST}>"""), 0)
    value = lambda a: F.regexp_extract(a, r"""(?is)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    hrefs = F.transform(anchors, lambda a: F.regexp_replace(value(a), r"""^["']|["']$""", ""))
    decoded = F.transform(F.filter(hrefs, lambda h: h != ""), decode)  # apart, as the address is looked at many times
    return F.filter(F.transform(decoded, lambda h: urls.resolve(base, h)), lambda u: u.isNotNull())


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages with title, text and links in one projection."""
    h = F.col(html)
    return pages.select("*", title(h).alias("page_title"), text(h).alias("page_text"), links(h, F.col(url)).alias("page_links")).drop(html)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden = 0
        self.stack: list[str] = []
        self.title: list[str] | None = None
        self.h1: list[str] | None = None
        self.inside: str | None = None
        self.nodes: list[str] = []
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED or tag == "head":
            self.hidden += 1
            self.stack.append(tag)
        if tag == "title" and self.title is None:
            self.title, self.inside = [], "title"
        elif tag == "h1" and self.h1 is None:
            self.h1, self.inside = [], "h1"
        if tag == "a":
            self.hrefs += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack:
                self.hidden -= 1
                if self.stack.pop() == tag:
                    break
        if tag == self.inside:
            self.inside = None

    def handle_data(self, data):
        if self.inside == "title":
            self.title.append(data)
            return
        if self.inside == "h1":
            self.h1.append(data)
        if not self.hidden and data.strip():
            self.nodes.append(data)


def parse(source: str) -> tuple[str, str, list[str]]:
    """(title, text, hrefs) of any HTML, however irregular."""
    r = _Reader()
    r.feed(source)
    r.close()
    name = "".join(r.title).strip() if r.title is not None else "".join(r.h1 or []).strip()
    return name, re.sub(r"\s{2,}", " ", " ".join(r.nodes)).strip(), r.hrefs


def extract_any(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """The general form of :func:`extract` for irregular pages: a parser in Arrow batches; links resolve natively."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            done = [parse(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string()))))],
                [key, "url", "page_title", "page_text", "hrefs"],
            )

    out = pages.select(key, F.col(url).alias("url"), html).mapInArrow(run, f"`{key}` {kind}, url string, page_title string, page_text string, hrefs array<string>")
    resolved = F.filter(F.transform("hrefs", lambda h: urls.resolve(F.col("url"), h)), lambda u: u.isNotNull())
    return out.select(key, "url", "page_title", "page_text", resolved.alias("page_links"))
