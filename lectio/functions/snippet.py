"""Snippets: the best window of a text for given stems, cut at words, with marks around the hits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, STEP, REACH = 280, 40, 30
OPEN, CLOSE = "<mark>", "</mark>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _counts(pieces: Column, stem: str) -> Column:
    """How many hits of ``stem``, overlapping ones too, begin in each piece of STEP characters: a piece is read on by the
    letters that a hit at its end needs, so the whole text is read once."""
    n = len(stem) - 1
    ahead = -(-n // STEP)
    follows = lambda i: F.left(F.array_join(F.slice(pieces, i + 2, ahead), ""), F.lit(n)) if n else F.lit("")
    return F.transform(pieces, lambda p, i: F.regexp_count(F.concat(p, follows(i)), F.lit(f"(?={re.escape(stem)})")))


def window_start(text: Column, stems: Sequence[str]) -> Column:
    """Start (from 0) of the first best window: distinct stems count 1000, hits 1; null where nothing hits. Hits may
    overlap; a stem given twice counts as two. Windows begin at every STEP characters and are sums over the counts of the
    pieces that they hold, so the work is linear in the text."""
    span = WINDOW // STEP

    def best(counts: Column) -> Column:
        def worth(_: Column, i: Column) -> Column:
            held = F.transform(counts, lambda c: F.aggregate(F.slice(c, i + 1, span), F.lit(0), lambda x, y: x + y))
            return F.aggregate(held, F.lit(0), lambda total, c: total + c + F.when(c > 0, 1000).otherwise(0))

        def first(s: Column) -> Column:
            return F.when(F.array_max(s) > 0, (F.array_position(s, F.array_max(s)) - 1).cast("int") * STEP)

        return _let(F.transform(counts[0], worth), first)

    pieces = F.regexp_extract_all(F.lower(text), F.lit(f"(?s).{{1,{STEP}}}"), 0)
    return _let(pieces, lambda p: _let(F.array(*(_counts(p, t) for t in stems)), best))


def cut(text: Column, start: Column) -> Column:
    """The window from ``start`` as text with ellipses, cut at spaces: a start inside a word moves past the next space
    within REACH characters; an end inside the text moves back to a space within REACH characters."""
    n = F.length(text)
    end = F.least(n, start + WINDOW)
    ahead = F.instr(F.substring(text, start + 1, F.lit(REACH)), " ")
    first = F.when((start > 0) & (ahead > 0), start + ahead).otherwise(start)
    tail_from = end - F.least(end, F.lit(REACH))
    tail = F.substring(text, tail_from + 1, F.least(end, F.lit(REACH)))
    back = F.instr(F.reverse(tail), " ")
    space = tail_from + F.length(tail) - back
    last = F.when((end < n) & (back > 0) & (space > first), space).otherwise(end)
    return F.struct(first.alias("first"), last.alias("last"), n.alias("n"))


def escaped(text: Column) -> Column:
    """Text that a browser shows as it is."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def highlight(text: Column, stems: Sequence[str]) -> Column:
    """``text`` with marks around each hit of a stem and the rest of its word; hits may start inside a word."""
    if not stems:
        return text
    parts = "|".join(f"{re.escape(t)}\\w*" for t in dict.fromkeys(stems))
    return F.regexp_replace(text, f"(?iU)({parts})", f"{OPEN}$1{CLOSE}")


def prefix(text: Column) -> Column:
    """The first WINDOW characters, with dots where more follows."""
    return F.when(F.length(text) > WINDOW, F.concat(F.left(text, F.lit(WINDOW)), F.lit("..."))).otherwise(text)


def snippet(text: Column, stems: Sequence[str]) -> Column:
    """The highlighted best window of ``text``, or its beginning where nothing hits."""
    if not stems:
        return prefix(text)

    def shown(start: Column) -> Column:
        def build(c: Column) -> Column:
            body = highlight(F.substring(text, c["first"] + 1, c["last"] - c["first"]), stems)
            return F.concat(F.when(c["first"] > 0, "...").otherwise(""), body, F.when(c["last"] < c["n"], "...").otherwise(""))

        return F.when(start.isNull() | (F.trim(text) == ""), prefix(text)).otherwise(_let(cut(text, start), build))

    return _let(window_start(text, stems), shown)
