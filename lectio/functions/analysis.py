"""Text analysis as Catalyst expressions: tokens, stop words and stems, without any Python in the plan.

``raw_tokens`` works on whole texts. ``stem`` is a chain of conditions; it is meant for the distinct vocabulary
(:func:`stem_vocabulary`), which is joined back, and keeps each step in a lambda of its own, so that the optimizer does
not copy a step's input into each of its conditions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import twin
from .rules import CVC, DOUBLE_SUFFIXES, DOUBLED_Y, LAST_SUFFIXES, M1, M2, NOUN_SUFFIXES, SEPARATORS, SINGLE, STOP_WORDS, VOWEL


def lower(text: Column) -> Column:
    """Small letters; the dotted capital I separates, as its small form is no plain letter."""
    return F.lower(F.translate(text, "İ", " "))


def raw_tokens(text: Column) -> Column:
    """Kept tokens before stemming, in order; an empty array for null."""
    parts = F.split(F.coalesce(lower(text), F.lit("")), SEPARATORS)
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _step(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda w: F.transform(F.array(w), f)[0]


def _plural(w: Column) -> Column:
    return (
        F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2))
        .when(w.endswith("ss"), w)
        .when(w.endswith("s") & (F.length(w) > 1), _cut(w, 1))
        .otherwise(w)
    )


def _past(w: Column) -> Column:
    """Strips ``ed`` and ``ing`` after a vowel; ``|`` marks a base that is still to be mended."""
    return (
        F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(M1), _cut(w, 1)).otherwise(w))
        .when(w.endswith("ed"), F.when(_cut(w, 2).rlike(VOWEL), F.concat(_cut(w, 2), F.lit("|"))).otherwise(w))
        .when(w.endswith("ing"), F.when(_cut(w, 3).rlike(VOWEL), F.concat(_cut(w, 3), F.lit("|"))).otherwise(w))
        .otherwise(w)
    )


def _mend(w: Column) -> Column:
    base = _cut(w, 1)
    last = F.right(base, F.lit(1))
    doubled = (F.length(base) > 1) & (last == F.right(_cut(base, 1), F.lit(1)))
    return (
        F.when(~w.endswith("|"), w)
        .when(base.endswith("at") | base.endswith("bl") | base.endswith("iz"), F.concat(base, F.lit("e")))
        .when(doubled & (~last.isin(*SINGLE) | base.rlike(DOUBLED_Y)), _cut(base, 1))
        .when(base.rlike(M1) & ~base.rlike(M2) & base.rlike(CVC), F.concat(base, F.lit("e")))
        .otherwise(base)
    )


def _y(w: Column) -> Column:
    return F.when(w.endswith("y") & (F.length(w) > 1) & _cut(w, 1).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _replace(table: tuple[tuple[str, str], ...]) -> Callable[[Column], Column]:
    def f(w: Column) -> Column:
        out = None
        for suffix, to in table:
            base = _cut(w, len(suffix))
            value = F.when(base.rlike(M1), F.concat(base, F.lit(to))).otherwise(w)
            out = F.when(w.endswith(suffix), value) if out is None else out.when(w.endswith(suffix), value)
        return out.otherwise(w)

    return f


def _last(w: Column) -> Column:
    out = None
    for suffix in LAST_SUFFIXES:
        base = _cut(w, len(suffix))
        hit = w.endswith(suffix) & base.rlike(M2)
        if suffix == "ion":
            hit = hit & (base.endswith("s") | base.endswith("t"))
        out = F.when(hit, base) if out is None else out.when(hit, base)
    return out.otherwise(w)


def _e(w: Column) -> Column:
    base = _cut(w, 1)
    return F.when(w.endswith("e") & (base.rlike(M2) | (base.rlike(M1) & ~base.rlike(CVC))), base).otherwise(w)


def _ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & _cut(w, 1).rlike(M2), _cut(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a token."""
    w = word
    for f in (_plural, _past, _mend, _y, _replace(DOUBLE_SUFFIXES), _replace(NOUN_SUFFIXES), _last, _e, _ll):
        w = _step(f)(w)
    return F.when(F.length(word) <= 2, word).otherwise(w)


def exploded(docs: DataFrame, key: str = "doc_id", text: str = "content", analyzer: Analyzer | None = None) -> DataFrame:
    """(key, pos, token): one row a kept token before stemming. The outer form keeps the optimizer from evaluating the
    tokens twice for an inferred filter."""
    return docs.select(key, F.posexplode_outer((analyzer.tokens if analyzer else raw_tokens)(F.col(text))).alias("pos", "token")).where("token is not null")


def stem_vocabulary(tokens: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """(token, term) of the distinct tokens: far fewer rows than tokens, so the stemmer runs once a word."""
    return tokens.select("token").distinct().withColumn("term", (analyzer.term if analyzer else stem)(F.col("token")))


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms: kept tokens of a text column, the term of a token column, and both for one query text."""

    tokens: Callable[[Column], Column]
    term: Callable[[Column], Column]
    query: Callable[[str], list[str]]


#: The analyzer of the engine unless another is given.
STANDARD = Analyzer(raw_tokens, stem, twin.tokenize)


def stemmed(docs: DataFrame, key: str = "doc_id", text: str = "content", analyzer: Analyzer = STANDARD) -> DataFrame:
    """(key, pos, term). The vocabulary joins as Spark sizes it at run time: sent whole while small, else by shuffle."""
    tokens = exploded(docs, key, text, analyzer)
    return tokens.join(stem_vocabulary(tokens, analyzer), "token").select(key, "pos", "term")


def tokenize(text: Column) -> Column:
    """Stems of one text in one expression, for few or short texts (titles, queries)."""
    return F.transform(raw_tokens(text), stem)
