"""Results as JSON and as frames of an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the fields of a result and of its items, and the numbers of the types of sources.
RESULT = ("query", "totalMatches", "elapsedMilliseconds", "items")
ITEM = (("title", "title"), ("url", "url"), ("snippet", "snippet"), ("score", "score"), ("source_type", "sourceType"), ("is_scholarly", "isScholarly"), ("domain", "domain"))
SOURCE_TYPES = ("Pdf", "Markdown", "Html")


def as_json(items: DataFrame) -> DataFrame:
    """(rank, json): each item as one JSON object, nulls kept."""
    return items.select("rank", F.to_json(F.struct(*(c for c in items.columns)), {"ignoreNullFields": "false"}).alias("json"))


def result_json(items: DataFrame, query: str, total: int, elapsed_ms: float = 0.0, pascal: bool = False) -> DataFrame:
    """(json): a whole search result as one object, its items in order of rank. Names begin with a small letter, or with a
    capital where ``pascal`` (as in the event stream). ``items`` are the few of one result."""
    named = (lambda n: n[0].upper() + n[1:]) if pascal else (lambda n: n)
    kind = F.array_position(F.array(*(F.lit(x) for x in SOURCE_TYPES)), F.col("source_type")).cast("int") - 1
    fields = [(kind if c == "source_type" else F.col(c)).alias(named(n)) for c, n in ITEM]
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("item")))), lambda x: x["item"])
    values = (F.lit(query), F.lit(total), F.lit(float(elapsed_ms)), ordered)
    return items.agg(F.to_json(F.struct(*(v.alias(named(n)) for v, n in zip(values, RESULT))), {"ignoreNullFields": "false"}).alias("json"))


def sse_frame(phase: Column, json: Column) -> Column:
    """One frame of a server-sent event stream."""
    return F.concat(F.lit("event: "), phase, F.lit("\ndata: "), json, F.lit("\n\n"))


def health() -> str:
    return "healthy"
