"""Incremental indexing with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import STANDARD, Analyzer
from ..operators import index
from ..schemas import DOCS
from ..sources.store import IndexStore


def apply_changes(store: IndexStore, changes: DataFrame, analyzer: Analyzer = STANDARD) -> None:
    """One batch of changes (doc_id, content, op = upsert or remove, seq, and any other column of a document): the last of
    each document counts. Only changed documents are analysed and written, as a segment of the store; the version before
    stays readable until the pointer moves. A batch without rows changes nothing."""
    if changes.isEmpty():
        return
    last = changes.groupBy("doc_id").agg(F.max(F.struct("seq", "op", *(c for c in changes.columns if c not in ("doc_id", "seq", "op")))).alias("c")).select("doc_id", "c.*")
    ups = index.documents(last.where("op = 'upsert'").drop("seq", "op"), DOCS)
    ids = last.select(F.col("doc_id").cast("string").alias("doc_id"))
    store.append({"docs": ups, "postings": index.build_postings(ups, analyzer), "lengths": index.doc_lengths(ups, analyzer)}, ids)


def start(changes: DataFrame, store: IndexStore, checkpoint: str, available_now: bool = True, analyzer: Analyzer = STANDARD):
    """Starts the stream of ``changes`` into ``store``; a batch that is run again gives the same version content."""
    writer = changes.writeStream.foreachBatch(lambda batch, _: apply_changes(store, batch, analyzer)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()
