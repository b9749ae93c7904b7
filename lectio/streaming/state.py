"""State over logs of events: flushes after a pause, a cache with a fixed life, and recent history."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Pauses in a stretch of the time line that is looked at by itself.
STRETCH = 1800


def flush_times(mutations: DataFrame, pause: int = 2, ts: str = "ts") -> DataFrame:
    """(flush_at, mutations): a save happens ``pause`` seconds after the last change of a burst. A stream with a watermark
    takes session windows. A table is cut into stretches of STRETCH pauses whose bursts are found apart; only the first and
    the last burst of each stretch can go on beyond it, so these few are put in order at the end."""
    if mutations.isStreaming:
        burst = F.session_window(ts, f"{pause} seconds")
        return mutations.groupBy(burst).agg(F.count("*").alias("mutations")).select(F.col("session_window.end").alias("flush_at"), "mutations")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = pause * 1_000_000
    events = mutations.where(F.col(ts).isNotNull()).groupBy(at.alias("at")).agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("at") / (STRETCH * gap)))
    inside = Window.partitionBy("stretch").orderBy("at")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(inside) >= gap, F.lit(True)).cast("int")
    bursts = (
        events.withColumn("fresh", fresh)
        .withColumn("burst", F.sum("fresh").over(inside))
        .groupBy("stretch", "burst")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("n").alias("n"))
        .withColumn("bursts", F.max("burst").over(Window.partitionBy("stretch")))
    )
    edge = (F.col("burst") == 1) | (F.col("burst") == F.col("bursts"))
    order = Window.orderBy("first")
    ends = bursts.where(edge).withColumn("fresh", F.coalesce(F.col("first") - F.lag("last").over(order) >= gap, F.lit(True)).cast("int"))
    joined = ends.withColumn("g", F.sum("fresh").over(order)).groupBy("g").agg(F.max("last").alias("last"), F.sum("n").alias("n")).drop("g")
    return bursts.where(~edge).select("last", "n").unionByName(joined).select(F.timestamp_micros(F.col("last") + gap).cast(mutations.schema[ts].dataType).alias("flush_at"), F.col("n").alias("mutations"))


def cache_hits(lookups: DataFrame, key: str = "key", ts: str = "ts", seconds: int = 300) -> DataFrame:
    """``lookups`` (key, ts) with ``hit``: a miss stores a result for ``seconds``; a hit does not prolong it.

    Each key's lookups are brought into one partition in time order and read once with a state of one timestamp, so a key
    of any size needs constant memory. Lookups at one instant: the first may miss, the rest hit.
    """
    kinds = {c: lookups.schema[c].dataType.simpleString() for c in (key, ts)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, until = None, None
        life = seconds * 1_000_000
        for batch in batches:
            hits = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist()):
                if k != last:
                    last, until = k, None
                hit = until is not None and t < until
                if not hit:
                    until = t + life
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits)], [key, ts, "hit"])

    rows = lookups.select(key, ts).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, ts).mapInArrow(run, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, hit boolean")


def recent(log: DataFrame, per: str = "user_id", most: int = 20) -> DataFrame:
    """(per, rank, query, ts): the latest ``most`` distinct queries of each user, letter case aside, in the last spelling;
    null users are one group. The latest of each query is kept before the rank, so a busy user's log is not gathered."""
    named = log.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    last = named.groupBy(per, F.lower("query").alias("folded")).agg(F.max(F.struct("ts", "query")).alias("l"))
    order = Window.partitionBy(per).orderBy(F.desc("l.ts"), "folded")
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(per, "rank", F.col("l.query").alias("query"), F.col("l.ts").alias("ts"))
