"""Intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_made: list[tuple] = []
_registered: list[bool] = []


def shared_dir(spark) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a local session without it gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own()


_folder: list[str] = []


def _own() -> str:
    if not _folder:
        _folder.append(tempfile.mkdtemp(prefix="lectio-"))
    return _folder[0]


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back: computed once however many steps use it, and not
    lost with an executor. Tables are deleted when the driver ends, or by :func:`clear`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectio-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _registered:
        atexit.register(clear)
        _registered.append(True)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Cells of a sieve; a cell that is hit by chance costs a row in the join that follows.
CELLS = 1 << 25


def sifted(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among that of ``wanted``: a bit map of CELLS bits (4 MB, however many are
    wanted) is sent to every task, so that few rows are left to shuffle in the exact join that must follow."""
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")
    maps = wanted.select(cell.alias("cell")).groupBy(F.expr("cell >> 6").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cell & 63)")).alias("bits")).collect()
    shared = df.sparkSession.sparkContext.broadcast(_bit_map((r["at"], r["bits"]) for r in maps))
    placed = df.withColumn("_cell", cell)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sieve = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            hit = np.nonzero(sieve[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))[0]
            if len(hit):
                yield batch.take(pa.array(hit))

    return placed.mapInArrow(run, placed.schema).drop("_cell")


def _bit_map(maps: Iterable[tuple[int, int]]) -> bytes:
    import numpy as np

    words = np.zeros(CELLS >> 6, np.int64)
    for at, bits in maps:
        words[at] = bits
    return words.tobytes()


def components(edges: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, a, label): the nodes of ``edges`` (group, a, b), each with the least node of its connected component.
    Labels go along edges and then to the label of their label, until none changes; each step is written."""
    both = written(edges.select(group, a, b).union(edges.select(group, F.col(b), F.col(a))).distinct())
    labels = written(both.groupBy(group, a).agg(F.least(F.col(a), F.min(b)).alias("label")))
    while True:
        near = both.join(labels.select(group, F.col(a).alias(b), F.col("label").alias("far")), [group, b]).groupBy(group, a).agg(F.min("far").alias("far"))
        step = labels.join(near, [group, a]).select(group, a, F.least("label", "far").alias("label"), F.col("label").alias("before"))
        jump = step.join(labels.select(group, F.col(a).alias("label"), F.col("label").alias("far")), [group, "label"], "left")
        now = written(jump.select(group, a, F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("before")).alias("changed")))
        labels = now.drop("changed")
        if now.where("changed").isEmpty():
            return labels


def clear() -> None:
    """Deletes all intermediate tables: at the end of the driver, or between queries of a long session once their results
    are written."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended
            pass
