"""Loading of the test tables and cutting of long lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input below which a table is dealt out over the cores before work on its texts: it is too few splits to fill them.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, over all cores where it is small. A small file often has one row group, so one task would do all the work;
    a large table has enough splits and is not shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a
    temporary folder is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lectio-")
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: used where several later stages need one result,
    so that it is neither computed twice nor lost with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
