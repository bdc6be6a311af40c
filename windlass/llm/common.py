"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

# Words: runs of anything but space and the five ASCII white-space controls.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of an Arrow batch: batches hold whole texts, some of them very long.
BATCH_ROWS, _BATCH = 256, "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def with_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it by
    ``sys.path`` only (on a cluster ship it with ``--py-files``), and hand
    them texts in batches of at most BATCH_ROWS rows."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, _ROOT) if x)
    return spark


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Larger Arrow batches for narrow rows, while the block runs its jobs."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    the lineage, and lost executors never make finished work run again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c):
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
