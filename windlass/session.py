"""Session settings the engine relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of this library assumes.  Applied on top of whatever the
# cluster already configured; nothing here sizes executors.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Drop late rows against the watermark of the batch that just ended,
    # not the one before it (reference drops late orders at arrival).
    "spark.sql.streaming.statefulOperator.allowMultiple": "false",
    # A session shuffle carries merged sessions, not raw rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Window state (incl. per-window customer sets) lives off-heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


# Without these the results change, not just the speed.
REQUIRED = ("spark.sql.streaming.statefulOperator.allowMultiple", "spark.sql.session.timeZone")


def configure(spark: SparkSession) -> SparkSession:
    """Apply ENGINE_CONF to an existing session.  A key the session refuses is
    skipped, except those of REQUIRED, which must then hold the value already."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:
            if k in REQUIRED and spark.conf.get(k, None) != v:
                raise
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "windlass") -> SparkSession:
    """Session for tests and the local bench.  On a cluster, build the session
    with the cluster's own settings and call :func:`configure` instead."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def _shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, as a URI.  Only a ``local``
    master may go without one (a private folder is made then): on a cluster
    a machine-local folder would hide files from the other executors."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all "
                           f"executors share (master {sc.master})")
    base = "file://" + tempfile.mkdtemp(prefix="windlass-")
    sc.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    Streaming checkpoints, stream outputs and materialised intermediates go
    here so that any executor (and a restarted driver) can reach them.  The
    location comes from ``spark.checkpoint.dir``, scheme included.
    """
    base = _shared_base(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/windlass/{name}-{uuid.uuid4().hex[:12]}"
