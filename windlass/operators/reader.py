"""Reading side of the metrics topic: log lines, running summary, dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_metrics(metrics: DataFrame) -> DataFrame:
    """FMT-1 (+SC-3): one log line per window row, revenue and average with
    two decimals (Java formatter, HALF_UP)::

        [window=<start>-<end>] category=C region=R orders=N revenue=X.XX avg=Y.YY customers=K
    """
    line = F.format_string(
        "[window=%d-%d] category=%s region=%s orders=%d revenue=%.2f avg=%.2f customers=%d",
        "windowStart", "windowEnd", F.coalesce(F.col("category"), F.lit("null")),
        F.coalesce(F.col("region"), F.lit("null")), "orderCount", "totalRevenue",
        "avgOrderValue", "uniqueCustomers")
    return metrics.select("*", line.alias("line"))


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """AGG-10: windows processed so far and the latest window end (0 when
    none).  A global aggregate with map-side partials; on a stream run it in
    ``complete`` mode."""
    return metrics.agg(
        F.count(F.lit(1)).alias("windowsProcessed"),
        F.coalesce(F.max("windowEnd"), F.lit(0).cast("long")).alias("lastWindowEnd"))


def dedupe_metrics(metrics: DataFrame, delay: str | None = None) -> DataFrame:
    """At-least-once delivery can repeat a window row; keep one per
    window x category x region.  A stream needs ``delay``: duplicates are
    tracked within it, and rows whose window ended longer before the newest
    one are dropped, duplicates or not (``StreamRun.rows_dropped_by_watermark``
    counts them), so it must cover the longest catch-up."""
    keys = ["windowStart", "category", "region"]
    if metrics.isStreaming:
        if delay is None:
            raise ValueError("dedupe_metrics on a stream needs a delay")
        cols = metrics.columns
        return (metrics.withColumn("_ws", F.timestamp_millis("windowEnd"))
                .withWatermark("_ws", delay)
                .dropDuplicatesWithinWatermark(keys).select(*cols))
    return metrics.dropDuplicates(keys)
