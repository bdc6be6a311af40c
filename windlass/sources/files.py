"""File sources and sinks (SRC-3, SNK-3/4/5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_orders_files(spark: SparkSession, path: str, streaming: bool = True,
                      max_files: int | None = None) -> DataFrame:
    """SRC-3: newline-delimited JSON orders (one record per line), as a
    ``value`` column shaped like the Kafka source so the same parser runs.
    Streaming reads pick files up in modification-time order; ``max_files``
    bounds a micro-batch (also under availableNow) when catching up on a
    large backlog."""
    if streaming:
        r = spark.readStream.format("text")
        if max_files:
            r = r.option("maxFilesPerTrigger", int(max_files))
        df = r.load(path)
    else:
        df = spark.read.text(path)
    return df.select(F.col("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write a ``value`` (string/binary) column as newline-delimited text."""
    df.select(F.col("value").cast("string")).write.mode(mode).text(path)


def write_log_lines(lines: DataFrame, path: str, checkpoint: str | None = None):
    """SNK-4: one formatted line per row, batch or streaming (text files)."""
    out = lines.select(F.col("line").alias("value"))
    if out.isStreaming:
        return (out.writeStream.format("text").option("path", path)
                .option("checkpointLocation", checkpoint).outputMode("append").start())
    out.write.mode("append").text(path)
    return None


def write_report_csv(report: DataFrame, path: str) -> None:
    """SNK-5: append report rows as CSV with a header.  The report is one
    row, so the write is a single small file."""
    report.coalesce(1).write.mode("append").option("header", True).csv(path)


def collect_stream(df: DataFrame, output: str, checkpoint: str) -> DataFrame:
    """SNK-3: run a streaming frame to a parquet sink (availableNow) and read
    the result back -- the restartable equivalent of an in-memory sink."""
    from ..streaming.jobs import run_available_now
    run_available_now(df, output, checkpoint)
    return df.sparkSession.read.parquet(output)
