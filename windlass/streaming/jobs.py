"""Structured Streaming jobs: the windowed-metrics job and its readers.

Every job writes to a restartable sink with a checkpoint under the
cluster's shared checkpoint folder.  ``availableNow`` runs process what is
there and stop, which is how tests, backfills and scheduled catch-up runs
use the same streaming plan.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import parse_orders, parse_metrics
from ..operators.windows import (interval_ms, merge_buckets, merge_customers, merge_fragments, order_metrics,
                                 order_metrics_buckets, order_metrics_customers, session_fragments)
from ..operators.reader import format_metrics, metrics_summary
from ..session import configure, shared_dir
from ..sources.files import read_orders_files


@dataclass
class StreamRun:
    output: str
    checkpoint: str
    progress: list = field(default_factory=list)

    def rows_dropped_by_watermark(self) -> int:
        """Rows (after partial aggregation, not orders) dropped as late."""
        n = 0
        for p in self.progress:
            for op in p.get("stateOperators", []):
                n += int(op.get("numRowsDroppedByWatermark", 0) or 0)
        return n

    def observed(self, name: str = "orders") -> dict:
        """Counters from ``DataFrame.observe`` summed over the run's batches."""
        out: dict = {}
        for p in self.progress:
            row = (p.get("observedMetrics", {}) or {}).get(name)
            if row is None:
                continue
            vals = row.asDict() if hasattr(row, "asDict") else dict(row)
            for k, v in vals.items():
                out[k] = out.get(k, 0) + int(v or 0)
        return out

    def input_rows(self) -> int:
        return sum(int(p.get("numInputRows", 0) or 0) for p in self.progress)


def source_lag(progress) -> int | None:
    """Records published but not yet read, from one progress report: the sum
    over sources and partitions of ``latestOffset - endOffset`` (the Kafka
    source reports both as ``{topic: {partition: offset}}``).  This is the
    consumer lag of the job itself, not a broker's replica-fetcher lag.
    None when no source reports offsets that way."""
    import json
    total = None
    for src in (progress.get("sources") or []):
        latest, end = src.get("latestOffset"), src.get("endOffset")
        latest = json.loads(latest) if isinstance(latest, str) else latest
        end = json.loads(end) if isinstance(end, str) else end
        if not isinstance(latest, dict) or not isinstance(end, dict):
            continue
        for topic, parts in latest.items():
            if not isinstance(parts, dict):
                continue
            for part, off in parts.items():
                done = (end.get(topic) or {}).get(part)
                if done is not None:
                    total = (total or 0) + max(0, int(off) - int(done))
    return total


def run_available_now(df: DataFrame, output: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append", timeout_s: float | None = None,
                      name: str | None = None, flush: bool = True,
                      state_partitions: int | None = None, each_batch=None) -> StreamRun:
    """Run a streaming frame once over all available input, then stop.

    ``flush=False`` skips the trailing no-data batch: windows the new
    watermark closes are then emitted by the next run's first batch instead
    (useful when replaying many increments; the watermark itself is kept in
    the checkpoint either way).  ``state_partitions`` sizes the stateful
    shuffle on a new checkpoint (default: the session's
    ``spark.sql.shuffle.partitions``; it is fixed at the first start, later
    runs keep the recorded value).  ``timeout_s`` stops a run that takes
    longer; by default a backlog may take as long as it needs.  ``each_batch``
    takes every micro-batch instead of the sink ``fmt``."""
    spark = df.sparkSession
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "true" if flush else "false"}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(int(state_partitions))
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return _run(df, output, checkpoint, fmt, mode, timeout_s, name, each_batch)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


# The query keeps its newest reports only; they are copied this often.
POLL_S = 0.25


def _run(df, output, checkpoint, fmt, mode, timeout_s, name, each_batch=None) -> StreamRun:
    w = (df.writeStream.outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    w = w.foreachBatch(each_batch) if each_batch else w.format(fmt)
    if not each_batch and fmt not in ("memory", "console"):
        w = w.option("path", output)
    if name:
        w = w.queryName(name)
    q = w.start()
    seen: dict[int, dict] = {}
    began, finished = time.monotonic(), False
    try:
        while not finished and (timeout_s is None or time.monotonic() - began < timeout_s):
            finished = q.awaitTermination(POLL_S)
            if not seen or (q.lastProgress or {}).get("batchId") not in seen or finished:
                seen.update((p["batchId"], p) for p in q.recentProgress)
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:
        raise RuntimeError(f"stream failed: {q.exception()}")
    if not finished:
        raise TimeoutError(f"stream did not finish within {timeout_s}s")
    # Batch ids of a run are consecutive: a gap would mean lost counters.
    if seen and len(seen) != max(seen) - min(seen) + 1:
        raise RuntimeError("progress reports were lost; counters would be incomplete")
    return StreamRun(output, checkpoint, [seen[k] for k in sorted(seen)])


def window_parts(orders: DataFrame, size: str = "30 seconds", delay: str = "5 seconds",
                 customer_buckets: int | None = None):
    """(frame of window parts, function that adds up closed ones): a state row
    for each customer of a window, or, with ``customer_buckets``, a set for
    each hash bucket of its customers."""
    if customer_buckets is None:
        return order_metrics_customers(orders, size, delay), merge_customers
    return order_metrics_buckets(orders, customer_buckets, size, delay), merge_buckets


def stream_order_metrics(spark: SparkSession, source: str, output: str | None = None,
                         checkpoint: str | None = None, size: str = "30 seconds",
                         delay: str = "5 seconds", max_files: int | None = None,
                         exact: bool = True, state_partitions: int | None = None,
                         timeout_s: float | None = None,
                         customer_buckets: int | None = None) -> tuple[DataFrame, StreamRun]:
    """SRC-3 -> PRJ-1 -> WM-1 -> WIN-1..4 -> SNK-3: JSON order files in,
    closed windows out (append: each window once, when the watermark passes
    its end).  Returns the sink read back as a batch frame.  With exact
    customers the sink holds a closed window in parts (see
    :func:`window_parts`), which the read adds up."""
    configure(spark)
    output = output or shared_dir(spark, "metrics-out")
    checkpoint = checkpoint or shared_dir(spark, "metrics-ckpt")
    raw = read_orders_files(spark, source, streaming=True, max_files=max_files)
    orders = parse_orders(raw, counters="orders")
    merge = None
    if exact:
        metrics, merge = window_parts(orders, size, delay, customer_buckets)
    else:
        metrics = order_metrics(orders, size=size, delay=delay, exact=False)
    run = run_available_now(metrics, output, checkpoint,
                            state_partitions=state_partitions, timeout_s=timeout_s)
    out = spark.read.schema(metrics.schema).parquet(output)
    return merge(out) if merge else out, run


def open_fragments(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(start, end, category, region) of the session fragments that a stopped
    or paused query of ``session_fragments`` still holds, read from its state
    at the last committed batch."""
    state = spark.read.format("statestore").load(checkpoint)
    window = "value.session_window" if "session_window" in state.schema["value"].dataType.names else "value.window"
    return state.select(F.unix_millis(f"{window}.start").alias("start"), F.unix_millis(f"{window}.end").alias("end"),
                        "value.category", "value.region")


def stream_order_sessions(spark: SparkSession, source: str, output: str | None = None,
                          checkpoint: str | None = None, gap: str = "10 seconds", delay: str = "5 seconds",
                          state_partitions: int | None = None,
                          timeout_s: float | None = None) -> tuple[DataFrame, StreamRun]:
    """WIN-5: JSON order files in, closed sessions out.  The sink holds closed
    fragments; the read chains them, and leaves out sessions that touch a
    fragment still open in the state."""
    configure(spark)
    output = output or shared_dir(spark, "sessions-out")
    checkpoint = checkpoint or shared_dir(spark, "sessions-ckpt")
    orders = parse_orders(read_orders_files(spark, source, streaming=True), counters="orders")
    parts = session_fragments(orders, gap, delay)
    run = run_available_now(parts, output, checkpoint, state_partitions=state_partitions, timeout_s=timeout_s)
    closed = spark.read.schema(parts.schema).parquet(output)
    return merge_fragments(closed, open_fragments(spark, checkpoint)), run


def stream_log_lines(spark: SparkSession, metrics_source: str, output: str | None = None,
                     checkpoint: str | None = None,
                     timeout_s: float | None = None) -> tuple[DataFrame, StreamRun]:
    """SRC-2 -> PRJ-6 -> FMT-1 -> SNK-4: metrics JSON in, log lines out."""
    output = output or shared_dir(spark, "log-out")
    checkpoint = checkpoint or shared_dir(spark, "log-ckpt")
    raw = spark.readStream.format("text").load(metrics_source)
    lines = format_metrics(parse_metrics(raw)).select(F.col("line").alias("value"))
    run = run_available_now(lines, output, checkpoint, fmt="text", timeout_s=timeout_s)
    return spark.read.text(output), run


def stream_metrics_summary(spark: SparkSession, metrics_source: str,
                           checkpoint: str | None = None,
                           timeout_s: float | None = None) -> tuple[DataFrame, StreamRun]:
    """AGG-10 on a stream: running totals in complete mode (the reader's
    periodic summary; use ``trigger(processingTime='60 seconds')`` when run
    continuously)."""
    checkpoint = checkpoint or shared_dir(spark, "summary-ckpt")
    name = "metrics_summary_" + uuid.uuid4().hex[:12]
    raw = spark.readStream.format("text").load(metrics_source)
    summary = metrics_summary(parse_metrics(raw))
    run = run_available_now(summary, "", checkpoint, fmt="memory", mode="complete", name=name,
                            timeout_s=timeout_s)
    return spark.table(name), run


def start_stream(df: DataFrame, checkpoint: str, fmt: str = "parquet", path: str | None = None,
                 mode: str = "append", trigger: str = "10 seconds",
                 state_partitions: int | None = None, name: str | None = None, each_batch=None, **options):
    """Start a continuously running query (processing-time trigger) and
    return the StreamingQuery; the checkpoint makes it restartable."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(int(state_partitions)))
    try:
        w = (df.writeStream.outputMode(mode).options(**options)
             .option("checkpointLocation", checkpoint).trigger(processingTime=trigger))
        w = w.foreachBatch(each_batch) if each_batch else w.format(fmt)
        if path:
            w = w.option("path", path)
        if name:
            w = w.queryName(name)
        return w.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def start_metrics_reader(raw_metrics: DataFrame, log_path: str, log_checkpoint: str,
                         summary_checkpoint: str, summary_interval: str = "60 seconds"):
    """The metrics reader as two queries over one source: log lines
    (append, SNK-4) and the running summary (complete mode, every
    ``summary_interval``, console sink).  Returns both queries."""
    metrics = parse_metrics(raw_metrics)
    lines = format_metrics(metrics).select(F.col("line").alias("value"))
    logs = start_stream(lines, log_checkpoint, fmt="text", path=log_path, trigger="1 second")
    summary = start_stream(metrics_summary(metrics), summary_checkpoint, fmt="console",
                           mode="complete", trigger=summary_interval)
    return logs, summary


def orders_job_frame(raw: DataFrame, size: str = "30 seconds", delay: str = "5 seconds",
                     exact: bool = True, counters: str | None = None,
                     lenient: bool = True) -> DataFrame:
    """The job's transformation, source- and sink-agnostic: raw records with
    a JSON ``value`` -> (key, value) metrics records ready for a Kafka sink."""
    from ..operators.parse import encode_metrics
    orders = parse_orders(raw, lenient=lenient, counters=counters)
    return encode_metrics(order_metrics(orders, size=size, delay=delay, exact=exact))


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a location in any store Hadoop knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish_once(ledger: str, write, transform=None):
    """A ``foreachBatch`` function that publishes every batch once: it writes
    the (transformed) batch with ``write(frame)`` and then a marker
    ``batch-<id>`` in the folder ``ledger``.  A batch that is replayed because
    the query stopped between publishing and its checkpoint's commit finds its
    marker and is run without being written.  A stop inside ``write`` itself leaves no
    marker: that batch is written again whole (at least once), so readers of a
    sink without transactions still use ``dedupe_metrics``."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, marker = _hadoop(spark, f"{ledger}/batch-{batch_id}")
        if fs.exists(marker):
            # Its state must still be brought up to date.
            batch.write.format("noop").mode("overwrite").save()
            return
        write(transform(batch) if transform else batch)
        fs.create(marker, True).close()
        if batch_id >= LEDGER_KEPT:
            fs.delete(_hadoop(spark, f"{ledger}/batch-{batch_id - LEDGER_KEPT}")[1], False)
    return publish


def late_orders(batch: DataFrame, watermark_ms: int, size: str = "30 seconds") -> DataFrame:
    """WIN-4: the orders of ``batch`` whose window had closed when the
    watermark was ``watermark_ms``, with ``windowStart`` and the watermark."""
    ms = interval_ms(size)
    start = F.col("orderTimestamp") - F.pmod(F.col("orderTimestamp"), F.lit(ms))
    return (batch.withColumn("windowStart", start).where(F.col("windowStart") + ms <= F.lit(watermark_ms))
            .withColumn("watermark", F.lit(watermark_ms).cast("long")))


def keep_late_orders(output: str, ledger: str, size: str = "30 seconds", delay: str = "5 seconds"):
    """A ``foreachBatch`` function for a stream of parsed orders: writes the
    late ones, orders and not partial rows, to ``output``/batch=<id>.

    Late is what the window operator drops: an order whose window end is not
    after the watermark of the batch before, the newest event time so far less
    ``delay``.  That time is kept per batch in the folder ``ledger``; a
    replayed batch reads the same one and writes its folder again, so every
    late order is kept once."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest, at = None, batch_id - 1
        if at >= 0:
            fs, p = _hadoop(spark, f"{ledger}/newest-{at}")
            stream = fs.open(p)
            newest = stream.readLong()
            stream.close()
        mark = newest - interval_ms(delay) if newest is not None else -(1 << 62)
        # The batch is read once: its newest event time is observed on the way.
        seen = Observation(f"newest-{uuid.uuid4().hex[:8]}")
        late = late_orders(batch.observe(seen, F.max("orderTimestamp").alias("t")), mark, size)
        late.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        top = max(x for x in (seen.get.get("t"), newest, -(1 << 61)) if x is not None)
        fs, p = _hadoop(spark, f"{ledger}/newest-{batch_id}")
        out = fs.create(p, True)
        out.writeLong(top)
        out.close()
        if batch_id >= LEDGER_KEPT:
            fs.delete(_hadoop(spark, f"{ledger}/newest-{batch_id - LEDGER_KEPT}")[1], False)
    return each


# Entries of a ledger that are kept; only a checkpoint's newest batch is ever
# replayed.
LEDGER_KEPT = 100


def start_orders_job(spark: SparkSession, servers: str, checkpoint: str,
                     input_topic: str = "orders", output_topic: str = "order-metrics",
                     size: str = "30 seconds", delay: str = "5 seconds",
                     trigger: str = "10 seconds", state_partitions: int | None = None,
                     exact: bool = True, lenient: bool = True, starting: str = "earliest",
                     max_per_trigger: int | None = None, fail_on_data_loss: bool = True,
                     producer: dict[str, str] | None = None, rejects_path: str | None = None,
                     customer_buckets: int | None = None):
    """The windowed-metrics job end to end: Kafka orders -> parse/validate ->
    event-time windows per category x region -> JSON metrics on Kafka.  Needs
    the spark-sql-kafka connector on the classpath.

    Exact customers are kept as one state row each (:func:`window_parts`);
    every micro-batch adds up the windows it closes and publishes them once
    (:func:`publish_once`, its ledger in the checkpoint's folder).  ``exact=False`` keeps sketches and writes
    straight to the topic (at least once).

    Every progress report of the query carries the counters ``orders``
    (messages, errors).  With ``rejects_path`` a second query writes the
    rejected records with their reason there; both queries are returned
    then.  ``state_partitions`` (default: the session's
    ``spark.sql.shuffle.partitions``) is fixed by the first start."""
    from ..operators.parse import encode_metrics, rejected_orders
    from ..sources.kafka import read_orders_kafka, sink_options
    configure(spark)
    read = lambda: read_orders_kafka(spark, servers, topic=input_topic, starting=starting,
                                     max_per_trigger=max_per_trigger, fail_on_data_loss=fail_on_data_loss)
    sink = sink_options(servers, output_topic, producer)
    if exact:
        parts, merge = window_parts(parse_orders(read(), lenient=lenient, counters="orders"), size, delay,
                                    customer_buckets)
        publish = publish_once(f"{checkpoint}/ledger", lambda df: df.write.format("kafka").options(**sink).save(),
                               lambda batch: encode_metrics(merge(batch)))
        job = start_stream(parts, checkpoint, trigger=trigger, state_partitions=state_partitions,
                           name="order-metrics", each_batch=publish)
    else:
        frame = orders_job_frame(read(), size, delay, exact, counters="orders", lenient=lenient)
        job = start_stream(frame, checkpoint, fmt="kafka", trigger=trigger, state_partitions=state_partitions,
                           name="order-metrics", **sink)
    if rejects_path is None:
        return job
    return job, start_stream(rejected_orders(read(), lenient=lenient), f"{checkpoint}-rejects", fmt="json",
                             path=rejects_path, trigger=trigger, name="order-rejects")
