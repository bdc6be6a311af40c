"""Registered order-stream queries over the driver's tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match its oracle in :mod:`windlass.plans.oracles`.  Money sums are exact
(``exact_sum``), so results are compared as they are, while the oracles round
theirs to cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import global_rank, ntile
from ..operators.parse import encode_metrics, parse_metrics, parse_orders, rejected_orders
from ..operators.reader import dedupe_metrics, format_metrics, metrics_summary
from ..operators.windows import (bitmap_partials, customer_dictionary, merge_metrics, merge_partials,
                                 order_metrics, order_metrics_session, order_total_mismatch)
from ..functions.scalar import exact_sum
from ..schemas import ORDER_COLUMNS
from ..session import configure, shared_dir
from ..sources.files import write_json_lines, write_log_lines
from ..sources.fixtures import (arrival_order, corrupted_raw_orders, loose_raw_orders, orders_from_events,
                                raw_orders_from_events, read_table)
from ..streaming.jobs import (keep_late_orders, late_orders, run_available_now, stream_order_metrics,
                              stream_order_sessions, window_parts)


# State width of the replays below: they keep a few thousand groups.
REPLAY_STATE_PARTITIONS = 4


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return orders_from_events(read_table(spark, sf_dir, "events"))


def q_order_metrics_30s(spark, sf_dir):
    return order_metrics(_orders(spark, sf_dir), size="30 seconds")


def q_order_metrics_1m(spark, sf_dir):
    return order_metrics(_orders(spark, sf_dir), size="1 minute")


def q_order_metrics_1h(spark, sf_dir):
    return order_metrics(_orders(spark, sf_dir), size="1 hour")


def q_order_metrics_stream(spark, sf_dir):
    """All orders as JSON files -> streaming job (availableNow) -> closed windows."""
    events = read_table(spark, sf_dir, "events")
    configure(spark)
    src = shared_dir(spark, "orders-json")
    write_json_lines(raw_orders_from_events(events).select("value"), src)
    out, _ = stream_order_metrics(spark, src, state_partitions=REPLAY_STATE_PARTITIONS)
    return out


def arrival_batches(orders_with_id: DataFrame, batches: int = 10) -> DataFrame:
    """Cut orders into ``batches`` equal-count arrival batches, ordered by
    (arrival time, event_id), without a single global window partition."""
    df = orders_with_id.withColumn("_arrival", arrival_order(orders_with_id))
    ranked = global_rank(df, ["_arrival", "event_id"], out="_rank")
    return ranked.withColumn("batch", ntile("_rank", "_n", batches)).drop("_rank", "_n")


def in_arrival_order(spark, path: str, batches: int) -> None:
    """Give the files under ``path``/batch=b the modification times a source
    sees them arrive by: those of a batch alike, a second after the last's."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    began = fs.getFileStatus(root).getModificationTime() - 1000 * (batches + 1)
    for b in range(1, batches + 1):
        files = fs.listFiles(jvm.org.apache.hadoop.fs.Path(f"{path}/batch={b}"), True)
        while files.hasNext():
            fs.setTimes(files.next().getPath(), began + 1000 * b, -1)


def _arrivals(spark, sf_dir, batches: int, files: int) -> DataFrame:
    """The orders as a file stream in a permuted arrival order: every arrival
    batch is ``files`` files, later than the ones of the batch before, and a
    query reads that many at a time."""
    events = read_table(spark, sf_dir, "events")
    configure(spark)
    src = shared_dir(spark, "arrival-src")
    (arrival_batches(orders_from_events(events, keep_event_id=True), batches)
     .select("batch", F.pmod("event_id", F.lit(files)).alias("file"),
             F.to_json(F.struct(*[F.col(c) for c in ORDER_COLUMNS])).alias("value"))
     .repartition("batch", "file").write.partitionBy("batch", "file").text(src))
    in_arrival_order(spark, src, batches)
    return (spark.readStream.schema("value string, batch int, file int")
            .option("maxFilesPerTrigger", files).text(src))


def q_late_data_drop(spark, sf_dir, batches: int = 10, files: int = 4):
    """WIN-4: replay orders in a permuted arrival order, one micro-batch per
    arrival batch (:func:`_arrivals`).  Orders whose window closed before their
    batch are dropped."""
    parts, merge = window_parts(parse_orders(_arrivals(spark, sf_dir, batches, files)))
    out, ckpt = shared_dir(spark, "late-out"), shared_dir(spark, "late-ckpt")
    run_available_now(parts, out, ckpt, state_partitions=REPLAY_STATE_PARTITIONS)
    return merge(spark.read.schema(parts.schema).parquet(out))


def q_late_orders(spark, sf_dir, batches: int = 10, files: int = 4):
    """WIN-4: the orders that the replay of :func:`q_late_data_drop` drops,
    kept and counted as orders: per window, how many and which came first and
    last."""
    orders = parse_orders(_arrivals(spark, sf_dir, batches, files))
    out, ckpt = shared_dir(spark, "late-orders"), shared_dir(spark, "late-orders-ckpt")
    run_available_now(orders, out, ckpt, each_batch=keep_late_orders(out, f"{ckpt}/ledger"))
    late = spark.read.schema(late_orders(orders, 0).schema).parquet(out)
    return late.groupBy("windowStart", "category", "region").agg(
        F.count(F.lit(1)).alias("lateOrders"), exact_sum("totalAmount").alias("lateRevenue"),
        F.min("orderId").alias("minOrderId"), F.max("orderId").alias("maxOrderId"),
        F.min("watermark").alias("minWatermark"), F.max("watermark").alias("maxWatermark"))


def q_order_sessions(spark, sf_dir):
    return order_metrics_session(_orders(spark, sf_dir), gap="10 seconds")


def _bitmap_parts(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return bitmap_partials(o, customer_dictionary(o), size="30 seconds")


def q_merge_partials_5m(spark, sf_dir):
    """AGG-9: customers as dictionary numbers, bitmap pages united by OR."""
    parts = _bitmap_parts(spark, sf_dir)
    return merge_metrics(parts, size="5 minutes")


def q_rollup_partials_10m(spark, sf_dir):
    """AGG-9 twice: 30 s partials -> 5 min partials -> 10 min metrics."""
    parts = _bitmap_parts(spark, sf_dir)
    return merge_metrics(merge_partials(parts, size="5 minutes"), size="10 minutes")


def q_order_sessions_stream(spark, sf_dir):
    """WIN-5 on a stream: fragments per customer closed by the watermark,
    chained to sessions; those that an open fragment may extend stay out."""
    events = read_table(spark, sf_dir, "events")
    configure(spark)
    src = shared_dir(spark, "orders-json")
    write_json_lines(raw_orders_from_events(events).select("value"), src)
    out, _ = stream_order_sessions(spark, src, state_partitions=REPLAY_STATE_PARTITIONS)
    return out


def q_approx_customers(spark, sf_dir):
    """AGG-7: the sketch's count lies within a fifth (four standard errors)
    of the exact one, in every window."""
    o, keys = _orders(spark, sf_dir), ["windowStart", "category", "region"]
    sketch = order_metrics(o, size="30 seconds", exact=False).select(*keys, F.col("uniqueCustomers").alias("sketch"))
    m = order_metrics(o, size="30 seconds").join(sketch, keys)
    n = F.col("uniqueCustomers")
    return m.withColumn("within_bound", F.abs(F.col("sketch") - n) <= F.ceil(n * 0.2)).drop("sketch")


def _wire(spark, sf_dir):
    configure(spark)
    return corrupted_raw_orders(read_table(spark, sf_dir, "events"))


def q_parse_orders_json(spark, sf_dir):
    return parse_orders(_wire(spark, sf_dir))


def q_parse_orders_lenient(spark, sf_dir):
    """PRJ-1: quantities written as text or as floats, timestamps as text."""
    configure(spark)
    return parse_orders(loose_raw_orders(read_table(spark, sf_dir, "events")))


def q_rejected_orders(spark, sf_dir):
    r = rejected_orders(_wire(spark, sf_dir))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"),
                                   F.min("offset").alias("min_offset"),
                                   F.max("offset").alias("max_offset"))


def q_order_total_mismatch(spark, sf_dir):
    bad = order_total_mismatch(parse_orders(_wire(spark, sf_dir)))
    return bad.select("orderId", "quantity", "unitPrice", "totalAmount", "expectedAmount")


def _metrics(spark, sf_dir):
    return order_metrics(_orders(spark, sf_dir))


def q_encode_metrics(spark, sf_dir):
    """Encode window rows as Kafka (key, JSON value) and read the JSON back;
    ``json_fields`` checks that every property (nulls too) is written."""
    enc = encode_metrics(_metrics(spark, sf_dir))
    text = F.col("value").cast("string")
    enc = enc.select(F.col("key").cast("string").alias("key"), text.alias("value"),
                     F.size(F.json_object_keys(text)).alias("json_fields"))
    return parse_metrics(enc, keep=("key", "json_fields"))


def q_format_metrics(spark, sf_dir):
    enc = encode_metrics(_metrics(spark, sf_dir))
    return format_metrics(parse_metrics(enc)).select("line")


def q_log_lines_sink(spark, sf_dir):
    """SNK-4: the log lines written by the reader's sink, read back."""
    path = shared_dir(spark, "log-lines")
    write_log_lines(q_format_metrics(spark, sf_dir), path)
    return spark.read.schema("line string").text(path)


def q_metrics_summary(spark, sf_dir):
    return metrics_summary(_metrics(spark, sf_dir))


def q_dedupe_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return dedupe_metrics(m.unionByName(m))


def q_dedupe_metrics_stream(spark, sf_dir):
    """Window rows published twice, as JSON files, through the streaming
    dedupe; the bound covers the whole table."""
    m = encode_metrics(_metrics(spark, sf_dir))
    src, out, ckpt = (shared_dir(spark, n) for n in ("metrics-json", "dedupe-out", "dedupe-ckpt"))
    write_json_lines(m.unionByName(m).select("value"), src)
    once = dedupe_metrics(parse_metrics(spark.readStream.format("text").load(src)), delay="3650 days")
    run_available_now(once, out, ckpt, state_partitions=REPLAY_STATE_PARTITIONS)
    return spark.read.schema(once.schema).parquet(out)


QUERIES = {
    "order_metrics_30s": q_order_metrics_30s,
    "order_metrics_1m": q_order_metrics_1m,
    "order_metrics_1h": q_order_metrics_1h,
    "order_metrics_stream": q_order_metrics_stream,
    "late_data_drop": q_late_data_drop,
    "late_orders": q_late_orders,
    "order_sessions": q_order_sessions,
    "merge_partials_5m": q_merge_partials_5m,
    "rollup_partials_10m": q_rollup_partials_10m,
    "order_sessions_stream": q_order_sessions_stream,
    "approx_customers": q_approx_customers,
    "parse_orders_json": q_parse_orders_json,
    "parse_orders_lenient": q_parse_orders_lenient,
    "rejected_orders": q_rejected_orders,
    "order_total_mismatch": q_order_total_mismatch,
    "encode_metrics": q_encode_metrics,
    "format_metrics": q_format_metrics,
    "log_lines_sink": q_log_lines_sink,
    "metrics_summary": q_metrics_summary,
    "dedupe_metrics": q_dedupe_metrics,
    "dedupe_metrics_stream": q_dedupe_metrics_stream,
}
