"""Adapters that shape the driver's ``events`` table into the engine's
inputs (orders, Kafka-like raw records, operational samples, broker beans).

Everything is a Spark transformation of the table, so the work grows with
it.  Time is compressed 1000x (event epoch ms integer-divided by 1000) so
that 30 s windows hold several orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.parse import encode_orders


# Fixed values of the test mapping (FIXTURES.md, adapter section): the
# category and region vocabularies, indexed by event_id % 6 and user_id % 5.
CATEGORIES = ["ELECTRONICS", "CLOTHING", "FOOD", "HOME", "SPORTS", "BOOKS"]
REGIONS = ["NORTH", "SOUTH", "EAST", "WEST", "CENTRAL"]

# event_type -> operational metric name of the samples adapter.
SAMPLE_METRICS = {
    "view": "records_per_second",
    "click": "backpressured",
    "error": "consumer_lag",
    "signup": "pod_ready",
    "purchase": "checkpoint_ms",
}
# Metrics whose sample value is the 0/1 flag event_id % 2.
FLAG_METRICS = ("backpressured", "pod_ready")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def fixture_epoch_ms(ts: Column | str = "ts") -> Column:
    """Epoch milliseconds as the fixture definition computes them: rounded
    to the nearest millisecond, halves up (not truncated)."""
    us = F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
    return F.floor((us + F.lit(500)) / F.lit(1000)).cast("long")


def compressed_ms(ts: Column | str = "ts") -> Column:
    """Event epoch ms integer-divided by 1000 (the 1000x time compression)."""
    return F.floor(fixture_epoch_ms(ts) / F.lit(1000)).cast("long")


def orders_from_events(events: DataFrame, keep_event_id: bool = False) -> DataFrame:
    """One order per event (the ``O`` relation of every oracle)."""
    eid, uid = F.col("event_id"), F.col("user_id")
    qty = (F.lit(1) + eid % 10).cast("int")
    ts = compressed_ms("ts")
    cols = [
        F.concat(F.lit("order-"), eid.cast("string")).alias("orderId"),
        F.format_string("CUST-%05d", uid).alias("customerId"),
        F.format_string("PROD-%05d", eid % 1000).alias("productId"),
        F.concat(F.lit("Product "), (eid % 60).cast("string")).alias("productName"),
        _pick(CATEGORIES, eid % 6).alias("category"),
        _pick(REGIONS, uid % 5).alias("region"),
        qty.alias("quantity"),
        F.col("value").alias("unitPrice"),
        F.round(qty * F.col("value"), 2).alias("totalAmount"),
        ts.alias("orderTimestamp"),
        ts.alias("ingestionTimestamp"),
    ]
    if keep_event_id:
        cols += [eid.alias("event_id"), F.col("event_type"), F.col("value").alias("event_value")]
    return events.select(*cols)


def raw_orders_from_events(events: DataFrame) -> DataFrame:
    """Kafka-shaped records (key, value, topic, partition, offset, timestamp)
    carrying every order as JSON, partitioned by key hash into 12 partitions
    like the reference's input topic."""
    o = orders_from_events(events, keep_event_id=True)
    return encode_orders(o, keep=("event_id", "ingestionTimestamp")).select(
        "key", "value",
        F.lit("orders").alias("topic"),
        F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(12)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.timestamp_millis("ingestionTimestamp").alias("timestamp"),
    )


def loose_raw_orders(events: DataFrame) -> DataFrame:
    """Raw order records with numbers as a lenient mapper accepts them: the
    quantity as text (``event_id % 3`` = 1) or as a float to be truncated
    (2), the timestamp as text, and an ingestion time beyond 53 bits."""
    o = orders_from_events(events, keep_event_id=True)
    o = o.withColumn("ingestionTimestamp", F.col("ingestionTimestamp") + F.lit(9007199254740993))
    kind, text = F.col("event_id") % 3, F.col("value").cast("string")
    text = (F.when(kind == 1, F.regexp_replace(text, '"quantity":([0-9]+)', '"quantity":"$1"'))
            .when(kind == 2, F.regexp_replace(text, '"quantity":([0-9]+)', '"quantity":$1.75')).otherwise(text))
    text = F.regexp_replace(text, '"(orderTimestamp|ingestionTimestamp)":([0-9]+)', '"$1":"$2"')
    return encode_orders(o, keep=("event_id",)).select("key", text.cast("binary").alias("value"))


def corrupted_raw_orders(events: DataFrame) -> DataFrame:
    """The raw order records with data-driven faults, as a producer bug or
    a poison message would create them:

    * ``error`` events: JSON cut after 40 characters (malformed),
    * ``signup`` events with value < 2: tombstone (null value),
    * ``click`` events with value < 5: orderTimestamp 0 (bad timestamp),
    * ``view`` events with value >= 200: totalAmount + 1 (valid JSON whose
      total disagrees with quantity x unitPrice).
    """
    o = orders_from_events(events, keep_event_id=True)
    et, v = F.col("event_type"), F.col("event_value")
    o = (o.withColumn("orderTimestamp",
                      F.when((et == "click") & (v < 5), F.lit(0).cast("long"))
                      .otherwise(F.col("orderTimestamp")))
         .withColumn("totalAmount",
                     F.when((et == "view") & (v >= 200), F.col("totalAmount") + 1.0)
                     .otherwise(F.col("totalAmount"))))
    js = F.to_json(F.struct(*[F.col(c) for c in o.columns[:11]]), {"ignoreNullFields": "false"})
    value = (F.when(et == "error", F.substring(js, 1, 40))
             .when((et == "signup") & (v < 2), F.lit(None).cast("string"))
             .otherwise(js))
    return o.select(
        F.col("orderId").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit("orders").alias("topic"),
        F.pmod(F.xxhash64("orderId"), F.lit(12)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.timestamp_millis("ingestionTimestamp").alias("timestamp"),
    )


def ops_samples(events: DataFrame, block: int = 1000) -> DataFrame:
    """Gauges and counters in one SAMPLES table, from one scan: the counter's
    running sum is a window over the same rows (partitioned by series x
    block of event ids), and both series keep the highest event_id per
    (series, instant) in one grouped aggregate."""
    s = _sample_rows(events)
    w = (Window.partitionBy("metric", "pod", F.floor(F.col("event_id") / block))
         .orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.select("*", F.sum(F.round(F.col("value") * 100)).over(w).alias("_cum"))
    g = s.groupBy("metric", "pod", "phase", "ts_ms").agg(
        F.max_by("value", "event_id").alias("_gauge"),
        F.max_by("_cum", "event_id").alias("_counter"))
    both = F.array(
        F.struct(F.col("metric").alias("m"), F.col("_gauge").alias("v")),
        F.struct(F.concat("metric", F.lit("_total")).alias("m"), F.col("_counter").alias("v")))
    out = g.select("pod", "phase", "ts_ms", F.inline(both)).withColumnRenamed("m", "metric") \
        .withColumnRenamed("v", "value")
    return _as_samples(out)


def _sample_rows(events: DataFrame) -> DataFrame:
    et, eid, uid = F.col("event_type"), F.col("event_id"), F.col("user_id")
    metric = F.create_map(*[x for kv in SAMPLE_METRICS.items() for x in map(F.lit, kv)])[et]
    flag = metric.isin(*FLAG_METRICS)
    return events.select(
        metric.alias("metric"),
        F.concat(F.lit("orders-worker-"), (uid % 4).cast("string")).alias("pod"),
        F.when(uid % 2 == 0, F.lit("Running")).otherwise(F.lit("Pending")).alias("phase"),
        compressed_ms("ts").alias("ts_ms"),
        F.when(flag, (eid % 2).cast("double")).otherwise(F.col("value")).alias("value"),
        eid.alias("event_id"),
    )


def _as_samples(df: DataFrame) -> DataFrame:
    labels = F.create_map(F.lit("pod"), F.col("pod"), F.lit("topic"), F.lit("orders"),
                          F.lit("phase"), F.col("phase"))
    return df.select("metric", labels.alias("labels"),
                     F.timestamp_millis("ts_ms").alias("ts"), "value")


# Raw broker bean names per event_type, in the JMX
# "domain<key=value, ...><>attribute" form the exporter rules read.
def broker_beans_from_events(events: DataFrame) -> DataFrame:
    """Raw broker metric beans ``(name, ts, value)`` for the normaliser."""
    et, uid = F.col("event_type"), F.col("user_id")
    topic = F.when(uid % 2 == 0, F.lit("orders")).otherwise(F.lit("order-metrics"))
    eid = F.col("event_id")
    rate = F.lit("><>OneMinuteRate")
    name = (
        F.when((et == "view") & (eid % 3 == 0), F.concat(
            F.lit("kafka.server<name=MessagesInPerSec, topic="), topic,
            F.lit(", type=BrokerTopicMetrics"), rate))
        .when((et == "view") & (eid % 3 == 1), F.concat(
            F.lit("kafka.server<name=MessagesInPerSec, type=BrokerTopicMetrics, topic="), topic, rate))
        .when((et == "view") & (uid % 7 == 0), F.concat(
            F.lit("kafka.server<type=BrokerTopicMetricsX, name=MessagesInPerSec, topic="), topic, rate))
        .when(et == "view", F.concat(
            F.lit("kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic="),
            topic, F.lit("><>OneMinuteRate")))
        .when(et == "click", F.concat(
            F.lit("kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec, topic="),
            topic, F.lit("><>OneMinuteRate")))
        .when(et == "error", F.concat(
            F.lit("kafka.server<type=FetcherLagMetrics, name=ConsumerLag, "
                  "clientId=ReplicaFetcherThread-0-1, topic="), topic,
            F.lit(", partition="), (uid % 12).cast("string"), F.lit("><>Value")))
        .when(et == "signup",
              F.lit("kafka.server<type=ReplicaManager, name=UnderReplicatedPartitions><>Value"))
        .when(uid % 3 == 0,
              F.lit("kafka.controller<type=KafkaController, name=ActiveControllerCount><>Value"))
        .when(uid % 3 == 1, F.concat(
            F.lit("kafka.network<type=RequestMetrics, name=TotalTimeMs, request="),
            F.when(uid % 2 == 0, F.lit("Produce")).otherwise(F.lit("FetchConsumer")),
            F.lit("><>Mean")))
        .otherwise(F.lit("kafka.server<type=BrokerTopicMetrics, name=TotalFetchRequestsPerSec><>Count"))
    )
    return events.select(name.alias("name"), F.timestamp_millis(compressed_ms("ts")).alias("ts"),
                         F.col("value"), F.col("event_id"))


def arrival_order(orders: DataFrame) -> Column:
    """Deterministic disorder for lateness tests: every 17th event arrives
    120 s (compressed) after its event time."""
    return F.col("orderTimestamp") + F.when(F.col("event_id") % 17 == 0, F.lit(120000)).otherwise(0)
