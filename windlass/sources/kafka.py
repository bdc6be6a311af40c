"""Kafka topics as Spark sources and sinks (SRC-1, SRC-2, SNK-1, SNK-2).

Uses Spark's built-in Kafka connector (``spark-sql-kafka-0-10``; add it with
``--packages org.apache.spark:spark-sql-kafka-0-10_2.13:<spark version>``).
Option builders are plain dicts so they can be checked without a broker.

Delivery: the stream checkpoint replaces consumer-group commits (offsets
live in the checkpoint, so a restart resumes exactly where it stopped), and
the Kafka sink is at-least-once -- the reference's guarantee too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.parse import encode_metrics, encode_orders

# Topic names and client settings of the reference deployment.
ORDERS_TOPIC = "orders"
METRICS_TOPIC = "order-metrics"
ORDERS_GROUP = "flink-orders-consumer"
METRICS_GROUP = "metrics-logger"
PRODUCER_SETTINGS = {
    "kafka.acks": "1",
    "kafka.compression.type": "lz4",
    "kafka.linger.ms": "5",
    "kafka.batch.size": "65536",
    "kafka.retries": "3",
}


def source_options(servers: str, topic: str, group: str | None = None,
                   starting: str = "earliest", max_per_trigger: int | None = None,
                   fail_on_data_loss: bool = True, **extra: str) -> dict[str, str]:
    """Options for ``readStream.format("kafka")``: subscribe to one topic,
    start at the earliest retained offset on first run (later runs resume
    from the checkpoint).  Records that retention removed before they were
    read stop the query; ``fail_on_data_loss=False`` goes on without them.
    ``max_per_trigger`` bounds a micro-batch (default: none)."""
    opts = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if group:
        # A prefix: every query gets a group of its own, so that two queries
        # over one topic never share its partitions.
        opts["groupIdPrefix"] = group
    if max_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(int(max_per_trigger))
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def sink_options(servers: str, topic: str, producer: dict[str, str] | None = None,
                 **extra: str) -> dict[str, str]:
    opts = {"kafka.bootstrap.servers": servers, "topic": topic}
    opts.update(producer or {})
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_orders_kafka(spark: SparkSession, servers: str, topic: str = ORDERS_TOPIC,
                      streaming: bool = True,
                      max_per_trigger: int | None = None,
                      **opts: str) -> DataFrame:
    """SRC-1: raw order records (key, value, topic, partition, offset,
    timestamp).  Feed to :func:`windlass.operators.parse.parse_orders`."""
    o = source_options(servers, topic, ORDERS_GROUP,
                       max_per_trigger=max_per_trigger if streaming else None, **opts)
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**o).load()


def read_metrics_kafka(spark: SparkSession, servers: str, topic: str = METRICS_TOPIC,
                       streaming: bool = True, max_per_trigger: int | None = None,
                       **opts: str) -> DataFrame:
    """SRC-2: raw metrics records.  Feed to ``parse_metrics``."""
    o = source_options(servers, topic, METRICS_GROUP,
                       max_per_trigger=max_per_trigger if streaming else None, **opts)
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**o).load()


def write_metrics_kafka(metrics: DataFrame, servers: str, checkpoint: str,
                        topic: str = METRICS_TOPIC, trigger: str | None = "10 seconds",
                        **opts: str):
    """SNK-1: window rows -> ``category#region`` key + JSON value.
    Streaming input starts a query (append); batch input is written once."""
    out = encode_metrics(metrics)
    o = sink_options(servers, topic, **opts)
    if out.isStreaming:
        w = (out.writeStream.format("kafka").options(**o)
             .option("checkpointLocation", checkpoint).outputMode("append"))
        if trigger:
            w = w.trigger(processingTime=trigger)
        return w.start()
    out.write.format("kafka").options(**o).save()
    return None


def write_orders_kafka(orders: DataFrame, servers: str, topic: str = ORDERS_TOPIC,
                       checkpoint: str | None = None, **opts: str):
    """SNK-2: orders -> key orderId + JSON value, with the reference's
    producer settings (acks=1, lz4, 5 ms linger, 64 KB batches, 3 retries)."""
    out = encode_orders(orders)
    o = sink_options(servers, topic, PRODUCER_SETTINGS, **opts)
    if out.isStreaming:
        return (out.writeStream.format("kafka").options(**o)
                .option("checkpointLocation", checkpoint).start())
    out.write.format("kafka").options(**o).save()
    return None
