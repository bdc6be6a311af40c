"""Broker-name normaliser, Kafka option builders, report row, driver entry."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from windlass.operators.broker import normalise_broker_samples
from windlass.sources import kafka


def test_broker_rules(spark):
    names = [
        "kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic=orders><>OneMinuteRate",
        "kafka.server<type=FetcherLagMetrics, name=ConsumerLag, clientId=x, topic=orders, partition=7><>Value",
        "kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Produce><>Mean",
        "kafka.server<type=ReplicaManager, name=UnderReplicatedPartitions><>Value",
        "kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic=orders><>Count",  # no rule
        "kafka.log<type=Log, name=Size, topic=orders><>Value",  # not allow-listed
    ]
    ts = dt.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(n, ts, float(i)) for i, n in enumerate(names)],
                                "name string, ts timestamp, value double")
    out = {r.value: (r.metric, dict(r.labels)) for r in normalise_broker_samples(raw).collect()}
    assert out == {
        0.0: ("kafka_server_brokertopicmetrics_messagesin_oneminuterate", {"topic": "orders"}),
        1.0: ("kafka_server_fetcherlagmetrics_consumerlag", {"topic": "orders", "partition": "7"}),
        2.0: ("kafka_network_requestmetrics_totaltimems_mean", {"request": "Produce"}),
        3.0: ("kafka_server_replicamanager_underreplicatedpartitions", {}),
    }


def test_kafka_options():
    o = kafka.source_options("b:9092", "orders", "g", max_per_trigger=500)
    assert o["subscribe"] == "orders" and o["startingOffsets"] == "earliest"
    assert o["failOnDataLoss"] == "true" and o["maxOffsetsPerTrigger"] == "500"
    assert o["groupIdPrefix"] == "g" and "kafka.group.id" not in o
    plain = kafka.source_options("b:9092", "orders", fail_on_data_loss=False)
    assert plain["failOnDataLoss"] == "false" and "maxOffsetsPerTrigger" not in plain
    s = kafka.sink_options("b:9092", "orders", kafka.PRODUCER_SETTINGS)
    assert s["kafka.acks"] == "1" and s["kafka.compression.type"] == "lz4"
    assert s["kafka.linger.ms"] == "5" and s["kafka.batch.size"] == "65536"


def test_report_row_and_csv(spark, tmp):
    from windlass.plans.report import CSV_NAMES, REPORT_COLUMNS, report_csv_row
    from windlass.plans.timeseries import q_scenario_report
    from windlass.sources.files import write_report_csv
    rep = q_scenario_report(spark, SF_SMALL)
    assert rep.columns == REPORT_COLUMNS and rep.count() == 1
    row = report_csv_row(rep).collect()[0]
    assert row.duration_min == "45" and row.timestamp.endswith(" UTC")
    path = os.path.join(tmp, "report")
    write_report_csv(report_csv_row(rep), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == [CSV_NAMES.get(c, c) for c in REPORT_COLUMNS] and back.count() == 1
    empty = rep.withColumn("errors", F.lit(None).cast("double"))
    assert report_csv_row(empty).collect()[0].errors == "N/A"


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["windowStart", "windowEnd", "category", "region"]
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["order_metrics_30s", "merge_partials_5m", "rejected_orders",
                                  "resample_15s", "counter_rate", "normalise_broker",
                                  "broker_consumer_lag"])
def test_oracle_small(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_SMALL}/events.parquet')")
    rel = con.sql(E.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    spark_rows = sorted(tuple(r[c] for c in cols) for r in df.collect())
    idx = [rel.columns.index(c) for c in cols]
    duck_rows = sorted(tuple(r[i] for i in idx) for r in rel.fetchall())
    assert spark_rows == duck_rows


def test_reference_dashboard_and_report_definitions(spark):
    """The reference's own metric names plan and run on a samples table
    (here: the broker-normalised beans, which carry two of them)."""
    from windlass.operators.timeseries import with_series
    from windlass.plans.report import (REFERENCE_PANELS, REFERENCE_SOURCES, dashboard_panels,
                                       scenario_report)
    from windlass.sources.fixtures import broker_beans_from_events, read_table
    s = with_series(normalise_broker_samples(
        broker_beans_from_events(read_table(spark, SF_SMALL, "events"))))
    at = s.agg(F.max("ts_ms")).first()[0]
    d = dashboard_panels(s, at, 45 * 60_000, REFERENCE_PANELS)
    got = {r.panel for r in d.select("panel").distinct().collect()}
    assert {"orders_inbound", "consumer_lag", "bytes_in", "active_workers"} <= got
    rep = scenario_report(s, at, 45, sources=REFERENCE_SOURCES).collect()[0]
    assert rep.consumer_lag_peak is not None and rep.send_rate_peak is None
    assert rep.workers_now == 0.0
    # report and dashboard take rate() of the inbound gauge by default, as the
    # reference does; compat_rate=False reads the gauge itself in both
    plain = scenario_report(s, at, 45, sources=REFERENCE_SOURCES, compat_rate=False).collect()[0]
    assert rep.broker_inbound_peak is not None and plain.broker_inbound_peak is not None
    assert rep.broker_inbound_peak != plain.broker_inbound_peak
    inbound = d.where("panel = 'orders_inbound'").agg(F.max("value")).first()[0]
    assert abs(inbound - rep.broker_inbound_peak) <= 0.5


def test_cli_report(spark, tmp, capsys):
    """The report from the command line over a stored samples table."""
    from windlass.cli import main
    from windlass.sources.fixtures import broker_beans_from_events, read_table
    from windlass.sources.samples import write_samples
    path = tmp + "/samples"
    write_samples(normalise_broker_samples(broker_beans_from_events(
        read_table(spark, SF_SMALL, "events"))), path)
    row = main(["report", "--samples", path, "--duration", "45", "--label", "cli",
                "--csv", tmp + "/csv"], spark=spark)
    assert row["label"] == "cli" and row["send_rate_peak"] == "N/A"
    assert row["consumer_lag_peak"] != "N/A"
    assert "consumer_lag_peak:" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(tmp + "/csv").count() == 1
