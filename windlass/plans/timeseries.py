"""Registered time-series queries over samples derived from ``events``.

Every query evaluates at the latest sample instant of the table and looks
back over its whole span, so the full table is processed.  Label maps are flattened to
``pod``/``phase`` columns for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import threshold_status, value_text
from ..operators.broker import normalise_broker_samples
from ..operators.series import select_samples, write_series
from ..operators.tiers import append_tiers, increase, range_states
from ..operators.timeseries import (across, binary_op, counter_rate, instant, latest_per_instant,
                                    minus_time,
                                    or_zero, over_time, progress_rate, reduce_panel,
                                    resample, select_series, series_labels, step_grid,
                                    value_filter, vector_op, with_series)
from ..session import configure, shared_dir
from .report import (BACKPRESSURE_BANDS, PEAK_MAPPING, dashboard_panels, panel_status, report_csv_row,
                     scenario_report)
from ..sources.fixtures import broker_beans_from_events, compressed_ms, ops_samples, read_table
from ..sources.files import write_report_csv
from ..sources.samples import read_samples, write_samples

STEP_MS = 15_000


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return with_series(ops_samples(read_table(spark, sf_dir, "events")))


def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples as a table partitioned by date and metric (SRC-4), so that
    plans with several branches read only their metrics."""
    path = shared_dir(spark, "samples")
    write_samples(ops_samples(read_table(spark, sf_dir, "events")), path)
    return with_series(read_samples(spark, path))


def bounds(df: DataFrame, ms) -> tuple[int, int]:
    """Evaluation instant (the newest one) and a look-back over the whole
    table: its span in whole minutes and two more (one-row aggregate)."""
    r = df.agg(F.min(ms).alias("lo"), F.max(ms).alias("hi")).first()
    return int(r.hi), ((int(r.hi) - int(r.lo)) // 60_000 + 2) * 60_000


def event_bounds(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Bounds read straight from ``events`` (every event yields a sample at
    its compressed time): one scan, no derivation."""
    return bounds(read_table(spark, sf_dir, "events"), compressed_ms("ts"))


def _ctx(spark: SparkSession, sf_dir: str):
    return samples(spark, sf_dir), *event_bounds(spark, sf_dir)


def flat(df: DataFrame, *keep: str) -> DataFrame:
    lab = series_labels("_sk")
    cols = [c for c in ("metric",) if c in df.columns]
    return df.select(*cols, lab["pod"].alias("pod"), lab["phase"].alias("phase"), *keep)


def q_select_series_regex(spark, sf_dir):
    """TS-1/TS-2 on the series dictionary: matchers run on the label index,
    the samples are read by number."""
    configure(spark)
    path = shared_dir(spark, "series")
    write_series(ops_samples(read_table(spark, sf_dir, "events")), path)
    sel = select_samples(spark, path, metric="records_per_second", eq={"topic": "orders"}, ne={"phase": "Pending"},
                         regex={"pod": ".*worker-[01]"}, not_regex={"pod": ".*-9"})
    return flat(sel, "ts_ms", "value")


def q_tier_summary(spark, sf_dir):
    """Roll-up tiers, written in two appends: counts, extremes, sums, first and
    last values and increases over the whole span, whose edges lie inside
    steps; whole steps come from the tiers."""
    configure(spark)
    s = ops_samples(read_table(spark, sf_dir, "events"))
    at, rng = event_bounds(spark, sf_dir)
    path, half = shared_dir(spark, "tiers"), F.unix_millis("ts") <= at - rng // 2
    append_tiers(s.where(half), path)
    append_tiers(s.where(~half), path)
    r = range_states(s, path, at, rng, ["records_per_second_total", "consumer_lag"])
    return flat(r, "n", "low", "high", F.round("total", 2).alias("total"), "first_ts", "first_value", "last_ts",
                "last_value", F.round(increase(), 2).alias("increase"))


def q_instant_value(spark, sf_dir):
    s, at, rng = _ctx(spark, sf_dir)
    return flat(instant(s, at), "value")


def q_resample_15s(spark, sf_dir):
    s, at, rng = _ctx(spark, sf_dir)
    g = select_series(s, ["records_per_second", "consumer_lag", "checkpoint_ms"])
    return flat(resample(g, at, rng, STEP_MS), "step", "value")


def q_over_time(spark, sf_dir):
    """max / min / avg over the grid; the average is reported as the sum
    rounded to cents over the step count, identical in any summation order."""
    s, at, rng = _ctx(spark, sf_dir)
    r = resample(select_series(s, ["records_per_second", "consumer_lag"]), at, rng, STEP_MS)
    out = over_time(r, "max", "min", "sum", "count")
    return flat(out, F.col("max").alias("max_v"), F.col("min").alias("min_v"),
                (F.round("sum", 2) / F.col("count")).alias("avg_v"), F.col("count").alias("n"))


def q_counter_rate(spark, sf_dir):
    s, at, rng = _ctx(spark, sf_dir)
    c = select_series(s, ["records_per_second_total", "checkpoint_ms_total"])
    return flat(counter_rate(c, at, rng, 60_000, STEP_MS), "step", "value")


def q_counter_rate_1h(spark, sf_dir):
    """A window of many steps: buckets are combined, not samples copied."""
    s, at, rng = _ctx(spark, sf_dir)
    c = select_series(s, ["records_per_second_total"])
    return flat(counter_rate(c, at, rng, 3_600_000, STEP_MS), "step", F.round("value", 9).alias("value"))


def _gauges(spark, sf_dir, metric):
    s, at, rng = _ctx(spark, sf_dir)
    return s, at, rng, resample(select_series(s, metric), at, rng, STEP_MS)


def q_sum_by_pod(spark, sf_dir):
    *_, r = _gauges(spark, sf_dir, ["checkpoint_ms", "consumer_lag"])
    return across(r, "sum", by=["pod"]).withColumn("value", F.round("value", 2))


def q_count_by_phase(spark, sf_dir):
    *_, r = _gauges(spark, sf_dir, "pod_ready")
    return across(r, "count", by=["phase"])


def q_avg_pct(spark, sf_dir):
    *_, r = _gauges(spark, sf_dir, "backpressured")
    return across(r, "avg", scale=100.0)


def q_ready_pods(spark, sf_dir):
    s, at, rng, r = _gauges(spark, sf_dir, "pod_ready")
    ready = across(value_filter(r, "==", 1.0), "count")
    return or_zero(ready, step_grid(s, at, rng, STEP_MS))


def q_startup_latency(spark, sf_dir):
    """``a - b`` on identical label sets: one resample of both metrics, one
    aggregation per (labels, step)."""
    s, at, rng = _ctx(spark, sf_dir)
    r = resample(select_series(s, ["records_per_second", "checkpoint_ms"]), at, rng, STEP_MS)
    m = F.col("metric")
    return flat(vector_op(r, m == "records_per_second", m == "checkpoint_ms", "-"),
                "step", "value")


def q_watermark_lag(spark, sf_dir):
    *_, r = _gauges(spark, sf_dir, "checkpoint_ms")
    return flat(minus_time(r), "step", "value")


def q_panel_last_mean(spark, sf_dir):
    *_, r = _gauges(spark, sf_dir, "backpressured")
    pct = r.withColumn("value", F.col("value") * 100.0)
    red = reduce_panel(pct.drop("sample_ts"), ("lastNotNull", "mean"))
    red = (red.withColumn("status", threshold_status("lastNotNull", list(BACKPRESSURE_BANDS)))
              .withColumn("flag", value_text(F.col("lastNotNull") / 100.0, dict(PEAK_MAPPING))))
    return flat(red, "lastNotNull", "mean", "status", "flag")


def q_progress_rate(spark, sf_dir):
    s = samples(spark, sf_dir)
    return flat(progress_rate(select_series(s, "records_per_second_total")),
                "ts_ms", "delta", "delta_ms", "rate")


def q_progress_rate_10s(spark, sf_dir):
    """Progress points at least 10 s apart, as the producer logs them."""
    s = samples(spark, sf_dir)
    return flat(progress_rate(select_series(s, "records_per_second_total"), lag_bucket_ms=300_000,
                              min_interval_ms=10_000), "ts_ms", "delta", "delta_ms", "rate")


def q_normalise_broker(spark, sf_dir):
    configure(spark)
    raw = broker_beans_from_events(read_table(spark, sf_dir, "events"))
    out = normalise_broker_samples(raw, flat=True)
    return out.select("metric", "topic", "partition", "request",
                      F.unix_millis("ts").alias("ts_ms"), "value")


def _report(spark, sf_dir):
    at, rng = event_bounds(spark, sf_dir)
    return scenario_report(stored_samples(spark, sf_dir), at, rng // 60_000, label="events-derived")


def q_scenario_report(spark, sf_dir):
    return _report(spark, sf_dir)


def q_report_csv_row(spark, sf_dir):
    return report_csv_row(_report(spark, sf_dir))


def q_report_csv_sink(spark, sf_dir):
    """SNK-5: the report row written as CSV with its header, read back."""
    row, path = q_report_csv_row(spark, sf_dir), shared_dir(spark, "report-csv")
    write_report_csv(row, path)
    return spark.read.schema(row.schema).option("header", True).option("enforceSchema", False).csv(path)


def _panels(spark, sf_dir):
    d = dashboard_panels(stored_samples(spark, sf_dir), *event_bounds(spark, sf_dir))
    return d.withColumn("value", F.round("value", 6))


def q_dashboard_panels(spark, sf_dir):
    return _panels(spark, sf_dir)


def q_panel_status(spark, sf_dir):
    return panel_status(_panels(spark, sf_dir)).withColumn("mean", F.round("mean", 4))


def q_broker_consumer_lag(spark, sf_dir):
    """The reference's consumer-lag panel on its own metric names: broker
    beans -> normaliser -> one sample per series and instant ->
    ``sum(kafka_server_fetcherlagmetrics_consumerlag{topic="orders"})`` per step."""
    configure(spark)
    raw = broker_beans_from_events(read_table(spark, sf_dir, "events"))
    s = with_series(latest_per_instant(normalise_broker_samples(raw, keep=("event_id",)),
                                       "event_id"))
    at, rng = event_bounds(spark, sf_dir)   # every event yields a bean
    lag = select_series(s, "kafka_server_fetcherlagmetrics_consumerlag", eq={"topic": "orders"})
    out = across(resample(lag, at, rng, STEP_MS), "sum")
    return out.withColumn("value", F.round("value", 2))


QUERIES = {
    "select_series_regex": q_select_series_regex,
    "instant_value": q_instant_value,
    "resample_15s": q_resample_15s,
    "over_time": q_over_time,
    "counter_rate": q_counter_rate,
    "tier_summary": q_tier_summary,
    "sum_by_pod": q_sum_by_pod,
    "count_by_phase": q_count_by_phase,
    "avg_pct": q_avg_pct,
    "ready_pods": q_ready_pods,
    "startup_latency": q_startup_latency,
    "watermark_lag": q_watermark_lag,
    "panel_last_mean": q_panel_last_mean,
    "progress_rate": q_progress_rate,
    "progress_rate_10s": q_progress_rate_10s,
    "normalise_broker": q_normalise_broker,
    "broker_consumer_lag": q_broker_consumer_lag,
    "scenario_report": q_scenario_report,
    "report_csv_row": q_report_csv_row,
    "report_csv_sink": q_report_csv_sink,
    "dashboard_panels": q_dashboard_panels,
    "panel_status": q_panel_status,
    "counter_rate_1h": q_counter_rate_1h,
}
