"""TS-21 scenario report and TS-22 dashboard panels over a samples table.

Each report figure is a small aggregate over a metric-filtered frame (the
metric filter reaches the scan, so a samples table partitioned by metric
reads only what a figure needs; figures that share a source share its
exchange).  Figures come back as ``(name, value)`` rows and are pivoted
into the single report row -- no cross joins of one-row frames.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import threshold_status, value_text
from ..operators.timeseries import (counter_rate, instant, reduce_panel, resample, series_labels,
                                    step_grid, vector_op, with_series)

# The report's columns in order.
REPORT_COLUMNS = [
    "timestamp", "label", "duration_min", "base_throughput", "peak_target",
    "send_rate_peak", "send_rate_avg", "messages_produced", "errors", "error_rate_peak",
    "latency_avg_ms", "latency_peak_ms", "broker_inbound_peak", "consumer_lag_peak",
    "consumer_lag_now", "records_peak", "records_avg", "backpressure_max_pct",
    "backpressure_avg_pct", "checkpoint_max_ms", "checkpoint_avg_ms", "workers_min",
    "workers_max", "workers_now",
]
# The names these columns have in the CSV header.
CSV_NAMES = {"records_peak": "flink_records_peak", "records_avg": "flink_records_avg",
             "workers_min": "tm_min", "workers_max": "tm_max", "workers_now": "tm_now"}
# Decimals per CSV column (rate 4, latencies 2, percentages 1,
# everything else 0).
DECIMALS = {"error_rate_peak": 4, "latency_avg_ms": 2, "latency_peak_ms": 2,
            "backpressure_max_pct": 1, "backpressure_avg_pct": 1}


@dataclass(frozen=True)
class Source:
    """A metric selector: name plus label matchers.  ``counter`` marks a
    monotonic counter (rates are taken of it); otherwise the series is a
    gauge."""
    metric: str
    eq: dict = field(default_factory=dict)
    ne: dict = field(default_factory=dict)
    regex: dict = field(default_factory=dict)
    counter: bool = False


# The metric names and selectors the reference's report reads
# (the deployment namespace is left to the caller: add it to ``eq``).
REFERENCE_SOURCES = {
    "send_rate": Source("kafka_producer_record_send_rate", {"application": "kafka-producer"}),
    "base_throughput": Source("producer_throughput_base", {"application": "kafka-producer"}),
    "current_throughput": Source("producer_throughput_current", {"application": "kafka-producer"}),
    "messages_produced": Source("producer_messages_produced", {"application": "kafka-producer"}),
    "errors": Source("producer_messages_errors", {"application": "kafka-producer"}),
    "error_rate": Source("kafka_producer_record_error_rate", {"application": "kafka-producer"}),
    "latency": Source("kafka_producer_request_latency_avg", {"application": "kafka-producer"}),
    "broker_inbound": Source("kafka_server_brokertopicmetrics_messagesin_oneminuterate",
                             {"topic": "orders"}),
    "consumer_lag": Source("kafka_server_fetcherlagmetrics_consumerlag", {"topic": "orders"}),
    "records_in": Source("flink_taskmanager_job_task_numRecordsInPerSecond"),
    "backpressure": Source("flink_taskmanager_job_task_isBackPressured"),
    "checkpoint": Source("flink_jobmanager_job_lastCheckpointDuration"),
    "ready": Source("kube_pod_status_ready", {"condition": "true"}),
}

# The same figures mapped onto the samples derived from the test tables.
TEST_SOURCES = {
    "send_rate": Source("records_per_second"),
    "base_throughput": Source("records_per_second"),
    "current_throughput": Source("checkpoint_ms"),
    "messages_produced": Source("records_per_second_total"),
    "errors": Source("consumer_lag_total"),
    "error_rate": Source("consumer_lag"),
    "latency": Source("checkpoint_ms"),
    "broker_inbound": Source("records_per_second_total", {"topic": "orders"}, counter=True),
    "consumer_lag": Source("consumer_lag", {"topic": "orders"}),
    "records_in": Source("checkpoint_ms_total", counter=True),
    "backpressure": Source("backpressured"),
    "checkpoint": Source("checkpoint_ms"),
    "ready": Source("pod_ready", {"topic": "orders"}),
}


# How each report column is computed -- (column, source key,
# stage, function).  Stages: per-series over time then result[0]
# ("series"), instant then result[0] / sum / count of ready ("instant_*"),
# per-step sum / avg / ready-count then over time ("step_*"), per-step sum
# of counter rates then over time ("rate").
FIGURES = [
    ("base_throughput", "base_throughput", "series", "max"),
    ("peak_target", "current_throughput", "series", "max"),
    ("send_rate_peak", "send_rate", "series", "max"),
    ("send_rate_avg", "send_rate", "series", "avg"),
    ("messages_produced", "messages_produced", "instant_first", None),
    ("errors", "errors", "instant_first", None),
    ("error_rate_peak", "error_rate", "series", "max"),
    ("latency_avg_ms", "latency", "series", "avg"),
    ("latency_peak_ms", "latency", "series", "max"),
    ("broker_inbound_peak", "broker_inbound", "rate", ("max", 60_000)),
    ("consumer_lag_peak", "consumer_lag", "step_sum", "max"),
    ("consumer_lag_now", "consumer_lag", "instant_sum", None),
    ("records_peak", "records_in", "rate", ("max", 30_000)),
    ("records_avg", "records_in", "rate", ("avg", 30_000)),
    ("backpressure_max_pct", "backpressure", "step_avg", "max"),
    ("backpressure_avg_pct", "backpressure", "step_avg", "avg"),
    ("checkpoint_max_ms", "checkpoint", "series", "max"),
    ("checkpoint_avg_ms", "checkpoint", "series", "avg"),
    ("workers_min", "ready", "step_ready", "min"),
    ("workers_max", "ready", "step_ready", "max"),
    ("workers_now", "ready", "instant_ready", None),
]


def _source_pred(src: Source) -> Column:
    """The selector of a Source as one boolean column (for tagging)."""
    from ..operators.timeseries import label
    cond = F.col("metric") == F.lit(src.metric)
    for k, v in src.eq.items():
        cond = cond & (label(k) == F.lit(v))
    for k, v in src.ne.items():
        cond = cond & (label(k) != F.lit(v))
    for k, v in src.regex.items():
        cond = cond & label(k).rlike(f"^(?:{v})$")
    return cond


def _tagged(df: DataFrame, sources: dict[str, Source], keys) -> DataFrame:
    """Rows of the selected sources, one copy per source key they match."""
    tags = F.array(*[F.when(_source_pred(sources[k]), F.lit(k)) for k in keys])
    return df.withColumn("src", F.explode(tags)).where(F.col("src").isNotNull())


def _union_pred(sources: dict[str, Source], keys) -> DataFrame:
    cond = F.lit(False)
    for k in keys:
        cond = cond | _source_pred(sources[k])
    return cond


def _with_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", series_labels("_sk"))


def _figure_rows(per_src: DataFrame, figures) -> DataFrame:
    """(name, value) rows from a one-row-per-source frame: each figure picks
    its source's row; one generator, so the frame is computed once."""
    picks = F.array(*[F.when(F.col("src") == F.lit(k),
                             F.struct(F.lit(name).alias("name"), v.cast("double").alias("value")))
                      for name, k, v in figures])
    return per_src.select(F.explode(picks).alias("_f")).where(F.col("_f").isNotNull()).select("_f.*")


def report_figures(samples: DataFrame, at_ms: int, minutes: int,
                   sources: dict[str, Source] = TEST_SOURCES,
                   compat_rate: bool = True) -> DataFrame:
    """All numeric report figures as (name, value) rows (missing = no row).

    One resample over every gauge source (rows tagged by source), one
    instant pass, one counter-rate pass for all rate figures; each figure is
    then a conditional aggregate over those small per-series / per-step
    frames.  The reference takes ``rate()`` of two series that are already
    per-second gauges, and so does the default; ``compat_rate=False`` reads
    a rate figure over a gauge from the gauge itself (sum per step).
    """
    s = with_series(samples)
    rng = int(minutes) * 60_000
    key = F.to_json(series_labels("_sk"))
    figures = [(n, k, st, f) if st != "rate" or sources[k].counter or compat_rate
               else (n, k, "step_sum", f[0]) for n, k, st, f in FIGURES]
    by_stage: dict[str, set] = {}
    for _, k, stage, _ in figures:
        by_stage.setdefault(stage.split("_")[0], set()).add(k)
    rows = []

    # per-series and per-step figures over the resampled grid
    res_keys = sorted(by_stage.get("series", set()) | by_stage.get("step", set()))
    if res_keys:
        r = resample(s.where(_union_pred(sources, res_keys)), at_ms, rng)
        t = _tagged(_with_labels(r), sources, res_keys)
        per_series = t.groupBy("src", "_sk").agg(
            F.max("value").alias("mx"), F.avg("value").alias("av"), F.min("value").alias("mn"))
        first = per_series.groupBy("src").agg(
            F.min_by(F.struct("mx", "av", "mn"), key).alias("f"))
        ready_keys = sorted({k for _, k, st, _ in figures if st == "step_ready"})
        grid = step_grid(s, at_ms, rng)
        zeros = None
        for k in ready_keys:
            z = grid.select(F.lit(k).alias("src"), "step", F.lit(None).cast("double").alias("value"))
            zeros = z if zeros is None else zeros.unionByName(z)
        steps_in = t.select("src", "step", "value")
        if zeros is not None:
            steps_in = steps_in.unionByName(zeros)
        per_step = steps_in.groupBy("src", "step").agg(
            F.sum("value").alias("sm"), F.avg("value").alias("av"),
            F.count_if(F.col("value") == 1.0).cast("double").alias("rd"))
        over_steps = per_step.groupBy("src").agg(
            F.max("sm").alias("sm_max"), F.avg("sm").alias("sm_avg"),
            F.max("av").alias("av_max"), F.avg("av").alias("av_avg"),
            F.min("rd").alias("rd_min"), F.max("rd").alias("rd_max"))
        rows.append(_figure_rows(first, [
            (name, k, F.col({"max": "f.mx", "avg": "f.av", "min": "f.mn"}[func]))
            for name, k, stage, func in figures if stage == "series"]))
        rows.append(_figure_rows(over_steps, [
            (name, k, F.col({"step_sum": "sm", "step_avg": "av", "step_ready": "rd"}[stage]
                            + "_" + func) * (100.0 if stage == "step_avg" else 1.0))
            for name, k, stage, func in figures if stage.startswith("step_")]))

    # instant figures
    inst_keys = sorted(by_stage.get("instant", set()))
    if inst_keys:
        i = _tagged(_with_labels(instant(s.where(_union_pred(sources, inst_keys)), at_ms)),
                    sources, inst_keys)
        per_src = i.groupBy("src").agg(
            F.min_by("value", key).alias("first"), F.sum("value").alias("total"),
            F.count_if(F.col("value") == 1.0).cast("double").alias("ready"))
        rows.append(_figure_rows(per_src, [
            (name, k, F.col({"instant_first": "first", "instant_sum": "total",
                             "instant_ready": "ready"}[stage]))
            for name, k, stage, _ in figures if stage.startswith("instant")]))

    # counter-rate figures: one scan and one delta pass for every rate
    # source, each row carrying its own window
    rate_tags = sorted({(k, f[1]) for _, k, st, f in figures if st == "rate"})
    if rate_tags:
        tag_src = {f"{k}@{w}": sources[k] for k, w in rate_tags}
        tagged = _tagged(s.where(_union_pred(tag_src, tag_src)), tag_src, sorted(tag_src))
        window = F.lit(None).cast("long")
        for k, w in rate_tags:
            window = F.when(F.col("src") == F.lit(f"{k}@{w}"), F.lit(w)).otherwise(window)
        rt = counter_rate(tagged, at_ms, rng, window, by=["src"],
                          max_window_ms=max(w for _, w in rate_tags))
        summed = rt.groupBy("src", "step").agg(F.sum("value").alias("v"))
        over = summed.groupBy("src").agg(F.max("v").alias("mx"), F.avg("v").alias("av"))
        rows.append(_figure_rows(over, [
            (name, f"{k}@{f[1]}", F.col({"max": "mx", "avg": "av"}[f[0]]))
            for name, k, stage, f in figures if stage == "rate"]))

    out = rows[0]
    for f in rows[1:]:
        out = out.unionByName(f)
    return out.where(F.col("value").isNotNull())


def scenario_report(samples: DataFrame, at_ms: int, minutes: int, label: str = "",
                    sources: dict[str, Source] = TEST_SOURCES, rounded: bool = True,
                    compat_rate: bool = True) -> DataFrame:
    """TS-21: the scenario report as one row in CSV column order; a figure
    with no data is null (written as ``N/A``).  ``rounded`` applies the
    CSV decimals (half-even, like C ``printf``)."""
    figs = report_figures(samples, at_ms, minutes, sources, compat_rate)
    numeric = [c for c in REPORT_COLUMNS[3:]]
    row = figs.groupBy().pivot("name", numeric).agg(F.first("value"))
    cols = []
    for c in numeric:
        v = F.col(c).cast("double")
        if c == "workers_now":  # count(...) or vector(0)
            v = F.coalesce(v, F.lit(0.0))
        if rounded:
            v = F.bround(v, DECIMALS.get(c, 0))
        cols.append(v.alias(c))
    ts = F.date_format(F.timestamp_millis(F.lit(at_ms)), "yyyy-MM-dd HH:mm:ss 'UTC'")
    return row.select(ts.alias("timestamp"), F.lit(label).alias("label"),
                      F.lit(int(minutes)).alias("duration_min"), *cols)


def report_csv_row(report: DataFrame) -> DataFrame:
    """SNK-5 text form, under the names of the CSV header: every figure with
    its decimals, ``N/A`` when missing."""
    cols = [F.col("timestamp"), F.col("label"), F.col("duration_min").cast("string")]
    for c in REPORT_COLUMNS[3:]:
        text = F.format_string(f"%.{DECIMALS.get(c, 0)}f", F.col(c))
        cols.append(F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(text).alias(CSV_NAMES.get(c, c)))
    return report.select(*cols)


# --------------------------------------------------------------------------
# dashboard
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class Panel:
    name: str
    kind: str          # gauge | sum_rate | sum | avg_pct | ready | sum_by_pod | rate_by_pod
    #                    | count_by_phase | diff | minus_time
    source: Source
    window_ms: int = 60_000
    scale: float = 1.0
    other: Source | None = None
    calcs: tuple[str, ...] = ()          # reducers of the legend or the stat
    bands: tuple = ()                    # (from value, colour), first from None
    mapping: tuple = ()                  # (value, text)


# The dashboard's colour bands and its value mapping.
PEAK_BANDS = ((None, "green"), (1.0, "red"))
ERROR_BANDS = ((None, "green"), (0.1, "red"))
INBOUND_BANDS = ((None, "green"), (1000.0, "yellow"), (4000.0, "red"))
LAG_BANDS = ((None, "green"), (5000.0, "yellow"), (50000.0, "red"))
BACKPRESSURE_BANDS = ((None, "green"), (25.0, "yellow"), (75.0, "red"))
PEAK_MAPPING = ((0.0, "INACTIVE"), (1.0, "PEAK"))

# The reference dashboard's 20 expressions (metric names,
# label matchers, rate windows, unit scaling); the deployment namespace is
# left to the caller.
_TM = {"pod": ".*taskmanager.*"}
REFERENCE_PANELS = [
    Panel("send_rate", "gauge", Source("kafka_producer_record_send_rate",
                                       {"application": "kafka-producer"})),
    Panel("throughput_current", "gauge", Source("producer_throughput_current",
                                                {"application": "kafka-producer"})),
    Panel("throughput_base", "gauge", Source("producer_throughput_base",
                                             {"application": "kafka-producer"})),
    Panel("peak_active", "gauge", Source("producer_peak_active",
                                         {"application": "kafka-producer"}),
          calcs=("lastNotNull",), bands=PEAK_BANDS, mapping=PEAK_MAPPING),
    Panel("messages_produced", "gauge", Source("producer_messages_produced",
                                               {"application": "kafka-producer"}),
          calcs=("lastNotNull",)),
    Panel("error_rate", "gauge", Source("kafka_producer_record_error_rate",
                                        {"application": "kafka-producer"}),
          bands=ERROR_BANDS),
    Panel("request_latency", "gauge", Source("kafka_producer_request_latency_avg",
                                             {"application": "kafka-producer"})),
    Panel("orders_inbound", "sum_rate",
          Source("kafka_server_brokertopicmetrics_messagesin_oneminuterate", {"topic": "orders"}),
          window_ms=60_000,
          bands=INBOUND_BANDS),
    Panel("consumer_lag", "sum", Source("kafka_server_fetcherlagmetrics_consumerlag",
                                        {"topic": "orders"}),
          bands=LAG_BANDS),
    Panel("records_per_second", "sum_rate",
          Source("flink_taskmanager_job_task_numRecordsInPerSecond"), window_ms=30_000),
    Panel("backpressure", "avg_pct", Source("flink_taskmanager_job_task_isBackPressured"),
          calcs=("lastNotNull",), bands=BACKPRESSURE_BANDS),
    Panel("checkpoint_duration", "gauge", Source("flink_jobmanager_job_lastCheckpointDuration")),
    Panel("active_workers", "ready", Source("kube_pod_status_ready", {"condition": "true"},
                                            regex=_TM)),
    Panel("heap_by_pod", "sum_by_pod", Source("flink_taskmanager_Status_JVM_Memory_Heap_Used"),
          calcs=("lastNotNull",)),
    Panel("cpu_by_pod", "rate_by_pod", Source("container_cpu_usage_seconds_total",
                                              ne={"container": ""}, regex=_TM),
          window_ms=60_000, scale=1000.0,
          calcs=("lastNotNull", "mean")),
    Panel("memory_by_pod", "sum_by_pod", Source("container_memory_working_set_bytes",
                                                ne={"container": ""}, regex=_TM),
          scale=1.0 / 1024.0 / 1024.0,
          calcs=("lastNotNull", "mean")),
    Panel("pods_by_phase", "count_by_phase", Source("kube_pod_status_phase", regex=_TM)),
    Panel("startup_latency", "diff", Source("kube_pod_status_ready_time", regex=_TM),
          other=Source("kube_pod_created", regex=_TM),
          calcs=("lastNotNull",)),
    Panel("watermark_lag", "minus_time", Source("flink_taskmanager_job_task_currentInputWatermark")),
    Panel("bytes_in", "sum", Source("kafka_server_brokertopicmetrics_bytesin_oneminuterate",
                                    {"topic": "orders"})),
]

# The 20 dashboard expressions mapped onto the test samples.
TEST_PANELS = [
    Panel("send_rate", "gauge", Source("records_per_second")),
    Panel("throughput_current", "gauge", Source("checkpoint_ms")),
    Panel("throughput_base", "gauge", Source("consumer_lag")),
    Panel("peak_active", "gauge", Source("backpressured"),
          calcs=("lastNotNull",), bands=PEAK_BANDS, mapping=PEAK_MAPPING),
    Panel("messages_produced", "gauge", Source("records_per_second_total"),
          calcs=("lastNotNull",)),
    Panel("error_rate", "gauge", Source("consumer_lag"),
          bands=ERROR_BANDS),
    Panel("request_latency", "gauge", Source("checkpoint_ms")),
    Panel("orders_inbound", "sum_rate", Source("records_per_second_total", {"topic": "orders"}),
          window_ms=60_000,
          bands=INBOUND_BANDS),
    Panel("consumer_lag", "sum", Source("consumer_lag", {"topic": "orders"}),
          bands=LAG_BANDS),
    Panel("records_per_second", "sum_rate", Source("checkpoint_ms_total"), window_ms=30_000),
    Panel("backpressure", "avg_pct", Source("backpressured"),
          calcs=("lastNotNull",), bands=BACKPRESSURE_BANDS),
    Panel("checkpoint_duration", "gauge", Source("checkpoint_ms")),
    Panel("active_workers", "ready", Source("pod_ready", regex={"pod": ".*worker.*"})),
    Panel("heap_by_pod", "sum_by_pod", Source("consumer_lag"),
          calcs=("lastNotNull",)),
    Panel("cpu_by_pod", "rate_by_pod", Source("checkpoint_ms_total", ne={"topic": ""},
                                              regex={"pod": ".*worker.*"}),
          window_ms=60_000, scale=1000.0,
          calcs=("lastNotNull", "mean")),
    Panel("memory_by_pod", "sum_by_pod", Source("records_per_second"),
          scale=1.0 / 1024.0 / 1024.0,
          calcs=("lastNotNull", "mean")),
    Panel("pods_by_phase", "count_by_phase", Source("pod_ready", regex={"pod": ".*worker.*"})),
    Panel("startup_latency", "diff", Source("records_per_second"),
          other=Source("checkpoint_ms"),
          calcs=("lastNotNull",)),
    Panel("watermark_lag", "minus_time", Source("checkpoint_ms")),
    Panel("bytes_in", "sum", Source("records_per_second", {"topic": "orders"})),
]


def _identity(labels: Column) -> Column:
    """A series' identity: its whole label set as JSON, names sorted."""
    return F.to_json(labels)


def _legend(series: str = "series") -> Column:
    """What a legend shows for a series: its pod, else its phase."""
    return F.coalesce(F.get_json_object(series, "$.pod"), F.get_json_object(series, "$.phase"), F.lit(""))


_RESAMPLED_KINDS = ("gauge", "minus_time", "diff", "sum", "avg_pct", "sum_by_pod",
                    "count_by_phase", "ready")
_GROUPED_KINDS = ("sum", "avg_pct", "sum_by_pod", "count_by_phase", "ready")


def _tag_panels(df: DataFrame, tags: list[tuple[str, str, Source]]) -> DataFrame:
    """Copy each row once per (panel, role) whose selector it matches."""
    cols = list(df.columns)
    if "labels" not in cols:
        df = df.withColumn("labels", series_labels("_sk"))
    arr = F.array(*[F.when(_source_pred(src), F.struct(F.lit(p).alias("panel"),
                                                       F.lit(role).alias("role")))
                    for p, role, src in tags])
    return (df.withColumn("_t", F.explode(arr)).where(F.col("_t").isNotNull())
            .select("_t.panel", "_t.role", *cols))


def _lookup(mapping: dict, key: Column, default=None) -> Column:
    expr = F.lit(default)
    for k, v in mapping.items():
        expr = F.when(key == F.lit(k), F.lit(v)).otherwise(expr)
    return expr


def dashboard_panels(samples: DataFrame, at_ms: int, range_ms: int,
                     panels: list[Panel] = TEST_PANELS, compat_rate: bool = True) -> DataFrame:
    """TS-22: every panel expression over ``(at - range, at]``, as
    ``(panel, step, series, legend, value)``; ``series`` is the whole label
    set of the result as JSON.

    Shared passes instead of one plan per panel: one resample over all
    gauge selectors (rows tagged with the panels that read them), one
    grouped aggregate for every per-step reduction, one :func:`vector_op`
    for difference panels, one counter-rate pass over all rate panels with
    a window per row.  ``compat_rate=False`` reads gauges of rate panels as
    they are (the same switch as in :func:`scenario_report`).
    """
    s = with_series(samples)
    if not compat_rate:
        plain = {"sum_rate": "sum", "rate_by_pod": "sum_by_pod"}
        panels = [p if p.source.counter else replace(p, kind=plain.get(p.kind, p.kind)) for p in panels]
    kinds = {p.name: p.kind for p in panels}
    scales = {p.name: float(p.scale) for p in panels}
    kind = _lookup(kinds, F.col("panel"))
    series = _identity(series_labels("_sk"))
    by = lambda k: _identity(F.create_map(F.lit(k), F.coalesce(series_labels("_sk")[k], F.lit(""))))
    parts = []

    tags = []
    for p in panels:
        if p.kind in _RESAMPLED_KINDS:
            tags.append((p.name, "L", p.source))
            if p.kind == "diff":
                tags.append((p.name, "R", p.other))
    if tags:
        sel = F.lit(False)
        for _, _, src in tags:
            sel = sel | _source_pred(src)
        r = resample(s.where(sel), at_ms, range_ms).drop("sample_ts")
        t = _tag_panels(r, tags)
        # per-series panels
        ident = t.where(kind.isin("gauge", "minus_time") & (F.col("role") == "L"))
        parts.append(ident.select(
            "panel", "step", series.alias("series"),
            F.when(kind == "minus_time", F.col("value") - F.col("step").cast("double") * 1.0)
            .otherwise(F.col("value")).alias("value")))
        for p in panels:
            if p.kind == "diff":
                d = vector_op(t.where(F.col("panel") == p.name), F.col("role") == "L", F.col("role") == "R")
                parts.append(d.select(F.lit(p.name).alias("panel"), "step", series.alias("series"), "value"))
        # per-step reductions (sum, avg x100, sum by pod, count by phase, ready or 0)
        grouped = t.where(kind.isin(*_GROUPED_KINDS))
        gkey = (F.when(kind == "sum_by_pod", by("pod")).when(kind == "count_by_phase", by("phase"))
                .otherwise(F.lit("{}")))
        g_in = grouped.select("panel", "step", gkey.alias("series"), "value")
        ready = [p.name for p in panels if p.kind == "ready"]
        if ready:
            grid = step_grid(s, at_ms, range_ms)
            names = F.array(*[F.lit(n) for n in ready])
            g_in = g_in.unionByName(grid.select(
                F.explode(names).alias("panel"), "step", F.lit("{}").alias("series"),
                F.lit(None).cast("double").alias("value")))
        agg = g_in.groupBy("panel", "step", "series").agg(
            F.sum("value").alias("_sum"), F.avg("value").alias("_avg"),
            F.count("value").cast("double").alias("_cnt"),
            F.count_if(F.col("value") == 1.0).cast("double").alias("_rdy"))
        parts.append(agg.select(
            "panel", "step", "series",
            F.when(kind.isin("sum", "sum_by_pod"), F.col("_sum"))
            .when(kind == "avg_pct", F.col("_avg") * F.lit(100.0))
            .when(kind == "count_by_phase", F.col("_cnt"))
            .when(kind == "ready", F.col("_rdy")).alias("value")))

    rp = [p for p in panels if p.kind in ("sum_rate", "rate_by_pod")]
    if rp:
        # one scan and one delta pass for every rate panel (per-row window)
        sel = F.lit(False)
        for p in rp:
            sel = sel | _source_pred(p.source)
        tagged = _tag_panels(s.where(sel), [(p.name, "L", p.source) for p in rp])
        window = _lookup({p.name: p.window_ms for p in rp}, F.col("panel"))
        rt = counter_rate(tagged.drop("role"), at_ms, range_ms, window, by=["panel"],
                          max_window_ms=max(p.window_ms for p in rp))
        gkey = F.when(kind == "rate_by_pod", by("pod")).otherwise(F.lit("{}"))
        parts.append(rt.groupBy("panel", "step", gkey.alias("series"))
                     .agg(F.sum("value").alias("value")))

    out = parts[0]
    for f in parts[1:]:
        out = out.unionByName(f)
    return out.select("panel", "step", "series", _legend().alias("legend"),
                      (F.col("value") * _lookup(scales, F.col("panel"), 1.0)).alias("value"))


def panel_status(values: DataFrame, panels: list[Panel] = TEST_PANELS) -> DataFrame:
    """TS-19, SC-8, SC-9: what the dashboard shows of each panel's series:
    ``last_value`` (latest non-null), ``mean`` where the panel asks for it,
    the colour band of the last value, and its mapped text."""
    mean = F.col("panel").isin(*[p.name for p in panels if "mean" in p.calcs])
    red = reduce_panel(values, ("lastNotNull", "mean"))
    last, status, text = F.col("lastNotNull"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in panels:
        mine = F.col("panel") == F.lit(p.name)
        if p.bands:
            status = F.when(mine, threshold_status("lastNotNull", list(p.bands))).otherwise(status)
        if p.mapping:
            text = F.when(mine, value_text(last, dict(p.mapping))).otherwise(text)
    return red.select("panel", "series", "legend", last.alias("last_value"),
                      F.when(mean, F.col("mean")).alias("mean"), status.alias("status"), text.alias("text"))
