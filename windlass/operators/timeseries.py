"""Time-series operators over labelled samples (metric, labels, ts, value).

These are the questions the reference asks of its metric store (selectors,
instant values, step-aligned subqueries, ``*_over_time``, counter ``rate``
with extrapolation, aggregation across series, ``or vector(0)``, one-to-one
vector arithmetic), written as batch DataFrame plans.

Times are epoch milliseconds (long).  A *series* is (metric, labels); the
label map is carried as its key-sorted entry array ``_sk`` so it can be a
grouping and join key.  Ranges are left-open ``(t - range, t]``.

Scale notes: every per-series step is either a grouped aggregate with
map-side partials, or a window whose partition holds at most one row per
grid step of one series (bounded by range / step, not by sample density);
the only per-sample orderings (counter resets, neighbours) use
:mod:`windlass.operators.ordering`, partitioned by series x time bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import follow, next_at, series_lag, series_running

STEP_MS = 15_000
LOOKBACK_MS = 300_000


# --------------------------------------------------------------------------
# series keys and selection
# --------------------------------------------------------------------------

def with_series(samples: DataFrame) -> DataFrame:
    """Add ``ts_ms`` (epoch ms) and ``_sk`` (key-sorted label entries)."""
    cols = samples.columns
    add = []
    if "ts_ms" not in cols:
        add.append(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    if "_sk" not in cols:
        # No labels is the empty label set, also as a join key.
        add.append(F.coalesce(F.array_sort(F.map_entries(F.col("labels"))), F.array()).alias("_sk"))
    return samples.select("*", *add) if add else samples


def in_time_range(df: DataFrame, lo_ms: int, hi_ms: int) -> DataFrame:
    """Rows with ``lo_ms < ts_ms <= hi_ms``.  Besides the exact millisecond
    test, an equivalent predicate on the raw ``ts`` column (and on ``date``
    when the table is partitioned by it) is added so a parquet scan can
    prune partitions and skip row groups."""
    cond = (F.col("ts_ms") > F.lit(lo_ms)) & (F.col("ts_ms") <= F.lit(hi_ms))
    cols = df.columns
    if "ts" in cols:
        ts = F.col("ts").cast("timestamp")
        cond = (cond & (ts >= F.timestamp_millis(F.lit(lo_ms + 1)))
                & (ts < F.timestamp_millis(F.lit(hi_ms + 1))))
    if "date" in cols:
        cond = (cond & (F.col("date") >= F.to_date(F.timestamp_millis(F.lit(lo_ms + 1))))
                & (F.col("date") <= F.to_date(F.timestamp_millis(F.lit(hi_ms)))))
    return df.where(cond)


def series_labels(sk: Column | str = "_sk") -> Column:
    """Label map back from the sorted entry array."""
    c = F.col(sk) if isinstance(sk, str) else sk
    return F.map_from_entries(c)


def label(name: str, labels: Column | str = "labels") -> Column:
    """A label's value; a missing label reads as the empty string."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(c[name], F.lit(""))


def latest_per_instant(samples: DataFrame, order: str) -> DataFrame:
    """One sample per series and instant: on equal timestamps the row with
    the largest ``order`` value wins (a grouped aggregate, map-side
    combined).  Returns SAMPLES columns."""
    s = with_series(samples)
    g = s.groupBy("metric", "_sk", "ts").agg(F.max_by("value", order).alias("value"))
    return g.select("metric", series_labels("_sk").alias("labels"), "ts", "value")


def select_series(samples: DataFrame, metric: str | Sequence[str] | None = None,
                  eq: Mapping[str, str] | None = None, ne: Mapping[str, str] | None = None,
                  regex: Mapping[str, str] | None = None,
                  not_regex: Mapping[str, str] | None = None) -> DataFrame:
    """TS-1/TS-2: metric name and label matchers (``=``, ``!=``, ``=~``,
    ``!~``); regexes are fully anchored.  The metric predicate is a plain
    column filter, so it reaches a parquet scan / partition pruning."""
    df = samples
    if metric is not None:
        names = [metric] if isinstance(metric, str) else list(metric)
        df = df.where(F.col("metric").isin(*names))
    for k, v in (eq or {}).items():
        df = df.where(label(k) == F.lit(v))
    for k, v in (ne or {}).items():
        df = df.where(label(k) != F.lit(v))
    for k, v in (regex or {}).items():
        df = df.where(label(k).rlike(f"^(?:{v})$"))
    for k, v in (not_regex or {}).items():
        df = df.where(~label(k).rlike(f"^(?:{v})$"))
    return df


# --------------------------------------------------------------------------
# instants and step grids
# --------------------------------------------------------------------------

def grid_bounds(at_ms: int, range_ms: int, step_ms: int = STEP_MS) -> tuple[int, int]:
    """First and last aligned step of a subquery ``[range:step]`` evaluated
    at ``at_ms``: multiples of ``step_ms`` in ``(at - range, at]``."""
    first = ((at_ms - range_ms) // step_ms + 1) * step_ms
    last = (at_ms // step_ms) * step_ms
    return first, last


def step_grid(df_for_session: DataFrame, at_ms: int, range_ms: int,
              step_ms: int = STEP_MS) -> DataFrame:
    """The subquery's evaluation steps as a one-column frame ``step``."""
    first, last = grid_bounds(at_ms, range_ms, step_ms)
    spark = df_for_session.sparkSession
    n = max(0, (last - first) // step_ms + 1)
    return spark.range(0, n).select((F.lit(first) + F.col("id") * step_ms).alias("step"))


def instant(samples: DataFrame, at_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """TS-3: per series, the latest sample in ``(at - lookback, at]``."""
    s = in_time_range(with_series(samples), at_ms - lookback_ms, at_ms)
    return (s.groupBy("metric", "_sk").agg(F.max_by("value", "ts_ms").alias("value"))
            .select("metric", "_sk", F.lit(at_ms).cast("long").alias("step"), "value"))


def resample(samples: DataFrame, at_ms: int, range_ms: int, step_ms: int = STEP_MS,
             lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """TS-4: the subquery grid.  For every series and aligned step ``s`` in
    ``(at - range, at]``: the latest sample with ``s - lookback < ts <= s``.

    Samples are first reduced to the latest one per (series, step bucket)
    with a map-side-combined aggregate; each survivor is then expanded to
    the steps it answers (until the next bucket or the lookback runs out).
    """
    first, last = grid_bounds(at_ms, range_ms, step_ms)
    s = with_series(samples)
    bucket = (F.ceil(F.col("ts_ms") / F.lit(step_ms)) * step_ms).cast("long")
    b = (in_time_range(s, first - lookback_ms, last)
         .groupBy("metric", "_sk", bucket.alias("_b"))
         .agg(F.max_by("value", "ts_ms").alias("value"), F.max("ts_ms").alias("sample_ts")))
    w = Window.partitionBy("metric", "_sk").orderBy("_b")
    b = b.select("*", F.lead("_b").over(w).alias("_nb"))
    stale = (F.floor((F.col("sample_ts") + F.lit(lookback_ms - 1)) / F.lit(step_ms)) * step_ms)
    upto = F.least(F.coalesce(F.col("_nb") - step_ms, F.lit(last)), stale.cast("long"), F.lit(last))
    frm = F.greatest(F.col("_b"), F.lit(first))
    steps = F.when(frm <= upto, F.sequence(frm, upto, F.lit(step_ms).cast("long")))
    return b.select("metric", "_sk", F.explode(steps).alias("step"), "value", "sample_ts")


def over_time(resampled: DataFrame, *funcs: str) -> DataFrame:
    """TS-5/6/7 (and count/last/sum): reduce each series over its steps.
    One function gives a ``value`` column; several give one column per
    function name, all from a single aggregation."""
    v = F.col("value")
    known = {"max": F.max(v), "min": F.min(v), "avg": F.avg(v), "sum": F.sum(v),
             "count": F.count(v), "last": F.max_by(v, "step")}
    keys = [c for c in ("metric", "_sk") if c in resampled.columns]
    if len(funcs) == 1:
        return resampled.groupBy(*keys).agg(known[funcs[0]].alias("value"))
    return resampled.groupBy(*keys).agg(*[known[f].alias(f) for f in funcs])


# --------------------------------------------------------------------------
# counter rate
# --------------------------------------------------------------------------

def counter_rate(samples: DataFrame, at_ms: int, range_ms: int, window_ms: int | Column,
                 step_ms: int = STEP_MS, is_counter: bool = True, is_rate: bool = True,
                 lag_bucket_ms: int = 3_600_000, by: Sequence[str] = (),
                 max_window_ms: int | None = None) -> DataFrame:
    """TS-8: ``rate(x[window])`` at every aligned step of ``(at - range, at]``
    (``increase`` with ``is_rate=False``, ``delta`` with ``is_counter=False``).

    Every sample knows its position in the series and the running sum of what
    was lost at resets (:func:`series_running`), so a window ``(s - window, s]``
    needs its first and its last sample only: the increase is the difference of
    their values and of their running sums, the count that of their positions.
    A sample is the last one of the steps until the next sample, and the first
    one of the steps whose windows begin after the sample before it: two rows
    per step of a series, however long the window, meet in one hash aggregate.
    Steps with fewer than two samples give no row.  Extrapolation follows the
    Prometheus rule (to the range edge when within 1.1 x the mean sample
    gap, else half a gap; counters never extrapolate below zero).

    ``window_ms`` may be a column (one window per row, constant within a
    series of ``by`` keys) so several rates share one scan and one delta
    pass; ``max_window_ms`` then bounds the time range read.
    """
    first, last = grid_bounds(at_ms, range_ms, step_ms)
    if isinstance(window_ms, Column):
        w, wmax = window_ms, int(max_window_ms)
    else:
        w, wmax = F.lit(int(window_ms)), int(window_ms)
    keys = ["metric", "_sk", *by]
    s = in_time_range(with_series(samples), first - wmax, last)
    s = series_running(s.select(*keys, "ts_ms", "value", w.cast("long").alias("_w")), [*keys, "_w"],
                       bucket_ms=lag_bucket_ms)
    ts, step = F.col("ts_ms"), F.lit(step_ms).cast("long")

    def steps(low: Column, below: Column) -> Column:
        """The steps from ``low`` on and before ``below``, within the grid."""
        frm = F.greatest((F.ceil(low / F.lit(step_ms)) * step_ms).cast("long"), F.lit(first))
        to = F.least(((F.ceil(below / F.lit(step_ms)) - 1) * step_ms).cast("long"), F.lit(last))
        return F.coalesce(F.when(frm <= to, F.sequence(frm, to, step)), F.array().cast("array<bigint>"))
    gone = ts + F.col("_w")                        # the first instant whose window has left the sample behind
    as_last = steps(ts, F.least("next_ts", gone))
    as_first = steps(F.greatest(F.col("prev_ts") + F.col("_w"), ts), gone)
    tagged = lambda ss, is_last: F.transform(ss, lambda x: F.struct(
        x.alias("step"), F.lit(is_last).alias("_is_last")))
    g = s.select(*keys, "_w", "ts_ms", "value", "pos", "resets",
                 F.inline(F.concat(tagged(as_last, True), tagged(as_first, False))))
    end = lambda c, is_last: F.max(F.when(F.col("_is_last") == F.lit(is_last), F.col(c)))
    g = g.groupBy(*keys, "_w", "step").agg(
        (end("pos", True) - end("pos", False) + 1).alias("_n"), end("ts_ms", False).alias("_ft"),
        end("ts_ms", True).alias("_lt"), end("value", False).alias("_fv"), end("value", True).alias("_lv"),
        (end("resets", True) - end("resets", False)).alias("_lost"))
    result = F.col("_lv") - F.col("_fv")
    if is_counter:
        result = result + F.col("_lost")
    return g.where(F.col("_n") >= 2).select(
        *keys, "step",
        extrapolate(result, F.col("_ft"), F.col("_lt"), F.col("_fv"),
                    F.col("_n"), F.col("step"), F.col("_w"), is_counter, is_rate).alias("value"))


def extrapolate(result: Column, first_ts: Column, last_ts: Column, first_v: Column,
                n: Column, at: Column, window_ms: int | Column, is_counter: bool,
                is_rate: bool) -> Column:
    """The extrapolated-rate factor applied to ``result`` (sample times in
    ms, durations in seconds; operation order kept for bitwise results)."""
    w = window_ms if isinstance(window_ms, Column) else F.lit(int(window_ms))
    sampled = (last_ts - first_ts) / F.lit(1000.0)
    avg_gap = sampled / (n - 1).cast("double")
    to_start = (first_ts - (at - w)) / F.lit(1000.0)
    to_end = (at - last_ts) / F.lit(1000.0)
    threshold = avg_gap * F.lit(1.1)
    to_start = F.when(to_start >= threshold, avg_gap / F.lit(2.0)).otherwise(to_start)
    if is_counter:
        # Never extrapolate a counter below zero (guarded: no zero division).
        to_zero = sampled * (first_v / result)
        to_start = F.when((result > 0) & (first_v >= 0),
                          F.when(to_zero < to_start, to_zero).otherwise(to_start)
                          ).otherwise(to_start)
    to_end = F.when(to_end >= threshold, avg_gap / F.lit(2.0)).otherwise(to_end)
    interval = sampled + to_start + to_end
    factor = F.when(sampled > 0, interval / sampled)
    if is_rate:
        factor = factor / (w.cast("double") / F.lit(1000.0))
    return result * factor


# --------------------------------------------------------------------------
# aggregation across series, set operations, arithmetic
# --------------------------------------------------------------------------

def across(df: DataFrame, func: str, by: Iterable[str] = (), scale: float | None = None) -> DataFrame:
    """TS-9..12: ``sum|avg|count|min|max by (labels...)`` per step.  The
    result has one row per (step, by-labels); label columns are named after
    the labels."""
    by = list(by)
    d = df
    labels = series_labels("_sk")
    for k in by:
        d = d.withColumn(k, F.coalesce(labels[k], F.lit("")))
    v = F.col("value")
    agg = {"sum": F.sum(v), "avg": F.avg(v), "count": F.count(v), "min": F.min(v),
           "max": F.max(v)}[func]
    if func == "count":
        agg = agg.cast("double")
    out = d.groupBy("step", *by).agg(agg.alias("value"))
    if scale is not None:
        out = out.withColumn("value", F.col("value") * F.lit(scale))
    return out


def value_filter(df: DataFrame, op: str, x: float) -> DataFrame:
    """TS-13: comparison filter (``== 1`` etc.) on sample values."""
    v = F.col("value")
    cond = {"==": v == x, "!=": v != x, ">": v > x, ">=": v >= x, "<": v < x, "<=": v <= x}[op]
    return df.where(cond)


def or_zero(per_step: DataFrame, grid: DataFrame) -> DataFrame:
    """TS-14: ``... or vector(0)`` for a label-less per-step result: steps
    with no value get 0.  A union + aggregate on step (no join)."""
    zeros = grid.select("step", F.lit(None).cast("double").alias("value"))
    both = per_step.select("step", "value").unionByName(zeros)
    return both.groupBy("step").agg(
        F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))


def _matched(g: DataFrame, op: str) -> DataFrame:
    """Result of ``op`` per (labels, step) from ``_lv/_rv`` and the operand
    counts ``_nl/_nr``; several operands on one label set are an error."""
    lv, rv = F.col("_lv"), F.col("_rv")
    val = {"-": lv - rv, "+": lv + rv, "*": lv * rv, "/": lv / rv}[op]
    many = (F.col("_nl") > 1) | (F.col("_nr") > 1)
    return (g.where((F.col("_nl") > 0) & (F.col("_nr") > 0))
            .select("_sk", "step", F.when(many, F.raise_error(F.concat(
                F.lit("several series match on one side for labels "), F.to_json(series_labels("_sk"))))
                .cast("double")).otherwise(val).alias("value")))


def binary_op(left: DataFrame, right: DataFrame, op: str = "-") -> DataFrame:
    """TS-15: one-to-one vector arithmetic on identical label sets (metric
    name dropped), per step.  Written as a union and one aggregation on
    (labels, step) instead of a join.  Two series of one side on the same
    label set stop the query, as the reference's engine does."""
    both = (left.select("_sk", "step", "value", F.lit(True).alias("_left"))
            .unionByName(right.select("_sk", "step", "value", F.lit(False).alias("_left"))))
    return vector_op(both, F.col("_left"), ~F.col("_left"), op)


def vector_op(df: DataFrame, left: Column, right: Column, op: str = "-") -> DataFrame:
    """TS-15 on one frame: the two operand vectors are the rows matching
    ``left`` and ``right`` (e.g. two metric names of one resample), matched
    on identical label sets per step in a single aggregation."""
    v = F.col("value")
    return _matched(df.groupBy("_sk", "step").agg(
        F.max(F.when(left, v)).alias("_lv"), F.max(F.when(right, v)).alias("_rv"),
        F.count(F.when(left, v)).alias("_nl"), F.count(F.when(right, v)).alias("_nr")), op)


def minus_time(df: DataFrame, scale_ms: float = 1.0) -> DataFrame:
    """TS-16: ``x - time() * 1000`` -- value minus the step instant (ms)."""
    return df.withColumn("value", F.col("value") - F.col("step").cast("double") * F.lit(scale_ms))


def first_series(df: DataFrame) -> DataFrame:
    """TS-18: the first series of a result (``result[0]``), made
    deterministic by ordering on the label set.  A top-1, so each partition
    keeps one candidate."""
    key = F.to_json(series_labels("_sk")) if "_sk" in df.columns else F.lit("")
    return df.withColumn("_key", key).orderBy("_key").limit(1).drop("_key")


def reduce_panel(df: DataFrame, calcs: Sequence[str] = ("lastNotNull", "mean")) -> DataFrame:
    """TS-19: legend reducers per series over its steps."""
    v = F.col("value")
    known = {"lastNotNull": F.max_by(v, F.when(v.isNotNull(), F.col("step"))),
             "mean": F.avg(v), "max": F.max(v), "min": F.min(v)}
    keys = [c for c in df.columns if c not in ("step", "value", "sample_ts")]
    return df.groupBy(*keys).agg(*[known[c].alias(c) for c in calcs])


def spaced(samples: DataFrame, min_interval_ms: int, bucket_ms: int = 3_600_000) -> DataFrame:
    """The points that a reporter logging at most every ``min_interval_ms``
    keeps of each series: the first, then each first one at least that much
    later than the last kept.  One sample per instant is expected.

    Every point knows which one would be kept next (:func:`next_at`); the kept
    ones are those reached from the first, found by pointer doubling
    (:func:`follow`).  All of it is on rows, so neither a series nor a stretch
    of it is ever gathered."""
    s = with_series(samples).select("metric", "_sk", "ts_ms", "value").withColumn("_key", F.struct("metric", "_sk"))
    points = s.select("_key", F.col("ts_ms").alias("at"))
    pointers = next_at(points, min_interval_ms, bucket_ms)
    kept = follow(pointers, points.groupBy("_key").agg(F.min("at").alias("at")))
    kept = kept.select(F.col("_key").alias("_k"), "at")
    return (s.join(kept, (F.col("_key") == F.col("_k")) & (F.col("ts_ms") == F.col("at")))
            .select("metric", "_sk", "ts_ms", "value"))


def progress_rate(samples: DataFrame, lag_bucket_ms: int = 3_600_000,
                  min_interval_ms: int = 0) -> DataFrame:
    """TS-20: rate between consecutive progress points of a counter,
    ``(delta * 1000) div max(1, delta_ms)`` in whole units per second.
    With ``min_interval_ms`` the points are first thinned as a reporter does
    that logs at most that often (:func:`spaced`)."""
    s = spaced(samples, min_interval_ms, lag_bucket_ms) if min_interval_ms else with_series(samples)
    s = series_lag(s, ["metric", "_sk"], "ts_ms", ["value"], bucket_ms=lag_bucket_ms)
    delta = (F.col("value") - F.col("prev_value")).cast("long")
    dt = F.greatest(F.lit(1), F.col("ts_ms") - F.col("prev_ts_ms"))
    rate = F.expr("(CAST(value - prev_value AS BIGINT) * 1000) div greatest(1, ts_ms - prev_ts_ms)")
    return (s.where(F.col("prev_ts_ms").isNotNull())
            .select("metric", "_sk", "ts_ms", delta.alias("delta"), dt.alias("delta_ms"),
                    rate.alias("rate")))
