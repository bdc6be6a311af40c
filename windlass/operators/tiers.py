"""Roll-up tiers of a samples table: per series and step, a mergeable state.

A state covers the samples of a series in ``(step_end - step, step_end]``:
count, sum, extremes, first and last sample, and what was lost at counter
resets between them.  States of disjoint times merge in time order, so a tier
is built from the one below it, new samples are appended as further states,
and a range is answered exactly from the coarsest steps that lie in it, finer
ones at its edges, and raw samples in the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .timeseries import in_time_range, with_series

STEPS = (15_000, 300_000, 3_600_000)
STATE = ("n", "total", "low", "high", "first_ts", "first_value", "last_ts", "last_value", "lost")
_SCHEMA = ("metric string, _sk array<struct<key:string,value:string>>, step_end long, n long, total double, low double, "
           "high double, first_ts long, first_value double, last_ts long, last_value double, lost double, date date")


def _end_of(ts: Column, step_ms: int) -> Column:
    return (F.ceil(ts / F.lit(step_ms)) * step_ms).cast("long")


def raw_states(samples: DataFrame) -> DataFrame:
    """Every sample as a state of its own (metric, _sk, STATE)."""
    v, t = F.col("value"), F.col("ts_ms")
    of = {"n": F.lit(1).cast("long"), "total": v, "low": v, "high": v, "first_ts": t, "first_value": v,
          "last_ts": t, "last_value": v, "lost": F.lit(0.0)}
    return with_series(samples).select("metric", "_sk", *[of[c].alias(c) for c in STATE])


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per ``keys`` from states of disjoint times.  A value below the
    last one of the state before it lost that one.  Each key's states are
    ordered in one task: give it few per key (a step of the tier below, or the
    states of one series in a range)."""
    w = Window.partitionBy(*keys).orderBy("first_ts")
    before = F.lag("last_value").over(w)
    s = states.select(*keys, *STATE, F.when(F.col("first_value") < before, before).otherwise(F.lit(0.0)).alias("_edge"))
    return s.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first_ts").alias("first_ts"), F.min_by("first_value", "first_ts").alias("first_value"),
        F.max("last_ts").alias("last_ts"), F.max_by("last_value", "last_ts").alias("last_value"),
        (F.sum("lost") + F.sum("_edge")).alias("lost"))


def roll_up(states: DataFrame, step_ms: int) -> DataFrame:
    """States per series and step (step_end) from finer ones or samples."""
    return merge_states(states.withColumn("step_end", _end_of(F.col("last_ts"), step_ms)), ["metric", "_sk", "step_end"])


def append_tiers(samples: DataFrame, path: str, steps: Sequence[int] = STEPS) -> None:
    """Add samples to the tiers under ``path`` (one folder per step), each
    tier from the one below it.  Samples of one call must not lie between
    those of another in the same series and step: append in time order, one
    writer at a time.  Readers see an append when all its tiers are there."""
    spark, states = samples.sparkSession, raw_states(samples)
    number = len(_listed(spark, f"{path}/step={steps[0]}"))
    for step in steps:
        part = f"{path}/step={step}/append={number}"
        (roll_up(states, step).withColumn("date", F.to_date(F.timestamp_millis("step_end")))
         .repartitionByRange("date", "metric", "step_end").sortWithinPartitions("date", "metric", "step_end")
         .write.mode("overwrite").partitionBy("date").parquet(part))
        states = spark.read.schema(_SCHEMA).parquet(part).drop("step_end", "date")
    fs, p = _hadoop(spark, f"{path}/appends/{number}")
    fs.create(p, True).close()


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _hadoop(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def read_tier(spark: SparkSession, path: str, step_ms: int) -> DataFrame:
    """The states of a tier (metric, _sk, step_end, STATE, date); a step that
    several appends touch has several."""
    done = [int(n) for n in _listed(spark, f"{path}/appends") if n.isdigit()]
    tier = spark.read.schema(_SCHEMA + ", append int").option("basePath", f"{path}/step={step_ms}").parquet(
        f"{path}/step={step_ms}")
    return tier.where(F.col("append").isin(*done)).drop("append")


def cover(lo_ms: int, hi_ms: int, steps: Sequence[int] = STEPS) -> list[tuple[int, int, int]]:
    """``(lo, hi]`` as disjoint pieces (step, from, to], coarsest inside; step
    0 is raw samples."""
    if lo_ms >= hi_ms:
        return []
    for step in sorted(steps, reverse=True):
        a, b = -(-lo_ms // step) * step, hi_ms // step * step
        if a < b:
            finer = [x for x in steps if x < step]
            return cover(lo_ms, a, finer) + [(step, a, b)] + cover(b, hi_ms, finer)
    return [(0, lo_ms, hi_ms)]


def range_states(samples: DataFrame, path: str, at_ms: int, range_ms: int, metric: Sequence[str],
                 steps: Sequence[int] = STEPS) -> DataFrame:
    """One state per series over ``(at - range, at]``: whole steps come from
    the tiers, only the rest of the edges from ``samples``."""
    spark, out = samples.sparkSession, None
    for step, a, b in cover(at_ms - range_ms, at_ms, steps):
        if step:
            p = read_tier(spark, path, step).where(
                F.col("metric").isin(*metric) & (F.col("step_end") > a) & (F.col("step_end") <= b)
                & (F.col("date") >= F.to_date(F.timestamp_millis(F.lit(a)))) & (F.col("date") <= F.to_date(F.timestamp_millis(F.lit(b)))))
        else:
            p = raw_states(in_time_range(with_series(samples), a, b).where(F.col("metric").isin(*metric)))
        p = p.select("metric", "_sk", *STATE)
        out = p if out is None else out.unionByName(p)
    return merge_states(out, ["metric", "_sk"])


def increase() -> Column:
    """The reset-corrected increase between a state's first and last sample."""
    return F.col("last_value") - F.col("first_value") + F.col("lost")
