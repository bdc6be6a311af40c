"""Series dictionary: samples by number, selectors on an inverted label index.

A samples table repeats its label maps in every row, and a matcher over it
looks at every sample.  Here a series (metric, label set) gets a number once;
``series`` holds the label sets, ``index`` the series of each label value (the
metric is the label ``__name__``), and ``samples`` only (series_id, ts, value),
partitioned by date and page of numbers.  Matchers, regular expressions too,
run once per label value of the index; the numbers they leave prune the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import global_rank
from .timeseries import series_labels, with_series

#: Numbers of one page (a partition of the samples), and the most numbers that
#: are written into a scan's filter; a wider selection is joined.
PAGE, LISTED = 256, 4096
_NAME = "__name__"


def series_dictionary(samples: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(series_id, metric, _sk) of every series, numbered from 0 by metric and
    labels, so that a metric's series are neighbours.  With ``known``, an
    earlier dictionary, its numbers stay and new series follow."""
    s = with_series(samples).select("metric", "_sk").distinct()
    base = 0
    if known is not None:
        old = known.select(F.struct("metric", "_sk").alias("_k"))
        s = s.withColumn("_k", F.struct("metric", "_sk")).join(old, "_k", "left_anti").drop("_k")
        base = (known.agg(F.max("series_id")).first()[0] or 0) + 1 if not known.isEmpty() else 0
    new = global_rank(s, ["metric", "_sk"], "_no").select((F.col("_no") + F.lit(base)).alias("series_id"), "metric", "_sk")
    return new if known is None else known.select("series_id", "metric", "_sk").unionByName(new)


def label_index(series: DataFrame) -> DataFrame:
    """(name, value, series_id): the series of every label value."""
    labels = F.concat("_sk", F.array(F.struct(F.lit(_NAME).alias("key"), F.col("metric").alias("value"))))
    return series.select("series_id", F.inline(labels)).select(F.col("key").alias("name"), "value", "series_id")


def write_series(samples: DataFrame, path: str) -> None:
    """Append samples (metric, labels, ts, value) to the tables under ``path``:
    new series are numbered after the old ones.  One writer at a time."""
    spark = samples.sparkSession
    known = read_table(spark, path, "series")
    dictionary = series_dictionary(samples, known)
    fresh = dictionary if known is None else dictionary.join(known.select("series_id"), "series_id", "left_anti")
    fresh.write.mode("append").parquet(f"{path}/series")
    series = read_table(spark, path, "series")
    added = series if known is None else series.where(F.col("series_id") > F.lit(known.agg(F.max("series_id")).first()[0]))
    (label_index(added).repartitionByRange("name", "value", "series_id").sortWithinPartitions("name", "value", "series_id")
     .write.mode("append").parquet(f"{path}/index"))
    number = series.select(F.struct("metric", "_sk").alias("_k"), "series_id")
    out = (with_series(samples).withColumn("_k", F.struct("metric", "_sk")).join(number, "_k")
           .select("series_id", "ts", "value", F.to_date("ts").alias("date"),
                   F.expr(f"series_id div {PAGE}").alias("page")))
    (out.repartitionByRange("date", "page", "ts").sortWithinPartitions("date", "page", "series_id", "ts")
     .write.mode("append").partitionBy("date", "page").parquet(f"{path}/samples"))


_SCHEMAS = {"series": "series_id long, metric string, _sk array<struct<key:string,value:string>>",
            "index": "name string, value string, series_id long",
            "samples": "series_id long, ts timestamp, value double, date date, page long"}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table under ``path``, or None if nothing was written yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")


def select_ids(index: DataFrame, metric: str | Sequence[str] | None = None, eq: Mapping[str, str] | None = None,
               ne: Mapping[str, str] | None = None, regex: Mapping[str, str] | None = None,
               not_regex: Mapping[str, str] | None = None) -> DataFrame:
    """TS-1/TS-2 on the index: (series_id) of the series that fit every
    matcher (``select_series`` has the same ones).  A missing label reads as
    the empty string: a matcher that the empty string fits leaves out the
    series with another value that does not, any other one keeps the series
    with a value that does.  Each works on the distinct values of one label."""
    anchored = lambda v: lambda c: c.rlike(f"^(?:{v})$")
    tests = []
    if metric is not None:
        names = [metric] if isinstance(metric, str) else list(metric)
        tests.append((_NAME, lambda c: c.isin(*names)))
    tests += [(k, lambda c, v=v: c == F.lit(v)) for k, v in (eq or {}).items()]
    tests += [(k, lambda c, v=v: c != F.lit(v)) for k, v in (ne or {}).items()]
    tests += [(k, anchored(v)) for k, v in (regex or {}).items()]
    tests += [(k, lambda c, t=anchored(v): ~t(c)) for k, v in (not_regex or {}).items()]
    empty = index.sparkSession.range(1).select(*[t(F.lit("")).alias(f"t{i}") for i, (_, t) in enumerate(tests)]).first()
    ids = None
    # Those that keep series first: they are the narrow ones.
    for (k, fits), missing in sorted(zip(tests, empty), key=lambda x: x[1]):
        of = index.where(F.col("name") == k)
        values = of.select("value").distinct()
        if not missing:
            hit = of.join(values.where(fits(F.col("value"))), "value", "left_semi").select("series_id").distinct()
            ids = hit if ids is None else ids.join(hit, "series_id", "left_semi")
        else:
            bad = of.join(values.where(~fits(F.col("value"))), "value", "left_semi").select("series_id")
            every = index.where(F.col("name") == _NAME).select("series_id")
            ids = (every if ids is None else ids).join(bad, "series_id", "left_anti")
    return index.where(F.col("name") == _NAME).select("series_id") if ids is None else ids


def select_samples(spark: SparkSession, path: str, **matchers) -> DataFrame:
    """The samples (metric, _sk, labels, ts, value, date) of the selected
    series under ``path``.  Up to LISTED numbers become a filter of the scan
    (pages and row groups without them are not read); more are joined."""
    series, samples = read_table(spark, path, "series"), read_table(spark, path, "samples")
    ids = select_ids(read_table(spark, path, "index"), **matchers)
    few = [r.series_id for r in ids.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        series = series.where(F.col("series_id").isin(*few))
        samples = samples.where(F.col("page").isin(*{i // PAGE for i in few}) & F.col("series_id").isin(*few))
    else:
        samples = samples.join(ids, "series_id", "left_semi")
    return samples.join(series, "series_id").select(
        "metric", "_sk", series_labels("_sk").alias("labels"), "ts", F.unix_millis("ts").alias("ts_ms"), "value", "date")
