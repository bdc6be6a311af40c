"""SRC-4: the operational samples table (metric, labels, ts, value).

Stored as parquet partitioned by day and metric, so a figure that reads
one metric over a time range prunes to those partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..schemas import SAMPLES


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Append samples partitioned by ``date`` and ``metric``.  Rows are
    range-partitioned on (date, metric, ts) so each task writes few files and
    a hot metric-day is split by time across tasks instead of landing in one."""
    out = samples.withColumn("date", F.to_date("ts"))
    (out.repartitionByRange("date", "metric", "ts").sortWithinPartitions("date", "metric", "ts")
        .write.mode(mode).partitionBy("date", "metric").parquet(path))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples table with the schema SAMPLES and its ``date``: declared, so
    no file is opened to infer it, and a metric or date that looks like a
    number stays what it is."""
    schema = StructType([*SAMPLES.fields, StructField("date", DateType())])
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema.fields])
