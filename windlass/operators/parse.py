"""JSON wire format in and out: orders and window metrics.

All parsing is ``from_json`` with an explicit schema and explicit options;
nothing leaves the JVM.  Options are always passed because without them a
record whose only bad field is pruned away by the optimizer would slip
through as valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import metrics_key
from ..schemas import METRICS, METRICS_COLUMNS, ORDER, ORDER_COLUMNS

CORRUPT = "_corrupt_record"

_STRICT_OPTS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "allowNonNumericNumbers": "false",
}

# Java primitives on the Order class: an absent or null property becomes 0.
_PRIMITIVE_ORDER_FIELDS = ("quantity", "unitPrice", "totalAmount",
                           "orderTimestamp", "ingestionTimestamp")


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])


def _lenient(schema: T.StructType) -> T.StructType:
    """Every numeric field read as text, coerced afterwards (Jackson-style)."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NumericType) else f.dataType)
        for f in schema.fields])


def _coerce(c: Column, target: T.DataType) -> Column:
    if isinstance(target, (T.IntegerType, T.LongType)):
        # Whole numbers first: a double holds only 53 bits of them.
        return F.coalesce(c.try_cast(target), c.try_cast("double").try_cast(target))
    return c.try_cast(target)


def _decode(raw: DataFrame, schema: T.StructType, lenient: bool) -> DataFrame:
    """raw(value, ...) -> raw columns + `_p` (parsed struct) + `_bad` (bool)."""
    text = F.col("value").cast("string")
    read_schema = _lenient(schema) if lenient else schema
    parsed = F.from_json(text, _with_corrupt(read_schema), _STRICT_OPTS)
    df = raw.withColumn("_p", parsed)
    bad = (F.col("_p").isNull() & (F.trim(text) != F.lit(""))) | F.col(f"_p.{CORRUPT}").isNotNull()
    if lenient:
        for f in schema.fields:
            if isinstance(f.dataType, T.NumericType):
                bad = bad | (F.col(f"_p.{f.name}").isNotNull()
                             & _coerce(F.col(f"_p.{f.name}"), f.dataType).isNull())
    return df.withColumn("_bad", bad)


def keep_rows(df: DataFrame, ok: Column, cols: list[Column]) -> DataFrame:
    """``df.where(ok).select(cols)`` evaluated as one generator: a filter on
    an expensive derived column (a parsed JSON struct) would otherwise be
    pushed below the projection and the expression computed twice."""
    return df.select(F.inline(F.when(ok, F.array(F.struct(*cols)))))


def _order_fields(lenient: bool) -> list[Column]:
    out = []
    for f in ORDER.fields:
        c = F.col(f"_p.{f.name}")
        if lenient and isinstance(f.dataType, T.NumericType):
            c = _coerce(c, f.dataType)
        if f.name in _PRIMITIVE_ORDER_FIELDS:
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return out


def parse_orders(raw: DataFrame, lenient: bool = True, counters: str | None = None) -> DataFrame:
    """PRJ-1 + FLT-1: Kafka/text rows with a JSON ``value`` -> valid orders.

    Tombstones, malformed JSON and orders with ``orderTimestamp <= 0`` are
    dropped; unknown properties are ignored; absent numbers become 0.
    Numbers written as text and floats in integer fields (truncated) are
    accepted, as the reference's mapper does; ``lenient=False`` rejects them.
    ``counters`` names an observation of (messages, errors) that a streaming
    query reports per batch (AGG-11); each record is decoded once.
    """
    df = _decode(raw, ORDER, lenient)
    fields = _order_fields(lenient)
    ts = fields[ORDER_COLUMNS.index("orderTimestamp")]
    ok = F.col("value").isNotNull() & ~F.col("_bad") & (ts > 0)
    if counters:
        df = df.observe(counters, F.count(F.lit(1)).alias("messages"),
                        F.count_if(~F.coalesce(ok, F.lit(False))).alias("errors"))
    return keep_rows(df, ok, fields)


def rejected_orders(raw: DataFrame, lenient: bool = True) -> DataFrame:
    """PRJ-2: the rows :func:`parse_orders` drops, with a reason
    (``null_value`` | ``malformed`` | ``bad_timestamp``) and the raw metadata
    columns that exist on the input (topic, partition, offset)."""
    df = _decode(raw, ORDER, lenient)
    ts = F.col("_p.orderTimestamp")
    if lenient:
        ts = _coerce(ts, T.LongType())
    ts = F.coalesce(ts, F.lit(0).cast("long"))
    reason = (F.when(F.col("value").isNull(), F.lit("null_value"))
              .when(F.col("_bad"), F.lit("malformed"))
              .when(ts <= 0, F.lit("bad_timestamp")))
    meta = [F.col(c) for c in ("topic", "partition", "offset") if c in raw.columns]
    df = df.withColumn("reason", reason)
    return keep_rows(df, F.col("reason").isNotNull(),
                     [*meta, F.col("reason"), F.col("value").cast("string").alias("value")])


def valid_orders(df: DataFrame) -> DataFrame:
    """FLT-1: keep orders with a positive event timestamp (null fails too)."""
    return df.where(F.col("orderTimestamp") > 0)


def with_event_time(df: DataFrame, ts_col: str = "orderTimestamp",
                    out: str = "eventTime") -> DataFrame:
    """PRJ-3: event time from epoch milliseconds (millisecond precision kept)."""
    return df.withColumn(out, F.timestamp_millis(F.col(ts_col)))


def encode_orders(orders: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-7 / SNK-2 payload: key = orderId, value = the order as JSON;
    ``keep`` names columns to carry along."""
    return orders.select(
        *keep,
        F.col("orderId").cast("binary").alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in ORDER_COLUMNS]),
                  {"ignoreNullFields": "false"}).cast("binary").alias("value"))


def encode_metrics(metrics: DataFrame) -> DataFrame:
    """PRJ-4 + PRJ-5 / SNK-1 payload: key ``category#region``, JSON value
    with all 10 properties (nulls written, as Jackson does)."""
    return metrics.select(
        metrics_key().cast("binary").alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in METRICS_COLUMNS]),
                  {"ignoreNullFields": "false"}).cast("binary").alias("value"))


def parse_metrics(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-6: JSON window metrics -> METRICS rows; unknown properties are
    ignored, unreadable records are skipped.  ``keep`` names raw columns to
    carry along (e.g. key, offset)."""
    df = _decode(raw, METRICS, lenient=False)
    ok = F.col("value").isNotNull() & F.col("_p").isNotNull() & ~F.col("_bad")
    prim = {"windowStart", "windowEnd", "orderCount", "totalRevenue", "avgOrderValue",
            "maxOrderValue", "minOrderValue", "uniqueCustomers"}
    cols = []
    for f in METRICS.fields:
        c = F.col(f"_p.{f.name}")
        if f.name in prim:
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        cols.append(c.alias(f.name))
    return keep_rows(df, ok, [*[F.col(k) for k in keep], *cols])
