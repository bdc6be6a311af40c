"""Wire and table schemas, declared once and never inferred."""

from pyspark.sql import types as T

# An order as it travels on the `orders` topic (11 JSON properties).
ORDER = T.StructType([
    T.StructField("orderId", T.StringType()),
    T.StructField("customerId", T.StringType()),
    T.StructField("productId", T.StringType()),
    T.StructField("productName", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unitPrice", T.DoubleType()),
    T.StructField("totalAmount", T.DoubleType()),
    T.StructField("orderTimestamp", T.LongType()),
    T.StructField("ingestionTimestamp", T.LongType()),
])

ORDER_COLUMNS = [f.name for f in ORDER.fields]

# One closed window for one category x region (10 JSON properties).
METRICS = T.StructType([
    T.StructField("windowStart", T.LongType()),
    T.StructField("windowEnd", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("orderCount", T.LongType()),
    T.StructField("totalRevenue", T.DoubleType()),
    T.StructField("avgOrderValue", T.DoubleType()),
    T.StructField("maxOrderValue", T.DoubleType()),
    T.StructField("minOrderValue", T.DoubleType()),
    T.StructField("uniqueCustomers", T.LongType()),
])

METRICS_COLUMNS = [f.name for f in METRICS.fields]

# A stored, mergeable partial aggregate.  max/min are the raw extremes (the
# 0.0 reporting rule is applied only when a partial is finished), and the
# customer set keeps a null element when a null customer was seen.
PARTIALS = T.StructType([
    T.StructField("windowStart", T.LongType()),
    T.StructField("windowEnd", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("orderCount", T.LongType()),
    T.StructField("totalRevenue", T.DoubleType()),
    T.StructField("maxOrderValue", T.DoubleType()),
    T.StructField("minOrderValue", T.DoubleType()),
    T.StructField("customerIds", T.ArrayType(T.StringType())),
])

# A Kafka record as Spark's Kafka source returns it.
RAW = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Operational samples: one labelled gauge/counter value at one instant.
SAMPLES = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])
