"""Event-time window metrics per category x region (the reference's job).

One function serves batch and Structured Streaming: on a streaming frame
the watermark is applied and exact distinct customers are kept as a set in
state (:func:`order_metrics_customers` keeps a row per customer instead, which
the jobs use); on a batch frame the watermark is a no-op and distinct customers
use Spark's two-exchange distinct plan (partial de-duplication on
window x key x customer first, so a hot key never funnels raw rows into
one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_sum, reported_max, reported_min, safe_div
from .ordering import global_rank, islands
from .parse import valid_orders, with_event_time

KEYS = ("category", "region")


def _prepare(df: DataFrame, delay: str | None) -> DataFrame:
    if "eventTime" not in df.columns:
        df = with_event_time(valid_orders(df))
    if delay:
        df = df.withWatermark("eventTime", delay)
    return df


def _distinct_customers(streaming: bool, exact: bool) -> Column:
    c = F.col("customerId")
    # A null customer counts as one more distinct value (HashSet semantics).
    null_seen = F.max(c.isNull().cast("int"))
    if not exact:
        # AGG-7: HyperLogLog++ sketch, mergeable map-side, works on streams.
        return (F.approx_count_distinct(c) + null_seen).cast("long")
    if streaming:
        # count_distinct is rejected on streams: keep the set in state.
        return (F.size(F.collect_set(c)) + null_seen).cast("long")
    return (F.count_distinct(c) + null_seen).cast("long")


def _raw_aggs(streaming: bool, exact: bool) -> list[Column]:
    amount = F.col("totalAmount")
    return [
        F.count(F.lit(1)).alias("orderCount"),
        exact_sum(amount).alias("totalRevenue"),
        F.max(amount).alias("_max"),
        F.min(amount).alias("_min"),
        _distinct_customers(streaming, exact).alias("uniqueCustomers"),
    ]


def _finish(df: DataFrame, win: str = "window") -> DataFrame:
    """Window struct + raw aggregates -> the 10 METRICS columns."""
    return df.select(
        F.unix_millis(F.col(f"{win}.start")).alias("windowStart"),
        F.unix_millis(F.col(f"{win}.end")).alias("windowEnd"),
        "category", "region",
        "orderCount",
        "totalRevenue",
        safe_div("totalRevenue", "orderCount").alias("avgOrderValue"),
        reported_max("_max").alias("maxOrderValue"),
        reported_min("_min").alias("minOrderValue"),
        "uniqueCustomers",
    )


def order_metrics_buckets(orders: DataFrame, buckets: int, size: str = "30 seconds",
                          delay: str | None = "5 seconds") -> DataFrame:
    """The window rows of :func:`order_metrics` in up to ``buckets`` parts,
    one per hash bucket of the customer: on a stream no state row then holds
    the whole customer set of a hot window.  All parts of a window close in
    the same micro-batch; :func:`merge_buckets` adds them up."""
    df = _prepare(orders, delay)
    bucket = F.pmod(F.xxhash64("customerId"), F.lit(buckets)).cast("int").alias("bucket")
    g = df.groupBy(F.window("eventTime", size).alias("window"), *KEYS, bucket)
    return g.agg(*_raw_aggs(df.isStreaming, True)).select(
        F.unix_millis("window.start").alias("windowStart"), F.unix_millis("window.end").alias("windowEnd"),
        *KEYS, "bucket", "orderCount", "totalRevenue", "_max", "_min", "uniqueCustomers")


def order_metrics_customers(orders: DataFrame, size: str = "30 seconds",
                            delay: str | None = "5 seconds") -> DataFrame:
    """The window rows of :func:`order_metrics` in parts, one per customer (a
    null customer is one): on a stream the first order of a customer in a
    window adds a state row of fixed size, later ones update it, and no row
    ever holds a set.  A micro-batch writes the rows of its own orders only.
    All parts of a window close in the same micro-batch, when the watermark
    passes its end; :func:`merge_customers` adds them up."""
    df = _prepare(orders, delay)
    amount = F.col("totalAmount")
    g = df.groupBy(F.window("eventTime", size).alias("window"), *KEYS, "customerId")
    return g.agg(F.count(F.lit(1)).alias("orderCount"), exact_sum(amount).alias("totalRevenue"),
                 F.max(amount).alias("_max"), F.min(amount).alias("_min")).select(
        F.unix_millis("window.start").alias("windowStart"), F.unix_millis("window.end").alias("windowEnd"),
        *KEYS, "customerId", "orderCount", "totalRevenue", "_max", "_min")


def merge_buckets(parts: DataFrame) -> DataFrame:
    """Window rows (METRICS) from the disjoint parts of
    :func:`order_metrics_buckets`; a customer lies in one part only."""
    return _merge_parts(parts, F.sum("uniqueCustomers"))


def merge_customers(parts: DataFrame) -> DataFrame:
    """Window rows (METRICS) from the parts of :func:`order_metrics_customers`,
    each of them another customer: one map-side combined aggregate."""
    return _merge_parts(parts, F.count(F.lit(1)))


def _merge_parts(parts: DataFrame, customers: Column) -> DataFrame:
    agg = parts.groupBy("windowStart", "windowEnd", *KEYS).agg(
        F.sum("orderCount").alias("orderCount"), exact_sum("totalRevenue").alias("totalRevenue"),
        F.max("_max").alias("_max"), F.min("_min").alias("_min"), customers.alias("uniqueCustomers"))
    return agg.select("windowStart", "windowEnd", *KEYS, "orderCount", "totalRevenue",
                      safe_div("totalRevenue", "orderCount").alias("avgOrderValue"),
                      reported_max("_max").alias("maxOrderValue"), reported_min("_min").alias("minOrderValue"),
                      "uniqueCustomers")


def order_metrics(orders: DataFrame, size: str = "30 seconds", delay: str | None = "5 seconds",
                  exact: bool = True) -> DataFrame:
    """WIN-1/2 + AGG-1..8: tumbling event-time windows ``[start, end)``
    aligned to the epoch, one row per window x category x region.

    ``delay`` is the bounded out-of-orderness of the watermark (streaming
    only; append output then emits each window once, when the watermark
    passes its end).  ``exact=False`` swaps the customer set for an HLL
    sketch.
    """
    df = _prepare(orders, delay)
    g = df.groupBy(F.window("eventTime", size).alias("window"), *KEYS)
    return _finish(g.agg(*_raw_aggs(df.isStreaming, exact)))


def order_metrics_session(orders: DataFrame, gap: str = "10 seconds",
                          delay: str | None = "5 seconds", exact: bool = True,
                          bucket: str = "1 hour") -> DataFrame:
    """WIN-5: session windows per category x region.  A session starts at
    its first order and ends ``gap`` after its last; an order no later than
    the current end joins the session.  Same aggregates as order_metrics.

    Streams use ``session_window`` (state per key, sessions emitted by the
    query itself); :func:`session_fragments` is the form for hot keys.  Batch
    frames use :func:`_batch_sessions`, which never puts a
    whole key into one task.
    """
    if orders.isStreaming:
        df = _prepare(orders, delay)
        g = df.groupBy(F.session_window("eventTime", gap).alias("window"), *KEYS)
        return _finish(g.agg(*_raw_aggs(True, exact)))
    return _batch_sessions(valid_orders(orders), interval_ms(gap),
                           max(interval_ms(bucket), 2 * interval_ms(gap)), exact)


def _batch_sessions(orders: DataFrame, gap_ms: int, bucket_ms: int, exact: bool) -> DataFrame:
    """Exact gap sessions without a per-key partition.

    1. orders are numbered into local sessions per key x time bucket: a new
       one starts where the gap to the previous order exceeds ``gap_ms``
       (orders of one instant have gap 0, so ties do not matter);
    2. only the first and last local session of a bucket can continue across
       a bucket edge; those (<= 2 per key x bucket) are chained by a small
       gaps-and-islands pass;
    3. the chained starts come back to the orders by key x bucket, the
       partitioning they already have, and the orders are aggregated by
       (key, session start) with the partial / two-phase distinct plan.

    The key is one struct column, so that null categories and regions are
    ordinary values in the join.
    """
    ts, unbounded = F.col("orderTimestamp"), Window.unboundedPreceding
    o = orders.select(F.struct(*KEYS).alias("_k"),
                      F.floor(ts / F.lit(bucket_ms)).cast("long").alias("_b"),
                      ts.alias("ts"), "totalAmount", "customerId")
    w = Window.partitionBy("_k", "_b").orderBy("ts")
    o = o.select("*", F.when(F.col("ts") - F.lag("ts").over(w) <= gap_ms, None)
                 .otherwise(F.col("ts")).alias("_brk"))
    # Start of the local session: the last break so far.
    o = o.select("*", F.max("_brk").over(w.rangeBetween(unbounded, 0)).alias("_first"),
                 F.min("ts").over(w.rowsBetween(unbounded, 0)).alias("_low")).drop("_brk")
    ends = o.groupBy("_k", "_b").agg(F.min("ts").alias("f"), F.max("ts").alias("l"),
                                     F.max("_first").alias("lf"),
                                     F.max(F.when(F.col("_first") == F.col("_low"), F.col("ts"))).alias("fl"))
    edge = ends.select("_k", "_b", F.explode(F.when(
        F.col("f") == F.col("lf"), F.array(F.struct(F.col("f").alias("start"), F.col("l").alias("last")))).otherwise(
        F.array(F.struct(F.col("f").alias("start"), F.col("fl").alias("last")),
                F.struct(F.col("lf").alias("start"), F.col("l").alias("last"))))).alias("e"))
    edge = edge.select("_k", "_b", "e.*")
    we = Window.partitionBy("_k").orderBy("start")
    edge = edge.select("*", F.when(F.col("start") - F.lag("last").over(we) <= gap_ms, None)
                       .otherwise(F.col("start")).alias("_new"))
    edge = edge.select("_k", "_b", "start", F.max("_new").over(we.rowsBetween(unbounded, 0)).alias("_island"))
    chained = edge.groupBy("_k", "_b").agg(
        F.min_by("_island", "start").alias("_i1"), F.min("start").alias("_s1"),
        F.max_by("_island", "start").alias("_i2"), F.max("start").alias("_s2"))
    sid = (F.when(F.col("_first") == F.col("_s1"), F.col("_i1"))
           .when(F.col("_first") == F.col("_s2"), F.col("_i2")).otherwise(F.col("_first")))
    o = o.join(chained, ["_k", "_b"]).select("_k", sid.alias("_sid"), "ts", "totalAmount", "customerId")
    amount = F.col("totalAmount")
    agg = o.groupBy("_k", "_sid").agg(
        F.max("ts").alias("_lastTs"),
        F.count(F.lit(1)).alias("orderCount"),
        exact_sum(amount).alias("totalRevenue"),
        F.max(amount).alias("_max"),
        F.min(amount).alias("_min"),
        _distinct_customers(False, exact).alias("uniqueCustomers"))
    return agg.select(
        F.col("_sid").alias("windowStart"),
        (F.col("_lastTs") + F.lit(gap_ms)).alias("windowEnd"),
        *[F.col(f"_k.{k}").alias(k) for k in KEYS], "orderCount", "totalRevenue",
        safe_div("totalRevenue", "orderCount").alias("avgOrderValue"),
        reported_max("_max").alias("maxOrderValue"),
        reported_min("_min").alias("minOrderValue"),
        "uniqueCustomers")


def session_fragments(orders: DataFrame, gap: str = "10 seconds", delay: str | None = "5 seconds") -> DataFrame:
    """WIN-5 on a stream, in parts: the sessions of each customer of a key on
    their own.  State is one row of fixed size per open fragment, spread by
    key and customer, so a hot key is as wide as its customers.  A fragment is
    emitted when the watermark passes its end; :func:`merge_fragments` chains
    fragments to the sessions of the key."""
    df = _prepare(orders, delay)
    amount = F.col("totalAmount")
    g = df.groupBy(F.session_window("eventTime", gap).alias("window"), *KEYS, "customerId")
    return g.agg(F.count(F.lit(1)).alias("orderCount"), exact_sum(amount).alias("totalRevenue"),
                 F.max(amount).alias("_max"), F.min(amount).alias("_min")).select(
        F.unix_millis("window.start").alias("start"), F.unix_millis("window.end").alias("end"),
        *KEYS, "customerId", "orderCount", "totalRevenue", "_max", "_min")


def merge_fragments(closed: DataFrame, open_: DataFrame | None = None, bucket: str = "1 hour") -> DataFrame:
    """Sessions (METRICS) from the fragments of :func:`session_fragments`.

    Orders of a key lie within the gap of each other exactly if the fragments
    they are in overlap or touch, so sessions are islands of fragments.  A
    session that touches a fragment still ``open_`` (start, end, KEYS) is not
    closed and gives no row yet."""
    cols = ["start", "end", *KEYS, "customerId", "orderCount", "totalRevenue", "_max", "_min"]
    f = closed.select(*cols, F.lit(False).alias("_open"))
    if open_ is not None:
        rest = [F.lit(None).cast(closed.schema[c].dataType).alias(c) for c in cols[4:]]
        f = f.unionByName(open_.select("start", "end", *KEYS, *rest, F.lit(True).alias("_open")))
    f = islands(f.withColumn("_k", F.struct(*KEYS)), "_k", "start", "end", "_sid", interval_ms(bucket))
    agg = f.groupBy("_k", "_sid").agg(
        F.max("end").alias("windowEnd"), F.sum("orderCount").alias("orderCount"),
        exact_sum("totalRevenue").alias("totalRevenue"), F.max("_max").alias("_max"), F.min("_min").alias("_min"),
        (F.count_distinct("customerId") + F.max(F.col("customerId").isNull().cast("int"))).cast("long")
        .alias("uniqueCustomers"), F.max("_open").alias("_open"))
    return agg.where("not _open").select(
        F.col("_sid").alias("windowStart"), "windowEnd", *[F.col(f"_k.{k}").alias(k) for k in KEYS],
        "orderCount", "totalRevenue", safe_div("totalRevenue", "orderCount").alias("avgOrderValue"),
        reported_max("_max").alias("maxOrderValue"), reported_min("_min").alias("minOrderValue"), "uniqueCustomers")


def customer_dictionary(orders: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(customerId, customerNo): a number from 1 for every customer of
    ``orders`` (null has none), the most frequent first, so that most orders
    fall on the first pages of a bitmap.  With ``known``, an earlier
    dictionary, its numbers stay as they are and new customers follow them:
    partials made with it stay mergeable."""
    seen = orders.where("customerId is not null").groupBy("customerId").agg((-F.count(F.lit(1))).alias("_n0"))
    base = 0
    if known is not None:
        seen = seen.join(known, "customerId", "left_anti")
        base = known.agg(F.max("customerNo")).first()[0] or 0
    new = global_rank(seen, ["_n0", "customerId"], "_no").select(
        "customerId", (F.col("_no") + F.lit(base + 1)).alias("customerNo"))
    return new if known is None else known.select("customerId", "customerNo").unionByName(new)


def bitmap_partials(orders: DataFrame, dictionary: DataFrame, size: str = "30 seconds") -> DataFrame:
    """AGG-9 input with customers as bits: a row for each window, key and page
    of 32,768 dictionary numbers that has orders; ``page`` is null in the row
    of the null customer.  Its size is that of a page (4 KiB), whatever the
    window.  Orders are first combined per customer, so a hot one meets its
    number in few rows.  A customer that the dictionary lacks is an error.

    Extremes stay raw, as in :func:`order_partials`."""
    parts = order_metrics_customers(orders, size, None)
    known = dictionary.select(F.col("customerId").alias("_id"), F.col("customerNo").alias("_no"))
    p = parts.join(known, F.col("customerId") == F.col("_id"), "left")
    no = F.coalesce("_no", F.when(F.col("customerId").isNotNull(), F.raise_error(
        F.concat(F.lit("customer without a number: "), "customerId")).cast("long")))
    p = p.withColumn("_no", no).withColumn("page", F.bitmap_bucket_number("_no"))
    return p.groupBy("windowStart", "windowEnd", *KEYS, "page").agg(
        F.sum("orderCount").alias("orderCount"), exact_sum("totalRevenue").alias("totalRevenue"),
        F.max("_max").alias("maxOrderValue"), F.min("_min").alias("minOrderValue"),
        F.bitmap_construct_agg(F.bitmap_bit_position("_no")).alias("customerBits"))


def _merge_bitmaps(p: DataFrame) -> DataFrame:
    """Pages of one window and key united bit by bit, map-side first."""
    return p.groupBy("windowStart", "windowEnd", *KEYS, "page").agg(
        F.sum("orderCount").alias("orderCount"), exact_sum("totalRevenue").alias("totalRevenue"),
        F.max("maxOrderValue").alias("maxOrderValue"), F.min("minOrderValue").alias("minOrderValue"),
        F.bitmap_or_agg("customerBits").alias("customerBits"))


def _bitmap_metrics(p: DataFrame) -> DataFrame:
    pages = _merge_bitmaps(p).withColumn("_customers", F.when(F.col("page").isNull(), F.lit(1).cast("long"))
                                         .otherwise(F.bitmap_count("customerBits")))
    agg = pages.groupBy("windowStart", "windowEnd", *KEYS).agg(
        F.sum("orderCount").alias("orderCount"), exact_sum("totalRevenue").alias("totalRevenue"),
        F.max("maxOrderValue").alias("_max"), F.min("minOrderValue").alias("_min"),
        F.sum("_customers").alias("uniqueCustomers"))
    return agg.select("windowStart", "windowEnd", *KEYS, "orderCount", "totalRevenue",
                      safe_div("totalRevenue", "orderCount").alias("avgOrderValue"),
                      reported_max("_max").alias("maxOrderValue"), reported_min("_min").alias("minOrderValue"),
                      "uniqueCustomers")


def order_partials(orders: DataFrame, size: str = "30 seconds",
                   delay: str | None = "5 seconds", exact: bool = True,
                   buckets: int = 16) -> DataFrame:
    """AGG-9 input: mergeable per-window accumulators (PARTIALS schema).

    Extremes stay raw so merging follows the accumulator rule; the
    customer set is exact and keeps a null element for a null customer.  A
    window has a row for each of up to ``buckets`` hash buckets of its
    customers, so no row holds a hot window's whole set; every merge takes
    the rows as the disjoint parts they are.
    With ``exact=False`` the set is replaced by a fixed-size HLL sketch
    (``customerSketch``, binary) plus a null-seen flag, so a very hot window
    never carries an unbounded array; sketches merge with ``hll_union_agg``.
    """
    df = _prepare(orders, delay)
    part = [F.pmod(F.xxhash64("customerId"), F.lit(buckets)).cast("int").alias("bucket")] if exact else []
    g = df.groupBy(F.window("eventTime", size).alias("window"), *KEYS, *part)
    if exact:
        ids = [F.transform(F.collect_set(F.struct(F.col("customerId").alias("c"))),
                           lambda s: s["c"]).alias("customerIds")]
    else:
        ids = [F.hll_sketch_agg("customerId").alias("customerSketch"),
               F.max(F.col("customerId").isNull()).alias("nullCustomer")]
    agg = g.agg(
        F.count(F.lit(1)).alias("orderCount"),
        exact_sum("totalAmount").alias("totalRevenue"),
        F.max("totalAmount").alias("maxOrderValue"),
        F.min("totalAmount").alias("minOrderValue"),
        *ids,
    )
    return agg.select(
        F.unix_millis(F.col("window.start")).alias("windowStart"),
        F.unix_millis(F.col("window.end")).alias("windowEnd"),
        *KEYS, "orderCount", "totalRevenue", "maxOrderValue", "minOrderValue",
        *[c for c in ("customerIds", "bucket", "customerSketch", "nullCustomer") if c in agg.columns])


def interval_ms(size: str) -> int:
    """Milliseconds of an interval such as ``30 seconds``."""
    n, unit = size.split()
    mult = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000,
            "day": 86_400_000}
    unit = unit.lower().rstrip("s")
    return int(float(n) * mult[unit])


def _rewindow(partials: DataFrame, size: str | None) -> DataFrame:
    if size is None:
        return partials
    ms = interval_ms(size)
    start = F.col("windowStart") - F.pmod(F.col("windowStart"), F.lit(ms))
    return (partials.withColumn("windowStart", start)
            .withColumn("windowEnd", F.col("windowStart") + F.lit(ms)))


def merge_metrics(partials: DataFrame, size: str | None = None) -> DataFrame:
    """AGG-9: merge partial accumulators into final METRICS rows.

    With ``size`` the partials are rolled up into coarser epoch-aligned
    windows (the size must be a multiple of the partial window).  Counts
    and sums add, extremes combine, customer sets union without double
    counting: bitmap pages (:func:`bitmap_partials`) by OR; sets are exploded
    and counted with the skew-safe distinct plan instead of being concatenated
    into one array per group.
    """
    p = _rewindow(partials, size)
    if "customerBits" in partials.columns:
        return _bitmap_metrics(p)
    if "customerSketch" in partials.columns:
        return _merge_sketches(p)
    p = p.select("*", F.posexplode_outer("customerIds").alias("_pos", "_cid"))
    once = F.col("_pos").isNull() | (F.col("_pos") == 0)
    agg = p.groupBy("windowStart", "windowEnd", *KEYS).agg(
        F.sum(F.when(once, F.col("orderCount"))).alias("orderCount"),
        exact_sum(F.when(once, F.col("totalRevenue"))).alias("totalRevenue"),
        F.max("maxOrderValue").alias("_max"),
        F.min("minOrderValue").alias("_min"),
        (F.count_distinct("_cid")
         + F.max((F.col("_pos").isNotNull() & F.col("_cid").isNull()).cast("int"))
         ).cast("long").alias("uniqueCustomers"),
    )
    return agg.select(
        "windowStart", "windowEnd", *KEYS, "orderCount", "totalRevenue",
        safe_div("totalRevenue", "orderCount").alias("avgOrderValue"),
        reported_max("_max").alias("maxOrderValue"),
        reported_min("_min").alias("minOrderValue"),
        "uniqueCustomers")


def _merge_sketches(p: DataFrame) -> DataFrame:
    """Merge sketch partials: every aggregate combines map-side."""
    agg = p.groupBy("windowStart", "windowEnd", *KEYS).agg(
        F.sum("orderCount").alias("orderCount"),
        exact_sum("totalRevenue").alias("totalRevenue"),
        F.max("maxOrderValue").alias("_max"),
        F.min("minOrderValue").alias("_min"),
        F.hll_union_agg("customerSketch").alias("customerSketch"),
        F.max("nullCustomer").alias("nullCustomer"))
    return agg.select(
        "windowStart", "windowEnd", *KEYS, "orderCount", "totalRevenue",
        safe_div("totalRevenue", "orderCount").alias("avgOrderValue"),
        reported_max("_max").alias("maxOrderValue"),
        reported_min("_min").alias("minOrderValue"),
        (F.hll_sketch_estimate("customerSketch")
         + F.col("nullCustomer").cast("long")).alias("uniqueCustomers"))


def merge_partials(partials: DataFrame, size: str | None = None) -> DataFrame:
    """AGG-9, partial -> partial: roll accumulators up and keep them
    mergeable (e.g. 30 s panes -> 5 min -> 1 h).  Bitmap pages are united by
    OR; set elements are exploded and re-collected as a set, so duplicates
    collapse map-side."""
    p = _rewindow(partials, size)
    if "customerBits" in partials.columns:
        return _merge_bitmaps(p)
    if "customerSketch" in partials.columns:
        return p.groupBy("windowStart", "windowEnd", *KEYS).agg(
            F.sum("orderCount").alias("orderCount"),
            exact_sum("totalRevenue").alias("totalRevenue"),
            F.max("maxOrderValue").alias("maxOrderValue"),
            F.min("minOrderValue").alias("minOrderValue"),
            F.hll_union_agg("customerSketch").alias("customerSketch"),
            F.max("nullCustomer").alias("nullCustomer"))
    p = p.select("*", F.posexplode_outer("customerIds").alias("_pos", "_cid"))
    once = F.col("_pos").isNull() | (F.col("_pos") == 0)
    ids = F.filter(F.collect_set(F.struct(F.col("_pos").isNotNull().alias("real"),
                                          F.col("_cid").alias("c"))),
                   lambda s: s["real"])
    part = ["bucket"] if "bucket" in partials.columns else []
    return p.groupBy("windowStart", "windowEnd", *KEYS, *part).agg(
        F.sum(F.when(once, F.col("orderCount"))).alias("orderCount"),
        exact_sum(F.when(once, F.col("totalRevenue"))).alias("totalRevenue"),
        F.max("maxOrderValue").alias("maxOrderValue"),
        F.min("minOrderValue").alias("minOrderValue"),
        F.transform(ids, lambda s: s["c"]).alias("customerIds"),
    ).select("windowStart", "windowEnd", *KEYS, "orderCount", "totalRevenue",
             "maxOrderValue", "minOrderValue", "customerIds", *part)


def order_total_mismatch(orders: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """SC-6: orders whose totalAmount disagrees with round(quantity *
    unitPrice, 2) by more than ``tolerance``."""
    expected = F.round(F.col("quantity") * F.col("unitPrice"), 2)
    return (orders.withColumn("expectedAmount", expected)
            .where(F.abs(F.col("totalAmount") - F.col("expectedAmount")) > F.lit(tolerance)))
