"""Order-dependent building blocks that stay parallel under skew.

* :func:`global_rank` numbers rows in a total order without a single
  global window partition (range partitioning + per-partition offsets).
* :func:`ntile` turns that rank into equal-count buckets.
* :func:`series_lag` gives each row its predecessor within a series while
  partitioning by series x time bucket, so one hot series is spread over
  many tasks; only one boundary row per bucket crosses buckets.
* :func:`series_running` does the same for both neighbours, the position in
  the series and the running sum of counter resets.
* :func:`islands` chains overlapping intervals of a key in the same way.
* :func:`next_at` finds the next point after a gap, :func:`follow` what chains
  of such pointers reach, in a number of joins that grows with the logarithm
  of their length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, order: Sequence[str], out: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (ties must be broken by the
    order columns), plus ``_n`` = total row count.

    The frame is range-partitioned on the order, sorted within partitions and
    reliably checkpointed (so the row numbering cannot change on a retry);
    per-partition counts -- one row per partition, a bound set by the
    partition count and not by the data -- give each partition its offset.
    """
    spark = df.sparkSession
    from ..session import shared_dir
    shared_dir(spark, "rank")  # make sure a checkpoint folder is set
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in order]
    ranked = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_row", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33))
              .checkpoint(eager=True))
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid")
    counts = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding,
                                         Window.unboundedFollowing)).alias("_n"))
    # counts has one row per partition: a proven bound, safe to broadcast.
    return (ranked.join(F.broadcast(counts), "_pid")
            .withColumn(out, F.col("_off") + F.col("_row"))
            .drop("_pid", "_row", "_off"))


def ntile(rank: Column | str, n_rows: Column | str, buckets: int) -> Column:
    """SQL NTILE(buckets) from a 0-based rank: the first ``n % buckets``
    tiles hold one row more.  Returns 1-based tile numbers."""
    r = F.col(rank) if isinstance(rank, str) else rank
    n = F.col(n_rows) if isinstance(n_rows, str) else n_rows
    q = F.floor(n / buckets)
    rem = n - q * buckets
    big = rem * (q + 1)
    return (F.when(r < big, F.floor(r / (q + 1)))
            .otherwise(rem + F.floor((r - big) / F.greatest(q, F.lit(1))))
            + 1).cast("int")


def series_lag(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
               bucket_ms: int = 3_600_000, tiebreak: str | None = None,
               prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<ts>`` and ``prev_<c>``: the previous row of the same
    series (``keys``) in ``ts`` order (``ts`` in epoch ms, long).

    Rows are windowed by series x ``bucket_ms`` time bucket; the first row of
    a bucket takes its predecessor from the last row of the nearest earlier
    non-empty bucket of the series (a per-bucket summary, one row per
    bucket, joined back on series x bucket).
    """
    order = [ts] + ([tiebreak] if tiebreak else [])
    base = list(df.columns)
    d = df.select("*", F.floor(F.col(ts) / F.lit(bucket_ms)).cast("long").alias("_bkt"))
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    carried = [ts, *cols]
    d = d.select("*", (F.row_number().over(w) == 1).alias("_first"),
                 *[F.lag(c).over(w).alias("_l_" + c) for c in carried])
    # The last row of each bucket has no successor in it: already a summary,
    # no aggregate over the rows.  One struct key makes null keys join.
    d = d.select("*", F.struct(*keys).alias("_key"), (F.lead(ts).over(w).isNull()).alias("_last"))
    wt = Window.partitionBy("_key").orderBy("_bkt")
    tails = (d.where("_last").select("_key", "_bkt", F.struct(*carried).alias("_tail"))
             .select("_key", "_bkt", F.lag("_tail").over(wt).alias("_ptail")))
    d = d.join(tails, ["_key", "_bkt"], "left")
    return d.select(*base, *[
        F.when(F.col("_first"), F.col(f"_ptail.{c}")).otherwise(F.col("_l_" + c)).alias(prefix + c)
        for c in carried])


def series_running(df: DataFrame, keys: Sequence[str], ts: str = "ts_ms", value: str = "value",
                   bucket_ms: int = 3_600_000) -> DataFrame:
    """Add, in ``ts`` order within a series (``keys``): ``prev_ts`` and
    ``next_ts``, ``pos`` (1, 2, ...) and ``resets``, the sum of the values
    that were lost at resets so far (a value below its predecessor is a reset
    and loses the predecessor).  One row per instant is expected.

    Rows are windowed by series x time bucket; each bucket's summary (first and
    last row, count, resets inside) is chained over the buckets of the series
    and joined back once."""
    base = list(df.columns)
    d = df.select("*", F.floor(F.col(ts) / F.lit(bucket_ms)).cast("long").alias("_bkt"), F.struct(*keys).alias("_key"))
    w = Window.partitionBy("_key", "_bkt").orderBy(ts)
    lost = F.when(F.col(value) < F.lag(value).over(w), F.lag(value).over(w)).otherwise(F.lit(0.0))
    d = d.select("*", F.lag(ts).over(w).alias("_pt"), F.lead(ts).over(w).alias("_nt"), lost.alias("_lost"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", F.row_number().over(w).cast("long").alias("_pos"), F.sum("_lost").over(upto).alias("_sum"))
    # The last row of a bucket knows its count and sum: it and the first row
    # are the summary.
    ends = d.where("_pt is null or _nt is null").groupBy("_key", "_bkt").agg(
        F.min(ts).alias("_ft"), F.max(ts).alias("_lt"), F.min_by(value, ts).alias("_fv"), F.max_by(value, ts).alias("_lv"),
        F.max("_pos").alias("_n"), F.max_by("_sum", ts).alias("_s"))
    wb = Window.partitionBy("_key").orderBy("_bkt")
    pv = F.lag("_lv").over(wb)
    ends = ends.select("*", F.lag("_lt").over(wb).alias("_pt0"), F.lead("_ft").over(wb).alias("_nt0"),
                       F.when(F.col("_fv") < pv, pv).otherwise(F.lit(0.0)).alias("_edge"))
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_key", "_bkt", "_pt0", "_nt0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                       (F.coalesce(F.sum(F.col("_s") + F.col("_edge")).over(before), F.lit(0.0))
                        + F.col("_edge")).alias("_s0"))
    d = d.join(ends, ["_key", "_bkt"])
    return d.select(*base, F.coalesce("_pt", "_pt0").alias("prev_ts"), F.coalesce("_nt", "_nt0").alias("next_ts"),
                    (F.col("_pos") + F.col("_n0")).alias("pos"), (F.col("_sum") + F.col("_s0")).alias("resets"))


def islands(df: DataFrame, key: str, start: str, end: str, out: str, bucket_ms: int) -> DataFrame:
    """Add ``out``, the start of the island that each interval ``[start, end]``
    (longs) belongs to: intervals of a ``key`` that overlap or touch, directly
    or through others, are one island.

    Windows are over key x time bucket of the start.  What came before a bucket
    reaches it as two numbers, the furthest end and the last island's start,
    chained over one summary row per bucket."""
    base = list(df.columns)
    d = df.withColumn("_bkt", F.floor(F.col(start) / F.lit(bucket_ms)).cast("long"))
    keys, earlier = [key, "_bkt"], Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    reach = d.groupBy(*keys).agg(F.max(end).alias("_e")).select(*keys, F.max("_e").over(earlier).alias("_reach"))
    w = Window.partitionBy(*keys).orderBy(start)
    d = d.join(reach, keys)
    seen = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_reach")
    # The first of several equal starts decides; the others touch it.
    d = d.select("*", F.when(F.coalesce(F.col(start) <= seen, F.lit(False)), None).otherwise(F.col(start)).alias("_new"))
    last = d.groupBy(*keys).agg(F.max("_new").alias("_l")).select(*keys, F.max("_l").over(earlier).alias("_carried"))
    d = d.select("*", F.max("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("_here")).join(last, keys)
    return d.select(*base, F.coalesce("_here", "_carried").alias(out))


def next_at(points: DataFrame, gap: int, bucket_ms: int = 3_600_000) -> DataFrame:
    """(_key, at, to) for points (_key, at): ``to`` is the first point of the
    key at ``at + gap`` or later, null if there is none.

    Points and the instants asked for are read backwards together, per key x
    time bucket; what lies after a bucket reaches it as one number."""
    ask = points.select("_key", (F.col("at") + F.lit(gap)).alias("_t"), F.lit(1).alias("_ask"), "at")
    d = points.select("_key", F.col("at").alias("_t"), F.lit(0).alias("_ask"), "at").unionByName(ask)
    d = d.withColumn("_bkt", F.floor(F.col("_t") / F.lit(bucket_ms)).cast("long"))
    point = F.when(F.col("_ask") == 0, F.col("_t"))
    back = Window.partitionBy("_key", "_bkt").orderBy(F.desc("_t"), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("_key").orderBy(F.desc("_bkt")).rowsBetween(Window.unboundedPreceding, -1)
    after = (d.groupBy("_key", "_bkt").agg(F.min(point).alias("_f"))
             .select("_key", "_bkt", F.min("_f").over(later).alias("_after")))
    d = d.select("*", F.min(point).over(back).alias("_here")).join(after, ["_key", "_bkt"])
    return d.where("_ask = 1").select("_key", "at", F.coalesce("_here", "_after").alias("to"))


def follow(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """(_key, at) of everything that chains of ``pointers`` (_key, at, to)
    reach from ``starts`` (_key, at), these included.  Pointers must lead
    forward, so that no chain meets itself.

    Pointer doubling: after k rounds pointers lead 2**k links ahead, and what
    is reached is complete up to there.  Each round is reliably checkpointed."""
    from ..session import shared_dir
    shared_dir(pointers.sparkSession, "follow")      # make sure a checkpoint folder is set
    jump = pointers.where("to is not null").checkpoint()
    reached = starts.select("_key", "at")
    while not jump.isEmpty():
        reached = reached.unionByName(
            reached.join(jump, ["_key", "at"]).select("_key", F.col("to").alias("at"))).checkpoint()
        ahead = jump.select(F.col("_key").alias("_k"), F.col("at").alias("_mid"), F.col("to").alias("_far"))
        jump = (jump.join(ahead, (F.col("_key") == F.col("_k")) & (F.col("to") == F.col("_mid")))
                .select("_key", "at", F.col("_far").alias("to")).checkpoint())
    return reached
