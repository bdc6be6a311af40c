"""Window aggregation: the reference's three tests plus edge cases."""

import random

import pytest

from pyspark.sql import functions as F

from conftest import f1_orders, make_order, orders_df
from windlass.operators.windows import (merge_metrics, merge_partials, order_metrics,
                                        order_metrics_session, order_partials,
                                        order_total_mismatch)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_aggregation_produces_correct_metrics(spark):
    """F1 in batch: the first window is (0, 30000, ELECTRONICS, NORTH, 10,
    1000, 100, 100, 100, 5); end of input also flushes the sentinel window."""
    out = _rows(order_metrics(orders_df(spark, f1_orders())))
    assert out == [
        (0, 30000, "ELECTRONICS", "NORTH", 10, 1000.0, 100.0, 100.0, 100.0, 5),
        (30000, 60000, "ELECTRONICS", "NORTH", 1, 1.0, 1.0, 1.0, 1.0, 1),
    ]


def test_unit_aggregate_function(spark):
    """50, 150, 100 -> count 3, total 300, avg 100, max 150, min 50, 2 customers."""
    orders = [make_order("CUST-00001", "ELECTRONICS", "NORTH", 50.0, 1000),
              make_order("CUST-00002", "ELECTRONICS", "NORTH", 150.0, 2000),
              make_order("CUST-00001", "ELECTRONICS", "NORTH", 100.0, 3000)]
    (r,) = order_metrics(orders_df(spark, orders)).collect()
    assert (r.orderCount, r.totalRevenue, r.avgOrderValue, r.maxOrderValue,
            r.minOrderValue, r.uniqueCustomers) == (3, 300.0, 100.0, 150.0, 50.0, 2)


def test_merge_accumulators(spark):
    """{A:200} merged with {B:100, A:300} -> 3, 600, max 300, min 100, 2 customers."""
    p1 = order_partials(orders_df(spark, [make_order("CUST-A", "FOOD", "SOUTH", 200.0, 1000)]))
    p2 = order_partials(orders_df(spark, [make_order("CUST-B", "FOOD", "SOUTH", 100.0, 2000),
                                          make_order("CUST-A", "FOOD", "SOUTH", 300.0, 3000)]))
    (r,) = merge_metrics(p1.unionByName(p2)).collect()
    assert (r.orderCount, r.totalRevenue, r.maxOrderValue, r.minOrderValue,
            r.uniqueCustomers) == (3, 600.0, 300.0, 100.0, 2)
    q = merge_partials(p1.unionByName(p2)).collect()
    assert sum(r.orderCount for r in q) == 3
    assert sorted(c for r in q for c in r.customerIds) == ["CUST-A", "CUST-B"]
    assert len({r.bucket for r in q}) == len(q)


def test_non_positive_amounts(spark):
    """E3: max seeded at Double.MIN_VALUE reports 0.0 for all-non-positive."""
    orders = [make_order("C1", "HOME", "WEST", -5.0, 1000),
              make_order("C2", "HOME", "WEST", 0.0, 2000)]
    (r,) = order_metrics(orders_df(spark, orders)).collect()
    assert (r.maxOrderValue, r.minOrderValue, r.totalRevenue) == (0.0, -5.0, -5.0)


def test_null_customer_counts_once(spark):
    """E4: null, null, C1 -> 2 distinct customers (batch, stream-style set, merge)."""
    orders = [make_order(None, "HOME", "WEST", 1.0, 1000),
              make_order(None, "HOME", "WEST", 2.0, 2000),
              make_order("C1", "HOME", "WEST", 3.0, 3000)]
    df = orders_df(spark, orders)
    assert order_metrics(df).collect()[0].uniqueCustomers == 2
    assert merge_metrics(order_partials(df)).collect()[0].uniqueCustomers == 2


def _cmp(df):
    rows = sorted(tuple(r) for r in df.collect())
    return [(r[0], r[1], r[2], r[3], r[4], round(r[5], 2), r[7], r[8], r[9]) for r in rows], \
        [r[6] for r in rows]


def test_random_split_merge_equals_direct(spark):
    """E8: merging partials of any split equals aggregating directly."""
    import pytest
    rnd = random.Random(7)
    orders = [make_order("C%d" % rnd.randint(1, 6), rnd.choice(["A", "B"]), "R",
                         round(rnd.uniform(-10, 100), 2), rnd.randint(1, 120_000))
              for _ in range(200)]
    direct, davg = _cmp(order_metrics(orders_df(spark, orders), size="1 minute"))
    for k in (2, 5):
        partials = None
        for i in range(k):
            pp = order_partials(orders_df(spark, orders[i::k]), size="30 seconds")
            partials = pp if partials is None else partials.unionByName(pp)
        merged, mavg = _cmp(merge_metrics(partials, size="1 minute"))
        assert merged == direct
        assert mavg == pytest.approx(davg, rel=1e-12)


def test_sessions_merge_when_gap_not_exceeded(spark):
    orders = [make_order("C1", "A", "R", 1.0, t) for t in (1000, 11000, 21001, 31001)]
    out = _rows(order_metrics_session(orders_df(spark, orders), gap="10 seconds")
                .select("windowStart", "windowEnd", "orderCount"))
    assert out == [(1000, 21000, 2), (21001, 41001, 2)]


def test_approx_distinct_option(spark):
    df = orders_df(spark, f1_orders())
    r = order_metrics(df, exact=False).where("windowStart = 0").collect()[0]
    assert r.uniqueCustomers == 5


def test_total_mismatch(spark):
    ok = make_order("C1", "A", "R", 10.0, 1000, quantity=2, unitPrice=5.0, totalAmount=10.0)
    bad = make_order("C1", "A", "R", 11.0, 1000, quantity=2, unitPrice=5.0, totalAmount=11.0)
    bad["orderId"] = "bad"
    out = order_total_mismatch(orders_df(spark, [ok, bad])).select("orderId").collect()
    assert [r.orderId for r in out] == ["bad"]


def test_batch_plan_is_two_phase(spark):
    """Partial aggregation happens before the shuffle (map-side combine)."""
    plan = order_metrics(orders_df(spark, f1_orders()))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "partial_count" in plan and "Exchange" in plan


def test_batch_sessions_across_buckets_match_brute_force(spark):
    """Sessions spanning many time buckets (bucket = 2 x gap here) and equal
    timestamps: the bucketed sessionization equals a sequential scan."""
    rnd = random.Random(11)
    orders, t = [], 1000
    for i in range(400):
        t += rnd.choice([0, 1000, 4000, 9000, 10000, 10001, 25000])
        orders.append(make_order("C%d" % rnd.randint(1, 9), rnd.choice(["A", "B"]), "R",
                                 float(rnd.randint(1, 50)), t))
    got = sorted((r.category, r.windowStart, r.windowEnd, r.orderCount, r.uniqueCustomers)
                 for r in order_metrics_session(orders_df(spark, orders), gap="10 seconds",
                                                bucket="20 seconds").collect())
    want = []
    for cat in ("A", "B"):
        rows = sorted((o["orderTimestamp"], o["customerId"]) for o in orders if o["category"] == cat)
        cur = [rows[0]]
        for r in rows[1:]:
            if r[0] - cur[-1][0] <= 10000:
                cur.append(r)
            else:
                want.append((cat, cur[0][0], cur[-1][0] + 10000, len(cur), len({c for _, c in cur})))
                cur = [r]
        want.append((cat, cur[0][0], cur[-1][0] + 10000, len(cur), len({c for _, c in cur})))
    assert got == sorted(want)
    assert max(w[2] - w[1] for w in want) > 60_000  # some sessions cross several buckets


def test_sketch_partials_merge(spark):
    """Approximate mergeable partials (HLL sketches) roll up like the exact
    ones; counts/sums are exact, distinct customers within sketch error."""
    rnd = random.Random(5)
    orders = [make_order("C%d" % rnd.randint(1, 300), "A", "R", 1.0, rnd.randint(1, 600_000))
              for _ in range(3000)] + [make_order(None, "A", "R", 1.0, 1000)]
    df = orders_df(spark, orders)
    exact = {r.windowStart: (r.orderCount, r.uniqueCustomers)
             for r in order_metrics(df, size="5 minutes").collect()}
    parts = order_partials(df, size="30 seconds", exact=False)
    rolled = merge_partials(parts, size="1 minute")
    approx = {r.windowStart: (r.orderCount, r.uniqueCustomers)
              for r in merge_metrics(rolled, size="5 minutes").collect()}
    assert approx.keys() == exact.keys()
    for k, (n, u) in exact.items():
        assert approx[k][0] == n
        assert abs(approx[k][1] - u) <= max(2, 0.05 * u)


def test_results_independent_of_partitioning_and_skew(spark):
    """Same answers with 3 or 17 shuffle partitions, with one key holding
    ~90 % of the orders (windows, sessions, partial merge)."""
    rnd = random.Random(21)
    orders = []
    for i in range(1500):
        hot = rnd.random() < 0.9
        orders.append(make_order("C%d" % rnd.randint(1, 40), "HOT" if hot else rnd.choice("ABC"),
                                 "R" if hot else rnd.choice("XY"), float(rnd.randint(1, 500)) / 4,
                                 1000 + i * rnd.choice([50, 400, 3000, 12000])))

    def run():
        df = orders_df(spark, orders)
        a = sorted(tuple(r) for r in order_metrics(df, size="1 minute")
                   .select("windowStart", "category", "region", "orderCount",
                           F.round("totalRevenue", 4), "uniqueCustomers").collect())
        b = sorted(tuple(r) for r in order_metrics_session(df, gap="10 seconds", bucket="1 minute")
                   .select("windowStart", "windowEnd", "category", "orderCount",
                           "uniqueCustomers").collect())
        c = sorted(tuple(r) for r in merge_metrics(order_partials(df), size="5 minutes")
                   .select("windowStart", "category", "region", "orderCount",
                           "uniqueCustomers").collect())
        return a, b, c

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        first = run()
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        second = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == second
    hot = [r for r in first[0] if r[1] == "HOT"]
    assert sum(r[3] for r in hot) > 1200


def test_sessions_keep_null_keys_and_ties(spark):
    """Null categories and regions are keys like any other; batch sessions
    equal Spark's session_window, also across bucket edges."""
    import random
    from pyspark.sql import functions as F
    from windlass.operators.parse import with_event_time
    from windlass.operators.windows import order_metrics_session
    rng, orders = random.Random(4), []
    for _ in range(400):
        orders.append(make_order(rng.choice(["A", "B", None]), rng.choice(["FOOD", None]),
                                 rng.choice(["EAST", None]), 1.0, rng.randrange(1, 900) * 1000))
    df = orders_df(spark, orders)
    got = order_metrics_session(df, gap="10 seconds", bucket="1 minute")
    want = (with_event_time(df).groupBy(F.session_window("eventTime", "10 seconds").alias("w"), "category", "region")
            .agg(F.count(F.lit(1)).alias("n")))
    assert sorted(((r.windowStart, r.windowEnd, r.category, r.region, r.orderCount) for r in got.collect()), key=str) \
        == sorted(((int(r.w.start.timestamp() * 1000), int(r.w.end.timestamp() * 1000), r.category, r.region, r.n)
                   for r in want.collect()), key=str)
    assert sum(r.orderCount for r in got.collect()) == 400


def test_bitmap_partials_merge_like_the_orders(spark):
    """Random orders incl. a null customer, cut into parts: pages united by OR
    count every customer once, also over two roll-ups and many pages."""
    from windlass.operators.windows import bitmap_partials, customer_dictionary
    rnd = random.Random(5)
    orders = [make_order(rnd.choice(["C%d" % rnd.randint(1, 60), None]), rnd.choice(["A", None]), "R",
                         float(rnd.randint(-5, 50)), rnd.randint(1, 900_000)) for _ in range(500)]
    df = orders_df(spark, orders)
    numbers = customer_dictionary(df)
    got = sorted(r.customerNo for r in numbers.collect())
    assert got == list(range(1, len(got) + 1))
    # The same customers on pages of their own.
    spread = numbers.withColumn("customerNo", F.col("customerNo") * 40_000)
    want = sorted(map(str, map(tuple, order_metrics(df, size="5 minutes").collect())))
    for d in (numbers, spread):
        parts = None
        for k in range(3):
            p = bitmap_partials(df.where(F.pmod(F.col("orderTimestamp"), F.lit(3)) == k), d)
            parts = p if parts is None else parts.unionByName(p)
        assert sorted(map(str, map(tuple, merge_metrics(parts, "5 minutes").collect()))) == want
        twice = merge_metrics(merge_partials(parts, "1 minute"), "5 minutes")
        assert sorted(map(str, map(tuple, twice.collect()))) == want
        assert parts.select(F.max(F.octet_length("customerBits"))).first()[0] == 4096


def test_dictionary_grows_and_keeps_its_numbers(spark):
    from windlass.operators.windows import bitmap_partials, customer_dictionary
    first = customer_dictionary(orders_df(spark, [make_order("B", "A", "R", 1.0, 1)] * 3 + [make_order("A", "A", "R", 1.0, 1)]))
    assert sorted(map(tuple, first.collect())) == [("A", 2), ("B", 1)]
    more = orders_df(spark, [make_order(c, "A", "R", 1.0, 1) for c in ("D", "B", "C", "C", None)])
    both = customer_dictionary(more, first)
    assert sorted(map(tuple, both.collect())) == [("A", 2), ("B", 1), ("C", 3), ("D", 4)]
    with pytest.raises(Exception, match="without a number: D|without a number: C"):
        bitmap_partials(more, first).collect()


def test_islands_match_a_scan(spark):
    from windlass.operators.ordering import islands
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), s, s + rnd.choice([0, 5, 5, 40, 700])) for s in
            (rnd.randint(0, 6000) for _ in range(300))]
    df = spark.createDataFrame(rows, "k string, s long, e long").withColumn("g", F.struct("k"))
    got = islands(df, "g", "s", "e", "i", 50)
    want = []
    for k in ("a", "b", None):
        start = reach = None
        for s, e in sorted((s, e) for kk, s, e in rows if kk == k):
            if reach is None or s > reach:
                start, reach = s, e
            reach = max(reach, e)
            want.append((k, s, e, start))
    assert sorted(map(str, map(tuple, got.select("k", "s", "e", "i").collect()))) == sorted(map(str, want))
