"""Time-series operators against brute-force Python on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from windlass.operators.ordering import global_rank, ntile, series_lag
from windlass.operators.timeseries import (across, binary_op, counter_rate, first_series,
                                           instant, or_zero, resample, select_series,
                                           series_labels, step_grid, value_filter, with_series)
from windlass.schemas import SAMPLES

STEP, LOOK = 15_000, 300_000


def _samples(spark, rows):
    """rows: (metric, pod, ts_ms, value)"""
    data = [(m, {"pod": p, "topic": "orders"}, ts, v) for m, p, ts, v in rows]
    df = spark.createDataFrame(data, "metric string, labels map<string,string>, ts_ms long, value double")
    return df.withColumn("ts", F.timestamp_millis("ts_ms")).select(
        *[f.name for f in SAMPLES.fields])


def _fixture(seed=3, n=300, counters=False):
    rnd = random.Random(seed)
    rows, t, v = [], {}, {}
    for _ in range(n):
        pod = rnd.choice(["p0", "p1", "p2"])
        t[pod] = t.get(pod, 1_000_000) + rnd.choice([3000, 5000, 7000, 15000, 40000, 400000])
        if counters:
            v[pod] = (v.get(pod, 0) + rnd.randint(0, 500)) if rnd.random() > 0.05 else rnd.randint(0, 50)
            rows.append(("c_total", pod, t[pod], float(v[pod])))
        else:
            rows.append(("g", pod, t[pod], float(rnd.randint(0, 1000)) / 4))
    return rows


def _grid(at, rng):
    first = ((at - rng) // STEP + 1) * STEP
    return list(range(first, (at // STEP) * STEP + 1, STEP))


def _brute_resample(rows, at, rng):
    out = {}
    for pod in {r[1] for r in rows}:
        ser = sorted((r[2], r[3]) for r in rows if r[1] == pod)
        for s in _grid(at, rng):
            cand = [(ts, v) for ts, v in ser if s - LOOK < ts <= s]
            if cand:
                out[(pod, s)] = cand[-1][1]
    return out


def _brute_rate(rows, at, rng, w):
    out = {}
    for pod in {r[1] for r in rows}:
        ser = sorted((r[2], r[3]) for r in rows if r[1] == pod)
        for s in _grid(at, rng):
            pts = [(ts, v) for ts, v in ser if s - w < ts <= s]
            if len(pts) < 2:
                continue
            res = pts[-1][1] - pts[0][1]
            prev = pts[0][1]
            for _, cur in pts[1:]:
                if cur < prev:
                    res += prev
                prev = cur
            sampled = (pts[-1][0] - pts[0][0]) / 1000.0
            gap = sampled / (len(pts) - 1)
            to_start = (pts[0][0] - (s - w)) / 1000.0
            to_end = (s - pts[-1][0]) / 1000.0
            if to_start >= gap * 1.1:
                to_start = gap / 2
            if res > 0 and pts[0][1] >= 0:
                to_start = min(to_start, sampled * (pts[0][1] / res))
            if to_end >= gap * 1.1:
                to_end = gap / 2
            out[(pod, s)] = res * (sampled + to_start + to_end) / sampled / (w / 1000.0)
    return out


def test_resample_matches_brute_force(spark):
    rows = _fixture()
    at = max(r[2] for r in rows) - 7_000
    rng = 3_600_000
    got = {(r.pod, r.step): r.value for r in resample(_samples(spark, rows), at, rng)
           .select(series_labels("_sk")["pod"].alias("pod"), "step", "value").collect()}
    assert got == _brute_resample(rows, at, rng)


@pytest.mark.parametrize("w", [30_000, 60_000, 300_000])
def test_counter_rate_matches_brute_force(spark, w):
    rows = _fixture(seed=11, n=400, counters=True)
    at = max(r[2] for r in rows)
    rng = 6 * 3_600_000
    got = {(r.pod, r.step): r.value for r in
           counter_rate(_samples(spark, rows), at, rng, w, lag_bucket_ms=600_000)
           .select(series_labels("_sk")["pod"].alias("pod"), "step", "value").collect()}
    want = _brute_rate(rows, at, rng, w)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)


def test_instant_and_selectors(spark):
    rows = _fixture()
    s = _samples(spark, rows)
    at = max(r[2] for r in rows)
    got = {r.pod: r.value for r in instant(s, at)
           .select(series_labels("_sk")["pod"].alias("pod"), "value").collect()}
    want = {}
    for pod in {r[1] for r in rows}:
        c = sorted((r[2], r[3]) for r in rows if r[1] == pod and at - LOOK < r[2] <= at)
        if c:
            want[pod] = c[-1][1]
    assert got == want
    assert select_series(s, "g", regex={"pod": "p[01]"}).select(
        F.col("labels")["pod"].alias("p")).distinct().count() == 2
    assert select_series(s, "g", ne={"missing": ""}).count() == 0
    assert select_series(s, "g", eq={"missing": ""}).count() == len(rows)


def test_or_zero_binary_op_first_series(spark):
    rows = _fixture()
    s = _samples(spark, rows)
    at = max(r[2] for r in rows)
    r = resample(s, at, 3_600_000)
    grid = step_grid(s, at, 3_600_000)
    ready = or_zero(across(value_filter(r, ">", 200.0), "count"), grid)
    assert ready.count() == len(_grid(at, 3_600_000))
    brute = _brute_resample(rows, at, 3_600_000)
    for row in ready.collect():
        assert row.value == sum(1 for (p, st), v in brute.items() if st == row.step and v > 200)
    d = binary_op(r, r, "-")
    assert d.where("value <> 0").count() == 0 and d.count() == r.count()
    first = first_series(r).select(series_labels("_sk")["pod"].alias("p")).collect()[0].p
    assert first == min(p for p, _ in brute)


def test_series_lag_across_buckets(spark):
    rows = _fixture(n=200)
    df = spark.createDataFrame([(p, ts, v) for _, p, ts, v in rows], "pod string, ts long, v double")
    got = {(r.pod, r.ts): (r.prev_ts, r.prev_v) for r in
           series_lag(df, ["pod"], "ts", ["v"], bucket_ms=50_000).collect()}
    for pod in {r[1] for r in rows}:
        ser = sorted((r[2], r[3]) for r in rows if r[1] == pod)
        assert got[(pod, ser[0][0])] == (None, None)
        for (pt, pv), (t, _) in zip(ser, ser[1:]):
            assert got[(pod, t)] == (pt, pv)


def test_global_rank_and_ntile(spark):
    rnd = random.Random(5)
    data = [(i, rnd.randint(0, 50)) for i in range(103)]
    df = spark.createDataFrame(data, "id long, k long")
    ranked = global_rank(df, ["k", "id"], out="r", partitions=7)
    out = ranked.withColumn("tile", ntile("r", "_n", 10)).collect()
    order = sorted(data, key=lambda t: (t[1], t[0]))
    pos = {t[0]: i for i, t in enumerate(order)}
    assert all(r.r == pos[r.id] for r in out)
    sizes = {}
    for r in out:
        sizes[r.tile] = sizes.get(r.tile, 0) + 1
    assert [sizes[t] for t in range(1, 11)] == [11, 11, 11] + [10] * 7


def test_stored_samples_prune_by_metric_and_time(spark, tmp):
    """On a samples table partitioned by date and metric, a selector plus a
    time range reach the scan: partition filters and pushed ts filters."""
    from windlass.sources.samples import read_samples, write_samples
    rows = _fixture()
    path = tmp + "/samples"
    write_samples(_samples(spark, rows), path)
    s = read_samples(spark, path)
    at = max(r[2] for r in rows)
    plan = (resample(select_series(s, "g"), at, 600_000)._jdf.queryExecution()
            .executedPlan().toString())
    assert "PartitionFilters: [isnotnull(metric" in plan and "(metric#" in plan
    assert "date" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    got = {(r.pod, r.step): r.value for r in resample(select_series(s, "g"), at, 600_000)
           .select(series_labels("_sk")["pod"].alias("pod"), "step", "value").collect()}
    assert got == _brute_resample(rows, at, 600_000)


def test_vector_op_equals_binary_op(spark):
    from windlass.operators.timeseries import vector_op
    rows = _fixture()
    rows2 = rows + [("h", p, ts, v * 2 + 1) for _, p, ts, v in rows[::2]]
    s = _samples(spark, rows2)
    at = max(r[2] for r in rows)
    r = resample(s, at, 3_600_000)
    m = F.col("metric")
    one = vector_op(r, m == "h", m == "g", "-")
    two = binary_op(r.where(m == "h"), r.where(m == "g"), "-")
    key = lambda df: sorted((tuple(x._sk), x.step, x.value) for x in df.collect())
    assert key(one) == key(two) and len(key(one)) > 0


def test_null_labels_are_the_empty_label_set(spark):
    from pyspark.sql import functions as F
    rows = [("c", 1_000 * i, float(i)) for i in range(3500, 3800, 10)]
    df = spark.createDataFrame(rows, "metric string, t long, value double")
    base = df.select("metric", F.timestamp_millis("t").alias("ts"), "value")
    empty = base.withColumn("labels", F.create_map().cast("map<string,string>"))
    null = base.withColumn("labels", F.lit(None).cast("map<string,string>"))
    rates = [sorted((r.step, r.value) for r in counter_rate(x, 3_790_000, 200_000, 60_000).collect())
             for x in (empty, null)]
    assert rates[0] == rates[1] and all(abs(v - 1.0) < 1e-9 for _, v in rates[0]) and rates[0]


def test_several_series_on_one_side_are_an_error(spark):
    import pytest
    from pyspark.sql import functions as F
    from windlass.operators.timeseries import binary_op, vector_op
    rows = [("a", {"pod": "x"}, 1.0), ("b", {"pod": "x"}, 5.0), ("c", {"pod": "x"}, 2.0)]
    df = with_series(spark.createDataFrame([(m, l, 0, v) for m, l, v in rows],
                                           "metric string, labels map<string,string>, ts_ms long, value double"))
    df = df.withColumn("step", F.lit(0).cast("long"))
    m = F.col("metric")
    assert vector_op(df, m == "b", m == "c").collect()[0].value == 3.0
    with pytest.raises(Exception, match="several series"):
        binary_op(df.where("metric in ('a', 'b')"), df.where("metric = 'c'")).collect()


def test_beans_with_properties_in_any_order(spark):
    from windlass.operators.broker import normalise_broker_samples
    names = ["kafka.server<name=MessagesInPerSec, topic=t, type=BrokerTopicMetrics><>OneMinuteRate",
             "kafka.server<name=MessagesInPerSec,type=BrokerTopicMetrics,topic=t><>OneMinuteRate",
             "kafka.server<type=BrokerTopicMetricsX, name=MessagesInPerSec, topic=t><>OneMinuteRate",
             "kafka.server<xtype=BrokerTopicMetrics, name=MessagesInPerSec, topic=t><>OneMinuteRate"]
    df = spark.createDataFrame([(n, 1.0) for n in names], "name string, value double").selectExpr(
        "name", "timestamp_millis(0) ts", "value")
    assert normalise_broker_samples(df).count() == 2


def test_spaced_points_follow_the_greedy_rule(spark):
    from windlass.operators.timeseries import spaced
    rng, rows = random.Random(9), []
    for pod in ("a", "b", None):
        t = 0
        for _ in range(300):
            t += rng.choice([1, 500, 3_000, 9_999, 10_000, 10_001, 45_000])
            rows.append(("m", {"pod": pod} if pod else None, t, float(t)))
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double")
    want = set()
    for pod in ("a", "b", None):
        last = None
        for _, labels, t, _ in rows:
            if (labels or {}).get("pod") == pod and (last is None or t - last >= 10_000):
                last = t
                want.add((pod, t))
    for bucket in (20_000, 3_600_000):
        got = spaced(df, 10_000, bucket).withColumn("labels", series_labels("_sk")).collect()
        assert len(got) == len(want) and {(r.labels.get("pod"), r.ts_ms) for r in got} == want


def test_series_running_matches_a_scan(spark):
    from windlass.operators.ordering import series_running
    rng, rows, want = random.Random(4), [], []
    for k in ("a", None):
        t = total = 0
        lost, ser = 0.0, []
        for _ in range(200):
            t += rng.choice([1, 300, 4_000, 30_000])
            total = 0 if rng.random() < 0.1 else total + rng.randint(0, 9)
            ser.append((t, float(total)))
        for i, (t, v) in enumerate(ser):
            if i and v < ser[i - 1][1]:
                lost += ser[i - 1][1]
            want.append((k, t, v, ser[i - 1][0] if i else None, ser[i + 1][0] if i + 1 < len(ser) else None, i + 1, lost))
        rows += [(k, t, v) for t, v in ser]
    df = spark.createDataFrame(rows, "k string, ts_ms long, value double")
    for bucket in (5_000, 10_000_000):
        got = series_running(df, ["k"], bucket_ms=bucket).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rate_rows_do_not_grow_with_the_window(spark):
    """Two rows per step and series reach the last aggregate."""
    rows = [("m", {"pod": "a"}, 1000 * i, float(i)) for i in range(1, 3601)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double")
    for w in (60_000, 1_800_000):
        plan = counter_rate(df, 3_600_000, 1_200_000, w)
        assert plan.count() == 80
        child = plan._jdf.queryExecution().optimizedPlan()
        while "Generate" not in child.nodeName():
            child = child.children().head()
        assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, child).count() <= 2 * 80


def test_a_thousand_broker_rules(spark):
    """A rule table of a thousand rows, the real ones in the middle: the first
    fully anchored match wins, whatever its form; no chain of rules in the plan."""
    import re
    from windlass.operators.broker import ALLOWLIST, RULES, normalise_broker_samples, rule_table
    more = lambda k: (f"kafka.server<.*name=Meter{k}.*topic=([^,>]+).*><>Count", f"meter_{k}", {"topic": 1})
    odd = [("kafka.network<.*name=(Total|Part)TimeMs.*><>(P50|P99)", "either", {"request": 1, "partition": 2}),
           ("kafka.s[er]+ver<.*name=Lag?.*><>.*Rate", "lag_rate", {}), (".*name=AnyDomain.*", "any", {}),
           ("kafka.server<(.*name=Maybe.*)?><>Max", "maybe", {}), ("kafka.server<.*name=.*><>Last", "last", {})]
    rules = [more(k) for k in range(0, 1000, 2)] + list(RULES) + odd + [more(k) for k in range(1000)]
    beans = [f"kafka.server<type=BrokerTopicMetrics, name=Meter{k}{tail}, topic=t{k}><>Count"
             for k, tail in ((1, ""), (2, ""), (20, ""), (999, "x"), (77, "00"))]
    beans += ["kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Fetch><>P99",
              "kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Fetch><>Mean",
              "kafka.server<type=ReplicaManager, name=La><>OneMinuteRate", "kafka.server<type=ReplicaManager, name=Lag><>Rate",
              "kafka.server<type=ReplicaManager, name=name=AnyDomain><>x", "kafka.server<type=ReplicaManager><>Max",
              "kafka.server<type=ReplicaManager, xname=Meter5 and more, topic=u><>Count", "kafka.other<type=ReplicaManager><>Max",
              "kafka.server<type=Other, name=Meter1, topic=u><>Count", "kafka.server<type=ReplicaManager, name=q><>Last"]
    df = spark.createDataFrame([(n, 1.0) for n in beans * 3 + [None]], "name string, value double").selectExpr(
        "name", "timestamp_millis(0) ts", "value")

    def brute(n):
        ok = any(re.match(f"{re.escape(d)}<(?:[^>]*,)? *type={t} *[,>]", n) for d, t in ALLOWLIST)
        for p, metric, groups in rules if ok else ():
            if m := re.fullmatch(p, n):
                return metric, sorted((k, m[g] or "") for k, g in groups.items())
    want = sorted(str(brute(n)) for n in beans * 3 if brute(n))
    got = normalise_broker_samples(df, rules)
    assert sorted(str((r.metric, sorted(r.labels.items()))) for r in got.collect()) == want and len(want) == 36
    assert got._jdf.queryExecution().optimizedPlan().toString().count("meter_") == 0
    assert normalise_broker_samples(df, rule_table(spark, rules)).count() == len(want)
