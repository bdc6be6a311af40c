"""Series dictionary and roll-up tiers against the plain operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from windlass.operators import series as sr, tiers
from windlass.operators.timeseries import select_series, with_series

SCHEMA = "metric string, labels map<string,string>, ts timestamp, value double"
UTC = datetime.timezone.utc


def at(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, UTC)


def rows(seed, lo, hi, n=300):
    rnd = random.Random(seed)
    labels = [None, {}, {"pod": "w-0"}, {"pod": "w-1", "topic": "t"}, {"pod": "", "topic": "u"}, {"topic": "t"},
              {"pod": "x-9"}]
    return [(rnd.choice(["m", "n"]), rnd.choice(labels), at(t), float(rnd.randint(0, 9)))
            for t in rnd.sample(range(lo, hi), n)]


def plain(df):
    return sorted((r.metric, str(r._sk), r.ts_ms, r.value) for r in df.select("metric", "_sk", "ts_ms", "value").collect())


MATCHERS = [dict(metric="m"), dict(metric=["m", "n"], eq={"pod": "w-0"}), dict(eq={"pod": ""}), dict(ne={"topic": "t"}),
            dict(metric="n", regex={"pod": "w-.*"}, not_regex={"topic": "t|u"}), dict(regex={"pod": ".*"}),
            dict(not_regex={"pod": "w-[01]"}, ne={"pod": "x-9"}), dict(metric="none"), dict(), dict(eq={"no": "label"})]


def test_selectors_on_the_index(spark, tmp):
    """Every matcher set gives what it gives on the samples themselves, also
    after a second append with new series."""
    first, second = rows(1, 0, 10**6), rows(2, 10**6, 2 * 10**6) + [("new", {"pod": "w-0"}, at(1), 1.0)]
    for k, part in enumerate((first, second)):
        sr.write_series(spark.createDataFrame(part, SCHEMA).repartition(3), tmp)
        ids = sorted(r.series_id for r in sr.read_table(spark, tmp, "series").collect())
        assert ids == list(range(len(ids)))
        df = with_series(spark.createDataFrame(first + (second if k else []), SCHEMA))
        for m in MATCHERS[::1 if k else 4]:
            assert plain(sr.select_samples(spark, tmp, **m)) == plain(select_series(df, **m))


def test_numbers_reach_the_scan(spark, tmp, monkeypatch):
    monkeypatch.setattr(sr, "PAGE", 2)
    sr.write_series(spark.createDataFrame(rows(3, 0, 10**6), SCHEMA), tmp)
    got = sr.select_samples(spark, tmp, metric="n", eq={"topic": "u"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "page" in plan.split("PartitionFilters")[1][:200]
    assert "In(series_id" in plan or "EqualTo(series_id" in plan
    want = plain(got)
    monkeypatch.setattr(sr, "LISTED", 0)
    assert want and plain(sr.select_samples(spark, tmp, metric="n", eq={"topic": "u"})) == want


def test_cover_is_exact():
    rnd = random.Random(0)
    for _ in range(300):
        lo = rnd.randint(-10**7, 10**7)
        hi = lo + rnd.choice([0, 1, 14_999, 15_000, 400_000, 4_000_000, 20_000_000])
        pieces = tiers.cover(lo, hi)
        assert sum(b - a for _, a, b in pieces) == hi - lo
        assert [a for _, a, _ in pieces[1:]] == [b for _, _, b in pieces[:-1]]
        assert all(a % s == b % s == 0 for s, a, b in pieces if s)
        assert all(b - a < 2 * 15_000 for s, a, b in pieces if not s)
        assert all(b - a < 2 * 3_600_000 for s, a, b in pieces if 0 < s < 3_600_000)


def brute(samples, lo, hi):
    out = {}
    for m, labels, ts, v in sorted(samples, key=lambda r: r[2]):
        t = round(ts.timestamp() * 1000)
        if lo < t <= hi:
            out.setdefault((m, str(sorted((labels or {}).items()))), []).append((t, v))
    return {k: (len(p), sum(v for _, v in p), min(v for _, v in p), max(v for _, v in p), *p[0], *p[-1],
                sum(a for (_, a), (_, b) in zip(p, p[1:]) if b < a)) for k, p in out.items()}


def test_tiers_answer_like_the_samples(spark, tmp):
    """Three appends whose edges lie inside steps; ranges at odd instants."""
    parts = [rows(5, 0, 5_000_000, 400), rows(6, 5_000_000, 9_999_999, 400), rows(7, 9_999_999, 15_000_000, 400)]
    for p in parts:
        tiers.append_tiers(spark.createDataFrame(p, SCHEMA), tmp)
    df, every = spark.createDataFrame(sum(parts, []), SCHEMA), sum(parts, [])
    for end, rng in ((14_999_999, 14_999_990), (12_345_678, 9_000_001), (7_200_000, 7_200_000), (400_123, 9_000)):
        got = {(r.metric, str([(e.key, e.value) for e in r._sk])): tuple(r)[2:]
               for r in tiers.range_states(df, tmp, end, rng, ["m", "n"]).collect()}
        assert got == brute(every, end - rng, end)
    top = tiers.read_tier(spark, tmp, 3_600_000)
    assert top.count() < 3 * 2 * 7 * 6 and top.agg(F.sum("n")).first()[0] == 1200


def test_an_unfinished_append_is_not_seen(spark, tmp):
    part = spark.createDataFrame(rows(8, 0, 10**6, 50), SCHEMA)
    tiers.append_tiers(part, tmp)
    with pytest.raises(Exception):
        tiers.append_tiers(part.withColumn("value", F.raise_error(F.lit("stopped")).cast("double")), tmp)
    tiers.roll_up(tiers.raw_states(part), 15_000).withColumn("date", F.to_date(F.lit("1970-01-01"))).write.partitionBy(
        "date").parquet(f"{tmp}/step=15000/append=7")
    assert tiers.read_tier(spark, tmp, 15_000).agg(F.sum("n")).first()[0] == 50
