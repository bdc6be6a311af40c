"""JSON in/out: valid, tolerated, rejected records; encoders; log line."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import make_order, orders_df
from windlass.operators.parse import (encode_metrics, encode_orders, parse_metrics,
                                      parse_orders, rejected_orders)
from windlass.operators.reader import dedupe_metrics, format_metrics, metrics_summary
from windlass.operators.windows import order_metrics

GOOD = make_order("C1", "FOOD", "SOUTH", 10.0, 5000)


def raw(spark, values):
    rows = [(v, "orders", 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "value string, topic string, partition int, offset long")


def _with(**kw):
    o = dict(GOOD)
    for k, v in kw.items():
        if v is KeyError:
            o.pop(k)
        else:
            o[k] = v
    return json.dumps(o)


def test_tolerated_records(spark):
    """E5: unknown property ignored; absent or null number -> 0.0."""
    vals = [json.dumps(GOOD), _with(extra="x"), _with(totalAmount=KeyError),
            _with(totalAmount=None)]
    out = parse_orders(raw(spark, vals)).orderBy("totalAmount").collect()
    assert len(out) == 4
    assert [r.totalAmount for r in out] == [0.0, 0.0, 10.0, 10.0]
    assert rejected_orders(raw(spark, vals)).count() == 0


@pytest.mark.parametrize("value", [
    "{not json", "null", "[" + json.dumps(GOOD) + "]", _with(quantity="abc"),
    _with(quantity="3"), _with(quantity=3.7), _with(totalAmount=float("nan")),
])
def test_malformed_rejected(spark, value):
    """E6: strict mode rejects these as malformed."""
    df = raw(spark, [value])
    assert parse_orders(df, lenient=False).count() == 0
    reasons = [r.reason for r in rejected_orders(df, lenient=False).collect()]
    assert reasons == ["malformed"]


@pytest.mark.parametrize("value,reason", [
    (None, "null_value"), ("", "bad_timestamp"), (_with(orderTimestamp=KeyError), "bad_timestamp"),
    (_with(orderTimestamp=0), "bad_timestamp"), (_with(orderTimestamp=-5), "bad_timestamp"),
])
def test_rejected_reasons(spark, value, reason):
    """E7: tombstone -> null_value; empty / absent / non-positive time -> bad_timestamp."""
    df = raw(spark, [value])
    assert parse_orders(df).count() == 0
    assert [r.reason for r in rejected_orders(df).collect()] == [reason]


def test_lenient_mode_coerces_numbers(spark):
    """The default; whole numbers beyond 53 bits keep every digit."""
    df = raw(spark, [_with(quantity="3"), _with(quantity=3.7), _with(orderTimestamp="9007199254740993")])
    out = parse_orders(df).collect()
    assert sorted(r.quantity for r in out)[-2:] == [3, 3]
    assert max(r.orderTimestamp for r in out) == 9007199254740993
    assert rejected_orders(df).count() == 0


def test_order_round_trip(spark):
    orders = orders_df(spark, [GOOD, make_order("C2", "HOME", "WEST", 2.5, 7000)])
    back = parse_orders(encode_orders(orders))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in orders.collect())


def test_metrics_encoding(spark):
    m = order_metrics(orders_df(spark, [GOOD]))
    enc = encode_metrics(m).collect()[0]
    assert enc.key.decode() == "FOOD#SOUTH"
    doc = json.loads(enc.value.decode())
    assert len(doc) == 10 and doc["orderCount"] == 1 and doc["windowEnd"] == 30000
    back = parse_metrics(encode_metrics(m))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in m.collect()]


def test_null_fields_written(spark):
    m = order_metrics(orders_df(spark, [make_order("C1", None, "SOUTH", 1.0, 5000)]))
    enc = encode_metrics(m).collect()[0]
    assert enc.key.decode() == "null#SOUTH"
    assert json.loads(enc.value.decode())["category"] is None


def test_log_line(spark):
    """the reader's log-line layout, revenue/avg with two decimals."""
    rows = [(1748530800000, 1748530830000, "ELECTRONICS", "NORTH", 47, 4823.5,
             4823.5 / 47, 200.0, 10.0, 44)]
    from windlass.schemas import METRICS
    m = spark.createDataFrame(rows, METRICS)
    (line,) = [r.line for r in format_metrics(m).collect()]
    assert line == ("[window=1748530800000-1748530830000] category=ELECTRONICS region=NORTH "
                    "orders=47 revenue=4823.50 avg=102.63 customers=44")


def test_summary_and_dedupe(spark):
    m = order_metrics(orders_df(spark, [GOOD, make_order("C1", "FOOD", "SOUTH", 1.0, 65000)]))
    (s,) = metrics_summary(m).collect()
    assert (s.windowsProcessed, s.lastWindowEnd) == (2, 90000)
    assert dedupe_metrics(m.unionByName(m)).count() == 2
    empty = m.where(F.lit(False))
    assert tuple(metrics_summary(empty).collect()[0]) == (0, 0)


def test_observe_counters(spark):
    """AGG-11: produced / error counters collected while the data flows."""
    from windlass.operators.observe import observe_orders
    df, obs = observe_orders(raw(spark, [json.dumps(GOOD), "{bad", None, _with(orderTimestamp=0)]))
    assert parse_orders(df).count() == 1
    assert obs.get == {"messages": 4, "errors": 3}


def test_every_record_parsed_or_rejected_once(spark):
    """Property: over arbitrary inputs (valid orders with random fields,
    fragments, garbage, nulls), accepted + rejected == all records."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    scalar = st.one_of(st.none(), st.integers(-10**12, 10**13), st.floats(allow_nan=False,
                       allow_infinity=False), st.text(max_size=5), st.booleans())
    order = st.fixed_dictionaries({}, optional={f: scalar for f in GOOD})
    value = st.one_of(order.map(json.dumps), st.text(max_size=30), st.none(),
                      order.map(lambda d: json.dumps(d)[: max(1, len(json.dumps(d)) // 2)]))

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(value, min_size=1, max_size=40))
    def check(values):
        df = raw(spark, values)
        ok = parse_orders(df).count()
        bad = rejected_orders(df).groupBy("offset").count()
        assert bad.where("count > 1").count() == 0
        assert ok + bad.count() == len(values)

    check()
