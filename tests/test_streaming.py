"""Structured Streaming semantics: watermark close, late drop, restart."""

import json
import os

import pytest

from conftest import f1_orders, make_order, write_lines
from windlass.operators.parse import encode_metrics, parse_orders
from windlass.operators.windows import order_metrics
from windlass.streaming.jobs import (run_available_now, stream_log_lines,
                                     stream_metrics_summary, stream_order_metrics)


def _run(spark, src, out, ckpt):
    raw = spark.readStream.format("text").load(src)
    return run_available_now(order_metrics(parse_orders(raw)), out, ckpt)


def _result(spark, out):
    if not os.path.exists(out):
        return []
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def test_stream_f1_emits_closed_window_only(spark, tmp):
    """F1 streaming: watermark 35 s closes [0, 30 s); the sentinel's window stays open."""
    src = os.path.join(tmp, "src")
    write_lines(src, "a.json", f1_orders())
    out, run = stream_order_metrics(spark, src, os.path.join(tmp, "out"), os.path.join(tmp, "ck"))
    assert sorted(tuple(r) for r in out.collect()) == [
        (0, 30000, "ELECTRONICS", "NORTH", 10, 1000.0, 100.0, 100.0, 100.0, 5)]
    assert run.input_rows() == 11
    assert run.observed() == {"messages": 11, "errors": 0}


def test_window_closes_exactly_at_end_plus_delay(spark, tmp):
    """E1: max event time 34 999 leaves [0, 30 s) open; 35 000 closes it."""
    src, out, ck = (os.path.join(tmp, d) for d in ("src", "out", "ck"))
    write_lines(src, "1.json", [make_order("C1", "A", "R", 1.0, 1000),
                                make_order("C1", "A", "R", 1.0, 34999)])
    _run(spark, src, out, ck)
    assert _result(spark, out) == []
    write_lines(src, "2.json", [make_order("C1", "A", "R", 1.0, 35000)])
    _run(spark, src, out, ck)
    assert [r[:5] for r in _result(spark, out)] == [(0, 30000, "A", "R", 1)]


def test_late_order_dropped_and_restart_from_checkpoint(spark, tmp):
    """E2: after F1 (watermark 35 s) an order at 15 s arrives in the next
    run of the same checkpoint: it is late and dropped; count stays 10."""
    src, out, ck = (os.path.join(tmp, d) for d in ("src", "out", "ck"))
    write_lines(src, "1.json", f1_orders())
    _run(spark, src, out, ck)
    write_lines(src, "2.json", [make_order("CUST-00077", "ELECTRONICS", "NORTH", 5.0, 15000)])
    run = _run(spark, src, out, ck)
    rows = _result(spark, out)
    assert [r[:5] for r in rows] == [(0, 30000, "ELECTRONICS", "NORTH", 10)]
    assert run.input_rows() == 1
    assert run.rows_dropped_by_watermark() >= 1


def test_reader_streams(spark, tmp):
    """SRC-2 -> log lines (append) and running summary (complete)."""
    from conftest import orders_df
    m = order_metrics(orders_df(spark, f1_orders()))
    msrc = os.path.join(tmp, "metrics")
    lines = [r.value.decode() for r in encode_metrics(m).collect()]
    write_lines(msrc, "m.json", lines + ["{broken"])
    logs, _ = stream_log_lines(spark, msrc, os.path.join(tmp, "log"), os.path.join(tmp, "lck"))
    got = sorted(r.value for r in logs.collect())
    assert len(got) == 2 and got[0].startswith("[window=0-30000] category=ELECTRONICS")
    summary, _ = stream_metrics_summary(spark, msrc, os.path.join(tmp, "sck"))
    assert tuple(summary.collect()[0]) == (2, 60000)


def test_stream_dedupe(spark, tmp):
    """At-least-once duplicates of window rows removed on a stream."""
    from conftest import orders_df
    from windlass.operators.parse import parse_metrics
    from windlass.operators.reader import dedupe_metrics
    m = order_metrics(orders_df(spark, f1_orders()))
    lines = [r.value.decode() for r in encode_metrics(m).collect()]
    src = os.path.join(tmp, "m")
    write_lines(src, "a.json", lines + lines)
    write_lines(src, "b.json", lines[:1])
    raw = spark.readStream.format("text").load(src)
    out, ck = os.path.join(tmp, "o"), os.path.join(tmp, "c")
    with pytest.raises(ValueError, match="delay"):
        dedupe_metrics(parse_metrics(raw))
    run_available_now(dedupe_metrics(parse_metrics(raw), delay="10 minutes"), out, ck)
    assert spark.read.parquet(out).count() == 2


def test_one_file_per_micro_batch(spark, tmp):
    """SRC-3 with maxFilesPerTrigger=1: F1 then a late order in a second
    file with a later modification time -> two micro-batches, late dropped."""
    import time as _t
    src = os.path.join(tmp, "src")
    write_lines(src, "1.json", f1_orders())
    p2 = write_lines(src, "2.json", [make_order("CUST-00077", "ELECTRONICS", "NORTH", 5.0, 15000)])
    os.utime(p2, (_t.time() + 5, _t.time() + 5))
    out, run = stream_order_metrics(spark, src, os.path.join(tmp, "out"), os.path.join(tmp, "ck"),
                                    max_files=1)
    assert [tuple(r)[:5] for r in out.collect()] == [(0, 30000, "ELECTRONICS", "NORTH", 10)]
    assert sum(1 for p in run.progress if p["numInputRows"] > 0) == 2


def test_batch_equals_stream_on_closed_windows(spark, tmp):
    """The same function on a batch frame and on a stream agrees on every
    window the stream has closed."""
    import random
    from conftest import orders_df
    rnd = random.Random(3)
    orders = [make_order("C%d" % rnd.randint(1, 20), rnd.choice("ABC"), rnd.choice("XY"),
                         round(rnd.uniform(1, 99), 2), rnd.randint(1000, 300_000))
              for _ in range(500)]
    src = os.path.join(tmp, "src")
    write_lines(src, "all.json", orders)
    out, _ = stream_order_metrics(spark, src, os.path.join(tmp, "o"), os.path.join(tmp, "c"))
    wm = max(o["orderTimestamp"] for o in orders) - 5000
    batch = order_metrics(orders_df(spark, orders)).where(f"windowEnd <= {wm}")

    def norm(df):
        return sorted((r.windowStart, r.category, r.region, r.orderCount, round(r.totalRevenue, 6),
                       r.maxOrderValue, r.minOrderValue, r.uniqueCustomers) for r in df.collect())
    assert norm(out) == norm(batch) and len(norm(batch)) > 20


def test_batch_sinks(spark, tmp):
    from conftest import orders_df
    from windlass.operators.reader import format_metrics
    from windlass.sources.files import collect_stream, write_log_lines
    m = order_metrics(orders_df(spark, f1_orders()))
    write_log_lines(format_metrics(m), os.path.join(tmp, "log"))
    assert spark.read.text(os.path.join(tmp, "log")).count() == 2
    src = os.path.join(tmp, "src")
    write_lines(src, "a.json", f1_orders())
    raw = spark.readStream.format("text").load(src)
    got = collect_stream(order_metrics(parse_orders(raw)), os.path.join(tmp, "o"),
                         os.path.join(tmp, "c"))
    assert got.count() == 1


def test_continuous_reader(spark, tmp):
    from conftest import orders_df
    from windlass.streaming.jobs import start_metrics_reader
    m = order_metrics(orders_df(spark, f1_orders()))
    src = os.path.join(tmp, "m")
    write_lines(src, "a.json", [r.value.decode() for r in encode_metrics(m).collect()])
    raw = spark.readStream.format("text").load(src)
    logs, summary = start_metrics_reader(raw, os.path.join(tmp, "log"), os.path.join(tmp, "lc"),
                                         os.path.join(tmp, "sc"), summary_interval="1 second")
    try:
        logs.processAllAvailable()
        summary.processAllAvailable()
    finally:
        logs.stop()
        summary.stop()
    assert spark.read.text(os.path.join(tmp, "log")).count() == 2


def test_orders_job_frame_end_to_end(spark, tmp):
    """Raw order records -> encoded metrics records, as the Kafka job runs
    it; decoded output equals the window result."""
    import json
    from windlass.streaming.jobs import orders_job_frame
    src = os.path.join(tmp, "src")
    write_lines(src, "a.json", f1_orders() + ["{broken", ""])
    raw = spark.readStream.format("text").load(src)
    out, ck = os.path.join(tmp, "o"), os.path.join(tmp, "c")
    run_available_now(orders_job_frame(raw), out, ck)
    rows = spark.read.parquet(out).collect()
    assert [r.key.decode() for r in rows] == ["ELECTRONICS#NORTH"]
    doc = json.loads(rows[0].value.decode())
    assert (doc["windowStart"], doc["orderCount"], doc["uniqueCustomers"]) == (0, 10, 5)


def test_source_lag_from_progress():
    from windlass.streaming.jobs import source_lag
    prog = {"sources": [{"description": "KafkaV2[Subscribe[orders]]",
                         "endOffset": '{"orders":{"0":100,"1":50}}',
                         "latestOffset": '{"orders":{"0":130,"1":50}}'}]}
    assert source_lag(prog) == 30
    assert source_lag({"sources": [{"endOffset": {"logOffset": 3}, "latestOffset": None}]}) is None


def test_counters_of_every_batch(spark, tmp):
    """130 micro-batches, more than a query keeps reports of: no counter is
    lost, and every record is decoded once."""
    src = os.path.join(tmp, "src")
    for i in range(130):
        write_lines(src, f"{i:03d}.json", [json.dumps(make_order("C", "FOOD", "EAST", 1.0, 1000 + i))]
                    + ["{bad"] * (i % 2))
    _, run = stream_order_metrics(spark, src, os.path.join(tmp, "o"), os.path.join(tmp, "c"),
                                  max_files=1, state_partitions=1, customer_buckets=2)
    assert run.observed() == {"messages": 195, "errors": 65} and run.input_rows() == 195


def test_one_decode_in_the_stream_plan(spark, tmp):
    from windlass.operators.parse import parse_orders
    src = os.path.join(tmp, "src")
    write_lines(src, "a.json", [json.dumps(make_order("C", "FOOD", "EAST", 1.0, 1000))])
    df = order_metrics(parse_orders(spark.read.text(src), counters="orders"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_customer_buckets_add_up(spark, tmp):
    from windlass.operators.windows import merge_buckets, order_metrics_buckets
    from conftest import orders_df
    orders = orders_df(spark, f1_orders() + [make_order(None, "ELECTRONICS", "NORTH", 5.0, 2500)] * 2)
    want = sorted(map(tuple, order_metrics(orders).collect()))
    assert sorted(map(tuple, merge_buckets(order_metrics_buckets(orders, 3)).collect())) == want


def _batches(spark, tmp, *batches):
    """A file stream that reads each list of orders as one micro-batch."""
    src = os.path.join(tmp, "src")
    for i, orders in enumerate(batches):
        path = write_lines(src, f"{i:03d}.json", [json.dumps(o) for o in orders])
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return parse_orders(spark.readStream.option("maxFilesPerTrigger", 1).text(src))


def test_a_customer_is_one_state_row(spark, tmp):
    """Many orders of few customers over several batches: state holds a row
    per window, key and customer, and no batch rewrites more than its own."""
    from windlass.operators.windows import merge_customers, order_metrics_customers
    batches = [[make_order(c, "FOOD", "EAST", 1.0 + i, 1000 * b + i + 1) for i in range(40) for c in (f"C{b}", "ALL", None)]
               for b in range(5)]
    batches.append([make_order("Z", "FOOD", "EAST", 1.0, 90_000)])
    parts = order_metrics_customers(_batches(spark, tmp, *batches))
    out, ck = os.path.join(tmp, "o"), os.path.join(tmp, "c")
    run = run_available_now(parts, out, ck, state_partitions=2)
    state = [op for p in run.progress for op in p["stateOperators"]]
    assert max(int(op["numRowsTotal"]) for op in state) == 8            # C0..C4, ALL, null; Z
    assert max(int(op["numRowsUpdated"]) for op in state) == 3
    got = merge_customers(spark.read.schema(parts.schema).parquet(out)).collect()
    assert [(r.windowStart, r.orderCount, r.uniqueCustomers, r.maxOrderValue) for r in got] == [(0, 600, 7, 40.0)]


def test_replayed_batch_is_published_once(spark, tmp):
    """The query fails after publishing, before its checkpoint commits: the
    restart replays the batch and writes nothing twice."""
    from windlass.operators.windows import merge_customers, order_metrics_customers
    from windlass.streaming.jobs import publish_once
    orders = _batches(spark, tmp, f1_orders(), [make_order("Z", "FOOD", "EAST", 1.0, 90_000)],
                      [make_order("Y", "FOOD", "EAST", 1.0, 200_000)])
    parts = order_metrics_customers(orders)
    sink, ck = os.path.join(tmp, "sink"), os.path.join(tmp, "c")
    publish = publish_once(f"{ck}/ledger", lambda df: df.write.mode("append").parquet(sink), merge_customers)
    failed = []

    def stops(batch, batch_id):
        publish(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("stopped between publish and commit")
    with pytest.raises(Exception, match="stopped between"):
        run_available_now(parts, "", ck, each_batch=stops, state_partitions=2)
    once = [r[:5] for r in _result(spark, sink)]
    assert once == [(0, 30000, "ELECTRONICS", "NORTH", 10)]
    run_available_now(parts, "", ck, each_batch=publish, state_partitions=2)
    assert [r[:5] for r in _result(spark, sink)] == [
        (0, 30000, "ELECTRONICS", "NORTH", 10), (30000, 60000, "ELECTRONICS", "NORTH", 1), (90000, 120000, "FOOD", "EAST", 1)]
    assert sorted(f for f in os.listdir(f"{ck}/ledger") if f[0] != ".") == [f"batch-{i}" for i in range(4)]


def test_late_orders_are_the_dropped_ones(spark, tmp):
    """Orders at the close of a window, in the same batch (never late) and in
    the next one; a replayed batch keeps its late orders once."""
    from windlass.streaming.jobs import keep_late_orders
    late = [make_order("L", "FOOD", "EAST", 2.0, 29_999), make_order("OK", "FOOD", "EAST", 1.0, 30_000)]
    batches = [[make_order("A", "FOOD", "EAST", 1.0, 35_000), make_order("same", "FOOD", "EAST", 1.0, 5)], late,
               [make_order("B", "FOOD", "EAST", 1.0, 34_000)], [make_order("M", "FOOD", "EAST", 3.0, 1)]]
    orders = _batches(spark, tmp, *batches)
    out, ck = os.path.join(tmp, "late"), os.path.join(tmp, "c")
    keep, failed = keep_late_orders(out, f"{ck}/ledger"), []

    def stops(batch, batch_id):
        keep(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(1)
            raise RuntimeError("stopped")
    with pytest.raises(Exception, match="stopped"):
        run_available_now(orders, "", ck, each_batch=stops)
    run_available_now(orders, "", ck, each_batch=keep)
    got = spark.read.parquet(out).select("customerId", "windowStart", "watermark", "batch").collect()
    assert sorted(map(tuple, got)) == [("L", 0, 30_000, 1), ("M", 0, 30_000, 3)]
    drop = run_available_now(order_metrics(orders), os.path.join(tmp, "o"), os.path.join(tmp, "c2"))
    assert drop.rows_dropped_by_watermark() == 2
    assert sum(r[4] for r in _result(spark, os.path.join(tmp, "o"))) == 1      # "same" only: the watermark is 30 s


def test_stream_sessions_from_fragments(spark, tmp):
    """A session is chained over customers and batches; it stays out while one
    of its fragments, or one that touches it, is still open."""
    from windlass.operators.windows import merge_fragments, session_fragments
    from windlass.streaming.jobs import open_fragments
    o = lambda c, t, cat="FOOD", **k: make_order(c, cat, "EAST", 1.0, t, **k)
    batches = [[o("A", 1_000), o("B", 9_000), o(None, 11_000), o("A", 19_500)],
               [o("C", 40_000), o("D", 50_000), o("X", 41_000, None)],
               [o("D", 58_000), o("E", 71_000), o("N", 70_000, None)]]
    parts = session_fragments(_batches(spark, tmp, *batches))
    out, ck = os.path.join(tmp, "o"), os.path.join(tmp, "c")
    run_available_now(parts, out, ck, state_partitions=3)
    closed, still = spark.read.schema(parts.schema).parquet(out), open_fragments(spark, ck)
    # Watermark 66 s: D's fragment [50, 68 s) is open, and C's [40, 50 s) touches it.
    assert sorted((r.start, r.end) for r in still.collect()) == [(50_000, 68_000), (70_000, 80_000), (71_000, 81_000)]
    cols = ("windowStart", "windowEnd", "category", "orderCount", "uniqueCustomers")
    for bucket in ("1 hour", "11 seconds"):
        got = merge_fragments(closed, still, bucket).select(*cols).collect()
        assert sorted(map(tuple, got)) == [(1_000, 29_500, "FOOD", 4, 3), (41_000, 51_000, None, 1, 1)]
    write_lines(os.path.join(tmp, "src"), "9.json", [json.dumps(o("Z", 300_000))])
    run_available_now(parts, out, ck)
    got = merge_fragments(spark.read.schema(parts.schema).parquet(out), open_fragments(spark, ck)).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (1_000, 29_500, "FOOD", 4, 3), (41_000, 51_000, None, 1, 1), (40_000, 68_000, "FOOD", 3, 2),
        (70_000, 80_000, None, 1, 1), (71_000, 81_000, "FOOD", 1, 1)], key=str)


def test_dedupe_forgets_after_its_delay(spark, tmp):
    """A duplicate within the delay is dropped as one; a row whose window ended
    longer before the newest is dropped as late, and counted."""
    from windlass.operators.parse import parse_metrics
    from windlass.operators.reader import dedupe_metrics
    src, out, ck = (os.path.join(tmp, d) for d in ("src", "out", "ck"))
    row = lambda start, n: json.dumps({"windowStart": start, "windowEnd": start + 30_000, "category": "A",
                                       "region": "R", "orderCount": n})
    for i, rows in enumerate([[row(0, 1), row(0, 2)], [row(0, 3), row(600_000, 1)], [row(0, 4), row(570_000, 1)]]):
        path = write_lines(src, f"{i}.json", rows)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(src)
    run = run_available_now(dedupe_metrics(parse_metrics(raw), delay="1 minute"), out, ck, state_partitions=2)
    got = sorted(r.windowStart for r in spark.read.parquet(out).collect())
    assert got == [0, 570_000, 600_000]
    assert run.rows_dropped_by_watermark() == 1
