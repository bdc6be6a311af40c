"""Command line: the scenario report and the windowed-metrics job.

    python -m windlass.cli report --samples PATH --duration 30 --label "peak" --csv OUT
    python -m windlass.cli orders-job --servers HOST:9092 --checkpoint PATH

``report`` evaluates at ``--at`` (epoch ms; default: the newest sample),
prints the report as ``name: value`` lines and optionally appends the CSV
row (header included) under ``--csv``.  ``orders-job`` starts the Kafka ->
window metrics -> Kafka stream and waits for it.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    from .session import configure
    return configure(SparkSession.builder.appName("windlass").getOrCreate())


def run_report(spark: SparkSession, args) -> dict:
    from .plans.report import REFERENCE_SOURCES, report_csv_row, scenario_report
    from .sources.files import write_report_csv
    from .sources.samples import read_samples
    s = read_samples(spark, args.samples)
    at = args.at
    if at is None:
        # The newest day's partitions only.
        day = s.agg(F.max("date")).first()[0]
        at = int(s.where(F.col("date") == F.lit(day)).agg(F.max(F.unix_millis("ts"))).first()[0])
    rep = scenario_report(s, at, args.duration, label=args.label or "",
                          sources=REFERENCE_SOURCES, compat_rate=not args.plain_gauges)
    text = report_csv_row(rep)
    row = text.first().asDict()
    for k, v in row.items():
        print(f"{k}: {v}")
    if args.csv:
        write_report_csv(text, args.csv)
    return row


def run_orders_job(spark: SparkSession, args) -> None:
    from .streaming.jobs import start_orders_job
    start_orders_job(spark, args.servers, args.checkpoint, input_topic=args.input_topic,
                     output_topic=args.output_topic, trigger=args.trigger, exact=not args.approx,
                     lenient=not args.strict, starting=args.starting, max_per_trigger=args.max_per_trigger,
                     fail_on_data_loss=not args.allow_data_loss, state_partitions=args.state_partitions,
                     customer_buckets=args.customer_buckets, rejects_path=args.rejects)
    spark.streams.awaitAnyTermination()


def main(argv=None, spark: SparkSession | None = None):
    p = argparse.ArgumentParser(prog="windlass")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("report", help="scenario report over a samples table")
    r.add_argument("--samples", required=True)
    r.add_argument("--duration", type=int, default=30, help="look-back minutes")
    r.add_argument("--label", default="")
    r.add_argument("--at", type=int, default=None, help="evaluation instant, epoch ms")
    r.add_argument("--csv", default=None, help="append the CSV row under this path")
    r.add_argument("--plain-gauges", action="store_true",
                   help="read per-second gauges as they are instead of taking rate() of them")
    j = sub.add_parser("orders-job", help="Kafka -> window metrics -> Kafka")
    j.add_argument("--servers", required=True)
    j.add_argument("--checkpoint", required=True)
    j.add_argument("--input-topic", default="orders")
    j.add_argument("--output-topic", default="order-metrics")
    j.add_argument("--trigger", default="10 seconds")
    j.add_argument("--approx", action="store_true", help="count customers with a sketch")
    j.add_argument("--strict", action="store_true", help="reject numbers written as text")
    j.add_argument("--starting", default="earliest", help="offsets of the first start")
    j.add_argument("--max-per-trigger", type=int, default=None, help="records per micro-batch")
    j.add_argument("--allow-data-loss", action="store_true",
                   help="go on when retention removed unread records")
    j.add_argument("--state-partitions", type=int, default=None,
                   help="width of the state (default: spark.sql.shuffle.partitions)")
    j.add_argument("--customer-buckets", type=int, default=None,
                   help="keep exact customers as sets in that many parts (default: a state row per customer)")
    j.add_argument("--rejects", default=None, help="write rejected records there")
    args = p.parse_args(argv)
    spark = spark or _session()
    if args.cmd == "report":
        return run_report(spark, args)
    return run_orders_job(spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
