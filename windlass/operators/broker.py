"""PRJ-8: broker metric-bean names -> (metric, labels) samples.

Raw input is ``(name, ts, value)`` with JMX-style names such as
``kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic=orders><>OneMinuteRate``.
A bean must be on the allow-list (domain + type); then the first rule
whose fully anchored pattern matches names the metric and fills labels
from capture groups; beans no rule matches are dropped.

Rules are a table.  A bean name is looked at once, however many samples carry
it: its domain, attribute and the values after ``name=`` find the rules that
can match by hash, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The exporter allow-list, as (domain, type) pairs.
ALLOWLIST = [
    ("kafka.server", "BrokerTopicMetrics"),
    ("kafka.server", "FetcherLagMetrics"),
    ("kafka.server", "ReplicaManager"),
    ("kafka.controller", "KafkaController"),
    ("kafka.network", "RequestMetrics"),
]

# The exporter rules in order (pattern, metric name, label ->
# capture group).  First match wins.
RULES = [
    ("kafka.server<.*name=MessagesInPerSec.*topic=([^,>]+).*><>OneMinuteRate",
     "kafka_server_brokertopicmetrics_messagesin_oneminuterate", {"topic": 1}),
    ("kafka.server<.*name=BytesInPerSec.*topic=([^,>]+).*><>OneMinuteRate",
     "kafka_server_brokertopicmetrics_bytesin_oneminuterate", {"topic": 1}),
    ("kafka.server<.*name=ConsumerLag.*topic=([^,>]+).*partition=([0-9]+).*><>Value",
     "kafka_server_fetcherlagmetrics_consumerlag", {"topic": 1, "partition": 2}),
    ("kafka.server<.*name=UnderReplicatedPartitions.*><>Value",
     "kafka_server_replicamanager_underreplicatedpartitions", {}),
    ("kafka.controller<.*name=ActiveControllerCount.*><>Value",
     "kafka_controller_kafkacontroller_activecontrollercount", {}),
    ("kafka.network<.*name=TotalTimeMs.*request=([^,>]+).*><>Mean",
     "kafka_network_requestmetrics_totaltimems_mean", {"request": 1}),
]

LABEL_NAMES = ("topic", "partition", "request")


#: A rule table of at most so many rows is broadcast, a larger one shuffled.
BROADCAST_RULES = 50_000
_WORD = "[A-Za-z0-9_ %-]"
_RULE_DDL = "rule long, domain string, attribute string, key string, pattern string, metric string, groups map<string,int>"


def _needs(pattern: str) -> tuple[str | None, str | None, str | None]:
    """What any text that a fully anchored pattern matches must hold: (pattern
    of its domain, exact attribute, literal that follows a ``name=``); None
    where the pattern does not say."""
    m = re.fullmatch(r"([^<()|\\]*)<(.*)><>([^<>]*)", pattern)
    if not m or "|" in pattern or "\\" in pattern:
        return None, None, None
    domain, body, attribute = m.groups()
    plain = re.sub(r"\([^()]*\)", lambda g: "\x00" * len(g[0]), body)     # groups may be optional
    key = re.search(rf"name=({_WORD}+)([*?{{]?)", plain)
    literal = key[1][:-1] if key and key[2] else key[1] if key else None
    return domain, attribute if re.fullmatch(f"{_WORD}+", attribute) else None, literal or None


def rule_table(spark: SparkSession, rules: Sequence = RULES, allowlist: Sequence = ALLOWLIST) -> DataFrame:
    """The rules, first match first, as rows found by (domain, attribute,
    key); an empty attribute or key stands for any.  A rule has a row for each
    domain of the allow-list that it can match."""
    rows = []
    for i, (pattern, metric, groups) in enumerate(rules):
        domain, attribute, key = _needs(pattern)
        for d in sorted({d for d, _ in allowlist}):
            if domain is None or re.fullmatch(domain, d):
                rows.append((i, d, attribute or "", key or "", f"^(?:{pattern})$", metric, dict(groups)))
    return spark.createDataFrame(rows, _RULE_DDL)


def _named(names: DataFrame, table: DataFrame, allowlist: Sequence) -> DataFrame:
    """(name, metric, labels) of the distinct bean ``names`` that a rule
    matches: of several the first."""
    name = F.col("name")
    # The type may stand anywhere among the bean's properties.
    head = F.concat(F.substring_index(name, ">", 1), F.lit(">"))
    types = F.regexp_extract_all(head, F.lit("(?<=[<,]) *type=(?=([^,>]+)[,>])"), 1)
    pairs = F.array(*[F.lit(f"{d}<{t}") for d, t in allowlist])
    domain = F.substring_index(name, "<", 1)
    mine = F.transform(types, lambda t: F.concat(domain, F.lit("<"), F.rtrim(t)))
    beans = names.where(F.arrays_overlap(mine, pairs)) if allowlist else names.limit(0)
    # Any start of a value after "name=" may be a rule's key, so the starts of
    # the lengths that keys have are looked up.
    lengths = F.array(*[F.lit(n) for n in sorted(
        r.n for r in table.select(F.length("key").alias("n")).distinct().collect() if r.n)] or [F.lit(0)])
    values = F.regexp_extract_all(name, F.lit(f"name=(?=({_WORD}+))"), 1)
    starts = F.flatten(F.transform(values, lambda v: F.transform(lengths, lambda n: F.substring(v, F.lit(1), n))))
    attribute = F.substring_index(name, "><>", -1)
    beans = (beans.select("name", domain.alias("domain"), F.explode(F.array_distinct(F.array(attribute, F.lit("")))).alias("attribute"),
                          F.array_distinct(F.concat(F.array(F.lit("")), starts)).alias("keys"))
             .select("name", "domain", "attribute", F.explode("keys").alias("key")))
    rules = F.broadcast(table) if table.count() <= BROADCAST_RULES else table
    hit = beans.join(rules, ["domain", "attribute", "key"]).where(F.regexp_like("name", "pattern"))
    first = hit.groupBy("name").agg(F.min_by(F.struct("pattern", "metric", "groups"), "rule").alias("r"))
    labels = F.map_from_entries(F.transform(F.map_entries("r.groups"), lambda e: F.struct(
        e["key"], F.call_function("regexp_extract", name, F.col("r.pattern"), e["value"]))))
    return first.select("name", F.col("r.metric").alias("metric"), labels.alias("labels"))


def normalise_broker_samples(raw: DataFrame, rules: Sequence | DataFrame = RULES, allowlist: Sequence = ALLOWLIST,
                             flat: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw beans -> SAMPLES (``metric, labels, ts, value``).  With
    ``flat=True`` the labels come out as ``topic, partition, request``
    columns (null when the rule sets none) instead of a map; ``keep`` names
    raw columns to carry along.  ``rules`` is a list like RULES or a table
    like :func:`rule_table`'s."""
    table = rules if isinstance(rules, DataFrame) else rule_table(raw.sparkSession, rules, allowlist)
    named = _named(raw.select("name").where("name is not null").distinct(), table, allowlist)
    named = named.select(F.col("name").alias("_bean"), F.col("metric").alias("_metric"), F.col("labels").alias("_labels"))
    df = raw.join(named, F.col("name") == F.col("_bean"))
    labels = ([F.col("_labels")[k].alias(k) for k in LABEL_NAMES] if flat else [F.col("_labels").alias("labels")])
    return df.select(F.col("_metric").alias("metric"), *labels, "ts", "value", *keep)
