"""DuckDB oracles for the time-series queries (mirror of the adapters in
:mod:`windlass.sources.fixtures`; the step grid is an ASOF JOIN)."""

from __future__ import annotations

from ..operators.broker import ALLOWLIST, RULES

# The look-back that covers the whole table: its span in whole minutes and two more.
RANGE = "((max(ts_ms) - min(ts_ms)) // 60000 + 2) * 60000"
STEP = 15_000
LOOKBACK = 300_000

SAMPLES_CTE = f"""
E AS (
  SELECT event_id, epoch_ms(ts) // 1000 AS ts_ms,
         CASE event_type WHEN 'view' THEN 'records_per_second' WHEN 'click' THEN 'backpressured'
              WHEN 'error' THEN 'consumer_lag' WHEN 'signup' THEN 'pod_ready'
              WHEN 'purchase' THEN 'checkpoint_ms' END AS metric,
         'orders-worker-' || (user_id % 4) AS pod,
         CASE WHEN user_id % 2 = 0 THEN 'Running' ELSE 'Pending' END AS phase,
         CASE WHEN event_type IN ('click', 'signup') THEN CAST(event_id % 2 AS DOUBLE)
              ELSE value END AS value
  FROM events
),
GA AS (
  SELECT metric, pod, phase, ts_ms, arg_max(value, event_id) AS value
  FROM E GROUP BY metric, pod, phase, ts_ms
),
CT AS (
  SELECT metric || '_total' AS metric, pod, phase, ts_ms, arg_max(cv, event_id) AS value
  FROM (SELECT *, sum(round(value * 100)) OVER (
                    PARTITION BY metric, pod, event_id // 1000 ORDER BY event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cv
        FROM E)
  GROUP BY 1, 2, 3, 4
),
S AS (SELECT * FROM GA UNION ALL SELECT * FROM CT),
P AS (
  SELECT max(ts_ms) AS at_ms, {RANGE} AS range_ms,
         ((max(ts_ms) - {RANGE}) // {STEP} + 1) * {STEP} AS first,
         (max(ts_ms) // {STEP}) * {STEP} AS last
  FROM S
),
GRID AS (SELECT unnest(range(first, last + 1, {STEP})) AS step FROM P)"""


def _in(metrics) -> str:
    if isinstance(metrics, str):
        metrics = [metrics]
    return "(" + ", ".join(f"'{m}'" for m in metrics) + ")"


def resample_cte(name: str, metrics=None, pred: str | None = None) -> str:
    """``name`` = (metric, pod, phase, step, value, ts_ms) on the grid."""
    where = pred if pred is not None else f"metric IN {_in(metrics)}"
    return f""",
{name}_X AS (SELECT S.* FROM S, P WHERE {where} AND ts_ms > first - {LOOKBACK} AND ts_ms <= last),
{name}_L AS (SELECT DISTINCT metric, pod, phase FROM {name}_X),
{name}_G AS (SELECT {name}_L.*, GRID.step FROM {name}_L, GRID),
{name} AS (
  SELECT g.metric, g.pod, g.phase, g.step, x.value, x.ts_ms
  FROM {name}_G g ASOF JOIN {name}_X x
    ON g.metric = x.metric AND g.pod = x.pod AND g.phase = x.phase AND x.ts_ms <= g.step
  WHERE x.ts_ms > g.step - {LOOKBACK}
)"""


def with_samples(*resamples: tuple[str, object]) -> str:
    return "WITH " + SAMPLES_CTE + "".join(resample_cte(n, m) for n, m in resamples)


def rate_cte(name: str, pred: str, window_ms: int) -> str:
    """``name`` = (metric, pod, phase, step, value): counter rate per step."""
    n = name
    return f""",
{n}_CS AS (
  SELECT S.metric, S.pod, S.phase, S.ts_ms, S.value,
         lag(S.value) OVER (PARTITION BY S.metric, S.pod, S.phase ORDER BY S.ts_ms) AS pv
  FROM S, P WHERE {pred} AND S.ts_ms > P.first - {window_ms} AND S.ts_ms <= P.last
),
{n}_CI AS (
  SELECT *, CASE WHEN pv IS NULL THEN 0.0 WHEN value < pv THEN value ELSE value - pv END AS inc,
         greatest(((ts_ms + {STEP - 1}) // {STEP}) * {STEP}, (SELECT first FROM P)) AS lo,
         least(((ts_ms + {window_ms - 1}) // {STEP}) * {STEP}, (SELECT last FROM P)) AS hi
  FROM {n}_CS
),
{n}_X AS (SELECT *, unnest(range(lo, hi + 1, {STEP})) AS step FROM {n}_CI WHERE lo <= hi),
{n}_AG AS (
  SELECT metric, pod, phase, step, count(*) AS n,
         min(ts_ms) AS fts, arg_min(value, ts_ms) AS fv, arg_min(inc, ts_ms) AS finc,
         max(ts_ms) AS lts, sum(inc) AS sinc
  FROM {n}_X GROUP BY metric, pod, phase, step HAVING count(*) >= 2
),
{n}_F1 AS (
  SELECT *, sinc - finc AS res,
         CAST(lts - fts AS DOUBLE) / 1000.0::DOUBLE AS sampled,
         CAST(fts - (step - {window_ms}) AS DOUBLE) / 1000.0::DOUBLE AS ts0,
         CAST(step - lts AS DOUBLE) / 1000.0::DOUBLE AS te0
  FROM {n}_AG
),
{n}_F2 AS (SELECT *, sampled / CAST(n - 1 AS DOUBLE) AS gap FROM {n}_F1),
{n}_F3 AS (
  SELECT *, CASE WHEN ts0 >= gap * 1.1::DOUBLE THEN gap / 2.0::DOUBLE ELSE ts0 END AS ts1,
            CASE WHEN te0 >= gap * 1.1::DOUBLE THEN gap / 2.0::DOUBLE ELSE te0 END AS te1
  FROM {n}_F2
),
{n}_F4 AS (
  SELECT *, CASE WHEN res > 0 AND fv >= 0 AND sampled * (fv / res) < ts1
                 THEN sampled * (fv / res) ELSE ts1 END AS ts2
  FROM {n}_F3
),
{n} AS (
  SELECT metric, pod, phase, step,
         res * (((sampled + ts2) + te1) / sampled / {window_ms / 1000.0}::DOUBLE) AS value
  FROM {n}_F4
)"""


def rate_sql(metrics, window_ms: int) -> str:
    return with_samples() + rate_cte("RT", f"S.metric IN {_in(metrics)}", window_ms)


ORACLES = {}

ORACLES["select_series_regex"] = with_samples() + """
SELECT metric, pod, phase, ts_ms, value FROM S
WHERE metric = 'records_per_second' AND phase <> 'Pending'
  AND regexp_full_match(pod, '.*worker-[01]') AND NOT regexp_full_match(pod, '.*-9')"""

ORACLES["instant_value"] = with_samples() + f"""
SELECT metric, pod, phase, arg_max(value, ts_ms) AS value
FROM S, P WHERE ts_ms > at_ms - {LOOKBACK} AND ts_ms <= at_ms
GROUP BY metric, pod, phase"""

ORACLES["resample_15s"] = with_samples(
    ("R", ["records_per_second", "consumer_lag", "checkpoint_ms"])) + """
SELECT metric, pod, phase, step, value FROM R"""

ORACLES["over_time"] = with_samples(("R", ["records_per_second", "consumer_lag"])) + """
SELECT metric, pod, phase, max(value) AS max_v, min(value) AS min_v,
       round(sum(value), 2) / count(value) AS avg_v, count(value) AS n
FROM R GROUP BY metric, pod, phase"""

ORACLES["tier_summary"] = with_samples() + """,
L AS (SELECT S.*, lag(value) OVER (PARTITION BY metric, pod, phase ORDER BY ts_ms) AS pv FROM S
      WHERE metric IN ('records_per_second_total', 'consumer_lag'))
SELECT metric, pod, phase, count(*) AS n, min(value) AS low, max(value) AS high, round(sum(value), 2) AS total,
       min(ts_ms) AS first_ts, arg_min(value, ts_ms) AS first_value, max(ts_ms) AS last_ts,
       arg_max(value, ts_ms) AS last_value,
       round(arg_max(value, ts_ms) - arg_min(value, ts_ms) + sum(CASE WHEN value < pv THEN pv ELSE 0.0 END), 2) AS increase
FROM L GROUP BY metric, pod, phase"""

ORACLES["counter_rate_1h"] = rate_sql("records_per_second_total", 3_600_000) + """
SELECT metric, pod, phase, step, round(value, 9) AS value FROM RT"""

ORACLES["counter_rate"] = rate_sql(["records_per_second_total", "checkpoint_ms_total"], 60_000) + """
SELECT metric, pod, phase, step, value FROM RT"""

ORACLES["sum_by_pod"] = with_samples(("R", ["checkpoint_ms", "consumer_lag"])) + """
SELECT step, pod, round(sum(value), 2) AS value FROM R GROUP BY step, pod"""

ORACLES["count_by_phase"] = with_samples(("R", "pod_ready")) + """
SELECT step, phase, CAST(count(value) AS DOUBLE) AS value FROM R GROUP BY step, phase"""

ORACLES["avg_pct"] = with_samples(("R", "backpressured")) + """
SELECT step, avg(value) * 100.0::DOUBLE AS value FROM R GROUP BY step"""

ORACLES["ready_pods"] = with_samples(("R", "pod_ready")) + """,
C AS (SELECT step, CAST(count(value) AS DOUBLE) AS n FROM R WHERE value = 1 GROUP BY step)
SELECT GRID.step, coalesce(C.n, 0.0) AS value FROM GRID LEFT JOIN C USING (step)"""

ORACLES["startup_latency"] = with_samples(("A", "records_per_second"), ("B", "checkpoint_ms")) + """
SELECT A.pod, A.phase, A.step, A.value - B.value AS value
FROM A JOIN B ON A.pod = B.pod AND A.phase = B.phase AND A.step = B.step"""

ORACLES["watermark_lag"] = with_samples(("R", "checkpoint_ms")) + """
SELECT metric, pod, phase, step, value - CAST(step AS DOUBLE) * 1.0::DOUBLE AS value FROM R"""

ORACLES["panel_last_mean"] = with_samples(("R", "backpressured")) + """,
Q AS (SELECT metric, pod, phase, arg_max(value * 100.0::DOUBLE, step) AS last_v,
             avg(value * 100.0::DOUBLE) AS mean
      FROM R GROUP BY metric, pod, phase)
SELECT metric, pod, phase, last_v AS "lastNotNull", mean,
       CASE WHEN last_v >= 75.0 THEN 'red' WHEN last_v >= 25.0 THEN 'yellow' ELSE 'green' END AS status,
       CASE WHEN last_v / 100.0::DOUBLE = 0.0 THEN 'INACTIVE' WHEN last_v / 100.0::DOUBLE = 1.0 THEN 'PEAK'
            ELSE CAST(last_v / 100.0::DOUBLE AS VARCHAR) END AS flag
FROM Q"""

_RATES = """
L AS (
  SELECT metric, pod, phase, ts_ms, value,
         lag(value) OVER (PARTITION BY metric, pod, phase ORDER BY ts_ms) AS pv,
         lag(ts_ms) OVER (PARTITION BY metric, pod, phase ORDER BY ts_ms) AS pts
  FROM PTS
)
SELECT metric, pod, phase, ts_ms, CAST(value - pv AS BIGINT) AS delta,
       greatest(1, ts_ms - pts) AS delta_ms,
       (CAST(value - pv AS BIGINT) * 1000) // greatest(1, ts_ms - pts) AS rate
FROM L WHERE pts IS NOT NULL"""

ORACLES["progress_rate"] = with_samples() + """,
PTS AS (SELECT * FROM S WHERE metric = 'records_per_second_total'),""" + _RATES

# The greedy rule step by step: the next point is the first at least 10 s later.
ORACLES["progress_rate_10s"] = "WITH RECURSIVE " + SAMPLES_CTE + """,
C AS (SELECT * FROM S WHERE metric = 'records_per_second_total'),
K AS (
  SELECT metric, pod, phase, min(ts_ms) AS ts_ms FROM C GROUP BY 1, 2, 3
  UNION ALL
  SELECT k.metric, k.pod, k.phase, min(c.ts_ms) FROM K k JOIN C c
    ON c.metric = k.metric AND c.pod = k.pod AND c.phase = k.phase AND c.ts_ms >= k.ts_ms + 10000
  GROUP BY 1, 2, 3
),
PTS AS (SELECT C.* FROM C JOIN K USING (metric, pod, phase, ts_ms)),""" + _RATES

def _broker_sql(keep_event_id: bool = False) -> str:
    def anch(p):
        return "^(?:" + p + ")$"
    metric = "CASE " + " ".join(
        f"WHEN regexp_matches(name, '{anch(p)}') THEN '{m}'" for p, m, _ in RULES) + " END"
    labels = []
    for lname in ("topic", "partition", "request"):
        parts = []
        for p, _, groups in RULES:
            val = (f"regexp_extract(name, '{anch(p)}', {groups[lname]})" if lname in groups
                   else "NULL")
            parts.append(f"WHEN regexp_matches(name, '{anch(p)}') THEN {val}")
        labels.append("CASE " + " ".join(parts) + f" END AS {lname}")
    # The bean's properties as a list, whatever their order.
    allow = " OR ".join(
        f"(starts_with(name, '{d}<') AND list_contains(string_split(regexp_extract(name, '<([^>]*)>', 1), ', '), "
        f"'type={t}'))" for d, t in ALLOWLIST)
    return f"""
WITH EV AS (
  SELECT *, CASE WHEN user_id % 2 = 0 THEN 'orders' ELSE 'order-metrics' END AS topic_v,
         epoch_ms(ts) // 1000 AS ts_ms
  FROM events
),
B AS (
  SELECT CASE
    WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'kafka.server<name=MessagesInPerSec, topic=' || topic_v || ', type=BrokerTopicMetrics><>OneMinuteRate'
    WHEN event_type = 'view' AND event_id % 3 = 1 THEN 'kafka.server<name=MessagesInPerSec, type=BrokerTopicMetrics, topic=' || topic_v || '><>OneMinuteRate'
    WHEN event_type = 'view' AND user_id % 7 = 0 THEN 'kafka.server<type=BrokerTopicMetricsX, name=MessagesInPerSec, topic=' || topic_v || '><>OneMinuteRate'
    WHEN event_type = 'view' THEN 'kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic=' || topic_v || '><>OneMinuteRate'
    WHEN event_type = 'click' THEN 'kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec, topic=' || topic_v || '><>OneMinuteRate'
    WHEN event_type = 'error' THEN 'kafka.server<type=FetcherLagMetrics, name=ConsumerLag, clientId=ReplicaFetcherThread-0-1, topic=' || topic_v || ', partition=' || (user_id % 12) || '><>Value'
    WHEN event_type = 'signup' THEN 'kafka.server<type=ReplicaManager, name=UnderReplicatedPartitions><>Value'
    WHEN user_id % 3 = 0 THEN 'kafka.controller<type=KafkaController, name=ActiveControllerCount><>Value'
    WHEN user_id % 3 = 1 THEN 'kafka.network<type=RequestMetrics, name=TotalTimeMs, request=' || CASE WHEN user_id % 2 = 0 THEN 'Produce' ELSE 'FetchConsumer' END || '><>Mean'
    ELSE 'kafka.server<type=BrokerTopicMetrics, name=TotalFetchRequestsPerSec><>Count' END AS name,
    ts_ms, value, event_id
  FROM EV
),
N AS (SELECT {metric} AS metric, {", ".join(labels)}, ts_ms, value{", event_id" if keep_event_id else ""}
      FROM B WHERE {allow})
SELECT * FROM N WHERE metric IS NOT NULL"""


ORACLES["normalise_broker"] = _broker_sql()

ORACLES["broker_consumer_lag"] = "WITH BN AS (" + _broker_sql(keep_event_id=True) + f"""),
D AS (SELECT metric, topic, "partition", request, ts_ms, arg_max(value, event_id) AS value
      FROM BN GROUP BY metric, topic, "partition", request, ts_ms),
P AS (SELECT max(ts_ms) AS at_ms,
             ((max(ts_ms) - {RANGE}) // {STEP} + 1) * {STEP} AS first,
             (max(ts_ms) // {STEP}) * {STEP} AS last FROM (SELECT epoch_ms(ts) // 1000 AS ts_ms FROM events)),
GRID AS (SELECT unnest(range(first, last + 1, {STEP})) AS step FROM P),
X AS (SELECT D.* FROM D, P WHERE metric = 'kafka_server_fetcherlagmetrics_consumerlag'
        AND topic = 'orders' AND ts_ms > first - {LOOKBACK} AND ts_ms <= last),
L AS (SELECT DISTINCT metric, topic, "partition" FROM X),
G AS (SELECT L.*, GRID.step FROM L, GRID),
R AS (SELECT g.step, x.value FROM G g ASOF JOIN X x
        ON g.metric = x.metric AND g.topic = x.topic AND g."partition" = x."partition"
        AND x.ts_ms <= g.step
      WHERE x.ts_ms > g.step - {LOOKBACK})
SELECT step, round(sum(value), 2) AS value FROM R GROUP BY step"""
