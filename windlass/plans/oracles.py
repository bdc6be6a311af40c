"""DuckDB SQL oracles for the registered queries (same column names).

``O`` is the orders adapter over ``events``; ``W`` the corrupted wire
adapter (faults flagged, not removed).  Both mirror
:mod:`windlass.sources.fixtures`.
"""

from __future__ import annotations

O_CTE = """
O AS (
  SELECT 'order-' || event_id AS "orderId",
         'CUST-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS "customerId",
         'PROD-' || lpad(CAST(event_id % 1000 AS VARCHAR), 5, '0') AS "productId",
         'Product ' || (event_id % 60) AS "productName",
         ['ELECTRONICS','CLOTHING','FOOD','HOME','SPORTS','BOOKS'][CAST(event_id % 6 AS INT) + 1] AS category,
         ['NORTH','SOUTH','EAST','WEST','CENTRAL'][CAST(user_id % 5 AS INT) + 1] AS region,
         CAST(1 + event_id % 10 AS INT) AS quantity,
         value AS "unitPrice",
         round((1 + event_id % 10) * value, 2) AS "totalAmount",
         epoch_ms(ts) // 1000 AS "orderTimestamp",
         epoch_ms(ts) // 1000 AS "ingestionTimestamp",
         event_id, event_type, value AS event_value
  FROM events
)"""

W_CTE = O_CTE + """,
W AS (
  SELECT "orderId", "customerId", "productId", "productName", category, region, quantity,
         "unitPrice",
         CASE WHEN event_type = 'view' AND event_value >= 200 THEN "totalAmount" + 1.0
              ELSE "totalAmount" END AS "totalAmount",
         CASE WHEN event_type = 'click' AND event_value < 5 THEN 0
              ELSE "orderTimestamp" END AS "orderTimestamp",
         "ingestionTimestamp", event_id,
         CASE WHEN event_type = 'signup' AND event_value < 2 THEN 'null_value'
              WHEN event_type = 'error' THEN 'malformed'
              WHEN event_type = 'click' AND event_value < 5 THEN 'bad_timestamp'
         END AS reason
  FROM O
)"""


def _metrics_select(size_ms: int, src: str = "O", where: str = '"orderTimestamp" > 0',
                    having: str = "") -> str:
    return f"""
SELECT ("orderTimestamp" // {size_ms}) * {size_ms} AS "windowStart",
       ("orderTimestamp" // {size_ms}) * {size_ms} + {size_ms} AS "windowEnd",
       category, region,
       count(*) AS "orderCount",
       round(sum("totalAmount"), 2) AS "totalRevenue",
       round(sum("totalAmount"), 2) / count(*) AS "avgOrderValue",
       CASE WHEN max("totalAmount") > 5e-324 THEN max("totalAmount") ELSE 0.0 END AS "maxOrderValue",
       CASE WHEN min("totalAmount") < 1.7976931348623157e308 THEN min("totalAmount") ELSE 0.0 END AS "minOrderValue",
       count(DISTINCT "customerId") + max(CASE WHEN "customerId" IS NULL THEN 1 ELSE 0 END) AS "uniqueCustomers"
FROM {src}
WHERE {where}
GROUP BY 1, 2, 3, 4
{having}"""


def metrics_sql(size_ms: int = 30000) -> str:
    return "WITH " + O_CTE + _metrics_select(size_ms)


_STREAM = ("WITH " + O_CTE + _metrics_select(
    30000, having='HAVING ("orderTimestamp" // 30000) * 30000 + 30000 <= '
                  '(SELECT max("orderTimestamp") FROM O) - 5000'))

_ARRIVALS = "WITH " + O_CTE + """,
A AS (
  SELECT *, ntile(10) OVER (ORDER BY arrival, event_id) AS b
  FROM (SELECT *, "orderTimestamp" + CASE WHEN event_id % 17 = 0 THEN 120000 ELSE 0 END AS arrival
        FROM O)
),
BM AS (SELECT b, max("orderTimestamp") AS bmax FROM A GROUP BY b),
WM AS (SELECT b, max(bmax) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5000 AS wm
       FROM BM)"""

_LATE_ORDERS = _ARRIVALS + """
SELECT ("orderTimestamp" // 30000) * 30000 AS "windowStart", category, region, count(*) AS "lateOrders",
       round(sum("totalAmount"), 2) AS "lateRevenue", min("orderId") AS "minOrderId", max("orderId") AS "maxOrderId",
       min(wm) AS "minWatermark", max(wm) AS "maxWatermark"
FROM A JOIN WM USING (b) WHERE ("orderTimestamp" // 30000) * 30000 + 30000 <= wm
GROUP BY 1, 2, 3"""

_LATE = _ARRIVALS + """,
K AS (
  SELECT A.* FROM A JOIN WM USING (b)
  WHERE wm IS NULL OR ("orderTimestamp" // 30000) * 30000 + 30000 > wm
)""" + _metrics_select(
    30000, src="K",
    having='HAVING ("orderTimestamp" // 30000) * 30000 + 30000 <= '
           '(SELECT max("orderTimestamp") FROM A) - 5000')

_SESSIONS = "WITH " + O_CTE + """,
S AS (
  SELECT *, CASE WHEN "orderTimestamp" - lag("orderTimestamp") OVER
                        (PARTITION BY category, region ORDER BY "orderTimestamp", event_id) <= 10000
                 THEN 0 ELSE 1 END AS brk
  FROM O WHERE "orderTimestamp" > 0
),
G AS (
  SELECT *, sum(brk) OVER (PARTITION BY category, region ORDER BY "orderTimestamp", event_id
                           ROWS UNBOUNDED PRECEDING) AS sid
  FROM S
)
SELECT min("orderTimestamp") AS "windowStart", max("orderTimestamp") + 10000 AS "windowEnd",
       category, region,
       count(*) AS "orderCount",
       round(sum("totalAmount"), 2) AS "totalRevenue",
       round(sum("totalAmount"), 2) / count(*) AS "avgOrderValue",
       CASE WHEN max("totalAmount") > 5e-324 THEN max("totalAmount") ELSE 0.0 END AS "maxOrderValue",
       CASE WHEN min("totalAmount") < 1.7976931348623157e308 THEN min("totalAmount") ELSE 0.0 END AS "minOrderValue",
       count(DISTINCT "customerId") + max(CASE WHEN "customerId" IS NULL THEN 1 ELSE 0 END) AS "uniqueCustomers"
FROM G GROUP BY category, region, sid"""

_SESSIONS_STREAM = _SESSIONS + """
HAVING max("orderTimestamp") + 10000 <= (SELECT max("orderTimestamp") FROM O) - 5000"""

_VALID_W = 'W WHERE reason IS NULL AND "orderTimestamp" > 0'

_PARSE = "WITH " + W_CTE + """
SELECT "orderId", "customerId", "productId", "productName", category, region, quantity,
       "unitPrice", "totalAmount", "orderTimestamp", "ingestionTimestamp"
FROM """ + _VALID_W

_REJECTED = "WITH " + W_CTE + """
SELECT reason, count(*) AS n, min(event_id) AS min_offset, max(event_id) AS max_offset
FROM W WHERE reason IS NOT NULL GROUP BY reason"""

_MISMATCH = "WITH " + W_CTE + """
SELECT "orderId", quantity, "unitPrice", "totalAmount",
       round(quantity * "unitPrice", 2) AS "expectedAmount"
FROM """ + _VALID_W + """
  AND abs("totalAmount" - round(quantity * "unitPrice", 2)) > 0.005"""

_M = "WITH " + O_CTE + ", M AS (" + _metrics_select(30000) + ")"

_ENCODE = _M + """
SELECT category || '#' || region AS key, 10 AS json_fields, * FROM M"""


def _java_fixed2(x: str) -> str:
    # Java's %.2f rounds HALF_UP on the shortest decimal form of the double.
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 2)) AS VARCHAR)"


_FORMAT = "WITH " + O_CTE + """, M AS (
  SELECT ("orderTimestamp" // 30000) * 30000 AS ws, category, region, count(*) AS n,
         round(sum("totalAmount"), 2) AS rev, count(DISTINCT "customerId") AS cust
  FROM O WHERE "orderTimestamp" > 0 GROUP BY 1, 2, 3
)
SELECT '[window=' || ws || '-' || (ws + 30000) || '] category=' || category || ' region=' || region
       || ' orders=' || n || ' revenue=' || """ + _java_fixed2("rev") + """
       || ' avg=' || """ + _java_fixed2("rev / n") + """ || ' customers=' || cust AS line
FROM M"""

_SUMMARY = _M + """
SELECT count(*) AS "windowsProcessed", coalesce(max("windowEnd"), 0) AS "lastWindowEnd" FROM M"""

_DEDUPE = _M + " SELECT * FROM M"

ORACLES = {
    "order_metrics_30s": metrics_sql(30000),
    "order_metrics_1m": metrics_sql(60000),
    "order_metrics_1h": metrics_sql(3600000),
    "order_metrics_stream": _STREAM,
    "late_data_drop": _LATE,
    "late_orders": _LATE_ORDERS,
    "order_sessions": _SESSIONS,
    "merge_partials_5m": metrics_sql(300000),
    "rollup_partials_10m": metrics_sql(600000),
    "order_sessions_stream": _SESSIONS_STREAM,
    "parse_orders_json": _PARSE,
    "parse_orders_lenient": "WITH " + O_CTE + """
SELECT "orderId", "customerId", "productId", "productName", category, region, quantity,
       "unitPrice", "totalAmount", "orderTimestamp", "ingestionTimestamp" + 9007199254740993 AS "ingestionTimestamp"
FROM O""",
    "approx_customers": "SELECT *, TRUE AS within_bound FROM (" + metrics_sql(30000) + ")",
    "rejected_orders": _REJECTED,
    "order_total_mismatch": _MISMATCH,
    "encode_metrics": _ENCODE,
    "format_metrics": _FORMAT,
    "log_lines_sink": _FORMAT,
    "metrics_summary": _SUMMARY,
    "dedupe_metrics": _DEDUPE,
    "dedupe_metrics_stream": _DEDUPE,
}
