"""All registered queries and their oracles, by name."""

from . import oracles, orders, report_oracles, timeseries, ts_oracles

QUERIES = {}
QUERIES.update(orders.QUERIES)
QUERIES.update(timeseries.QUERIES)

ORACLES = {}
ORACLES.update(oracles.ORACLES)
ORACLES.update(ts_oracles.ORACLES)
ORACLES.update(report_oracles.ORACLES)
