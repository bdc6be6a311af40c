"""AGG-11: per-run counters attached to a frame (produced / rejected).

``DataFrame.observe`` computes named aggregates as the data flows through,
without an extra job; batch results land in the ``Observation``, streaming
ones in ``query.lastProgress["observedMetrics"]``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .parse import _decode
from ..schemas import ORDER


def observe_orders(raw: DataFrame, name: str = "orders", lenient: bool = True):
    """Count records and rejects (null value, malformed JSON, bad
    timestamp) of a raw order frame.  Returns ``(frame, observation)``; the
    observation is ``None`` for streams (read it from query progress).  When
    the orders are parsed as well, ``parse_orders(counters=...)`` counts in
    the same decoding pass."""
    d = _decode(raw, ORDER, lenient)
    ts = F.coalesce(F.col("_p.orderTimestamp").try_cast("long"), F.lit(0).cast("long"))
    rejected = F.col("value").isNull() | F.col("_bad") | (ts <= 0)
    d = d.withColumn("_rejected", rejected)
    metrics = [F.count(F.lit(1)).alias("messages"),
               F.count_if(F.col("_rejected")).alias("errors")]
    if raw.isStreaming:
        return d.observe(name, *metrics).drop("_p", "_bad", "_rejected"), None
    obs = Observation(name)
    return d.observe(obs, *metrics).drop("_p", "_bad", "_rejected"), obs
