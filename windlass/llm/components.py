"""Connected components of an edge table, on Spark only.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every step joins the edges with
the smallest neighbour of each node, so no node's neighbours are ever
gathered in one task -- a hub's edges are split by the skew-join rule, its
minimum is a map-side combined aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (u > v): each node's larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _mins(both).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (u > v): each node and its smaller neighbours to the smallest."""
    low = _mins(edges)
    moved = (edges.join(low, "u").where("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node
    reachable.  ``edges`` has two long columns a, b (any direction, repeats
    and loops allowed; null ends are ignored); no edges give no rows."""
    cur = materialise(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(cur)
    for _ in range(max_rounds):
        if not state[0]:
            break
        cur = materialise(_small_star(_large_star(cur)), "stars")
        before, state = state, _state(cur)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    # At the fixpoint every node hangs directly on its root.
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
