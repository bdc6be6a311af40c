"""Merkle manifest of a dataset: a subtree for each source, one root over all.

Nodes are labelled by nested intervals: a leaf of rank r in its source covers
[r, r + 1), a node the interval of the leaf ranks below it.  A node of level k
covers at most FAN ** k ranks, so its bucket lo div FAN ** k is a join key:
from the root down, each level joins its nodes with the ancestors of the next
one by bucket and by containment of the intervals.  The siblings of a node are
the parts of its ancestor outside its own interval.  An ancestor has at most
FAN nodes below it, so no key is ever hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import global_rank
from .common import ascii_lower, materialise

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a leaf's proof holds: of each level up to the root, the digests left
#: and right of the way.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the value with its length in bytes before it."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*[field(c) for c in fields])


def joined(path: Column) -> Column:
    """The sibling digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(path, start, lambda acc, p: digest(p["left"], acc, p["right"]))


def _ranked(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their source's number ``grp``, its size ``n`` and their rank
    ``lo`` in it; and the sources (grp).  A range-partitioned sort numbers the
    rows; a source's share of each range (``seg``) gives it its offset there,
    so that a source may fill any number of ranges."""
    order = ["source", "id", "leaf", "row"]
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ranged = materialise(leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
                         .withColumn("pid", F.spark_partition_id()).withColumn("at", at), "merkle-ranged")
    seg = ranged.groupBy("pid", "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("source")
    before = F.sum("size").over(w.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    seg = seg.select(F.col("pid").alias("p"), F.col("source").alias("s"), F.sum("size").over(w).alias("n"),
                     (F.coalesce(before, F.lit(0)) - F.col("first")).alias("off"))
    sources = global_rank(seg.select(F.col("s").alias("src")).distinct(), ["src"], "grp").drop("_n")
    seg = seg.join(sources, F.col("s").eqNullSafe(F.col("src")))
    rows = ranged.join(seg, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    drop = ("pid", "at", "source", "p", "s", "src", "off")
    return materialise(rows.withColumn("lo", F.col("at") + F.col("off")).drop(*drop), "merkle-leaves"), sources


def _levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Nodes (grp, n, lo, hi, leaf: digest, parts) of each level over the
    leaves (grp, n, lo, leaf); a group that has come down to one node has none
    above."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    cur = leaves.select("grp", "n", "lo", (F.col("lo") + 1).alias("hi"), "leaf")
    levels, span = [], 1
    while span < most:
        runs = (cur.where(F.col("n") > span).withColumn("b", F.expr(f"lo div {span * FAN}L"))
                .groupBy("grp", "n", "b").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "leaf"))).alias("parts")))
        cur = materialise(runs.select("grp", "n", F.col("parts")[0]["lo"].alias("lo"),
                                      F.element_at("parts", -1)["hi"].alias("hi"),
                                      F.sha2(F.array_join(F.col("parts.leaf"), ""), 256).alias("leaf"), "parts"),
                          f"merkle-{name}-{len(levels) + 1}")
        levels.append(cur)
        span *= FAN
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, leaf) of the last node of each group."""
    out = leaves.where("n = 1").select("grp", "leaf")
    for k, nodes in enumerate(levels, 1):
        out = out.unionByName(nodes.where(F.col("n") <= FAN ** k).select("grp", "leaf"))
    return out


def _paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``path`` (and the other columns of ``above``: grp,
    path, ..., which says what lies over each group's last node)."""
    extra = [c for c in above.columns if c != "grp"]
    nodes = [leaves.withColumn("hi", F.col("lo") + 1), *levels]
    over = None
    for k in range(len(levels), -1, -1):
        span, cur = FAN ** k, nodes[k]
        # Where one node is left, the path so far is that over the group.
        out = cur.where(F.col("n") <= span).join(above, "grp")
        if over is not None:
            c = cur.where(F.col("n") > span).withColumn("b", F.expr(f"lo div {span * FAN}L"))
            a = over.select(F.col("grp").alias("g"), F.expr(f"lo div {span * FAN}L").alias("ab"),
                            F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("parts").alias("aparts"),
                            *[F.col(x).alias("a_" + x) for x in extra])
            c = c.join(a, (F.col("grp") == F.col("g")) & (F.col("b") == F.col("ab"))
                       & (F.col("alo") <= F.col("lo")) & (F.col("hi") <= F.col("ahi")))
            side = lambda keep: F.array_join(F.transform(F.filter("aparts", keep), lambda p: p["leaf"]), "")
            step = F.struct(side(lambda p: p["hi"] <= F.col("lo")).alias("left"),
                            side(lambda p: p["lo"] >= F.col("hi")).alias("right"))
            out = out.unionByName(c.select(*cur.columns, F.concat(F.array(step), F.col("a_path")).alias("path"),
                                           *[F.col("a_" + x).alias(x) for x in extra if x != "path"]))
        over = out
    return over.drop("hi")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             also: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, path (PATH), and
    the columns ``also`` computed from it beside its leaf.

    A leaf is the digest of ``fields``.  Leaves of a source ascend by id
    (nulls first; equal ids by digest, so repeated rows are leaves of their
    own and come out alike whatever their order); null is a source of its own
    and comes first.  A null or empty text is a field as any other; no rows
    give none; other columns are ignored."""
    also = dict(also or {})
    leaves = materialise(docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"),
                                     leaf(*[F.col(c) for c in fields]).alias("leaf"),
                                     *[c.alias("x_" + name) for name, c in also.items()])
                         .withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    rows, sources = _ranked(leaves)
    levels = _levels(rows, "tree")
    subroots = materialise(_tops(rows, levels), "merkle-subroots")
    upper = sources.join(subroots, "grp").select(
        F.lit(0).alias("grp"), F.lit(sources.count()).cast("long").alias("n"), F.col("grp").alias("lo"), "leaf")
    top_levels = _levels(upper, "top")
    root = _tops(upper, top_levels).first()
    none = docs.sparkSession.range(1).select(F.lit(0).alias("grp"), F.expr(f"cast(array() as {PATH})").alias("path"))
    above = materialise(_paths(upper, top_levels, none).select(
        F.col("lo").alias("grp"), "path", F.col("leaf").alias("subroot")), "merkle-above")
    return _paths(rows, levels, above).select(
        "id", "leaf", "subroot", F.lit(root.leaf if root else None).cast("string").alias("root"), "path",
        *[F.col("x_" + name).alias(name) for name in also])


def tampered_leaf(fields: Sequence[str] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text was lower-cased (A-Z), for ids whose CRC-32
    5 divides; null for the others, and for a null id."""
    low = leaf(*[ascii_lower(F.col(c)) if c == text_col else F.col(c) for c in fields])
    return F.when(F.crc32(F.col(id_col).cast("string")) % 5 == 0, low)


def audit(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` against the manifest, after tampering with the
    rows of :func:`tampered_leaf`: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified.  Edge cases as for :func:`manifest`."""
    m = manifest(docs, also={"tampered": tampered_leaf()})
    return m.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(joined(F.col("path")), 256).alias("proof_sha256"),
                    fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


ORACLE = """
WITH RECURSIVE
crc(t) AS (SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM (SELECT unnest(range(256)) AS i))),
rows_ AS (
    SELECT doc_id, source, prefix, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body,
           CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text,
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS low,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
               lambda s: ord(s)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
                 AS prefix FROM documents), crc),
leaves AS (
    SELECT doc_id, sha256(prefix || body) AS leaf,
           CASE WHEN crc % 5 = 0 THEN sha256(prefix || low) ELSE sha256(prefix || body) END AS start,
           dense_rank() OVER (ORDER BY source NULLS FIRST) AS grp, count(*) OVER (PARTITION BY source) AS n,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(prefix || body)) - 1 AS r
    FROM rows_),
nodes AS (
    SELECT grp, n, 0 AS lv, r AS i, leaf AS h FROM leaves
    UNION ALL
    SELECT grp, n, lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes
    WHERE n > 16 ** lv GROUP BY grp, n, lv, i // 16),
subroots AS (SELECT grp, h, count(*) OVER () AS s, row_number() OVER (ORDER BY grp) - 1 AS r
             FROM nodes WHERE i = 0 AND n <= 16 ** lv),
tops AS (
    SELECT s, 0 AS lv, r AS i, h FROM subroots
    UNION ALL
    SELECT s, lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE s > 16 ** lv GROUP BY s, lv, i // 16),
root AS (SELECT h AS root FROM tops WHERE i = 0 AND s <= 16 ** lv),
steps AS (
    SELECT a.grp, a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') || '|'
           || coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS p
    FROM nodes a JOIN nodes b ON a.grp = b.grp AND a.lv = b.lv AND a.i // 16 = b.i // 16
    WHERE a.n > 16 ** a.lv GROUP BY ALL),
top_steps AS (
    SELECT a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') || '|'
           || coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS p
    FROM tops a JOIN tops b ON a.lv = b.lv AND a.i // 16 = b.i // 16 WHERE a.s > 16 ** a.lv GROUP BY ALL),
way AS (
    SELECT l.grp, l.r, 0 AS tier, s.lv, s.p FROM leaves l JOIN steps s ON s.grp = l.grp AND s.i = l.r // (16 ** s.lv)::BIGINT
    UNION ALL
    SELECT l.grp, l.r, 1, t.lv, t.p FROM leaves l JOIN subroots u ON u.grp = l.grp
    JOIN top_steps t ON t.i = u.r // (16 ** t.lv)::BIGINT),
paths AS (SELECT grp, r, list(p ORDER BY tier, lv) AS ps FROM way GROUP BY ALL),
folded AS (
    SELECT l.doc_id, l.leaf, u.h AS subroot, root, sha256(coalesce(array_to_string(list_transform(ps,
               lambda p: replace(p, '|', '')), ''), '')) AS proof_sha256,
           list_reduce(list_prepend(l.start, coalesce(ps, [])), lambda acc, p:
               sha256(split_part(p, '|', 1) || acc || split_part(p, '|', 2))) AS folded_root
    FROM leaves l JOIN subroots u ON u.grp = l.grp LEFT JOIN paths q ON q.grp = l.grp AND q.r = l.r, root)
SELECT *, folded_root = root AS verified FROM folded
"""
