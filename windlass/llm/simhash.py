"""SimHash near-duplicates by pigeonring filtering.

Two 64-bit fingerprints with at most ``max_bits`` differing bits are cut
into m = max_bits + 1 segments laid on a ring.  By the pigeonring principle
(Qin and Xiao, "Pigeonring", VLDB 2018) some segment i starts a chain whose
every prefix of l segments differs in at most l * max_bits / m bits: none
in the first segment, at most one in the first two, and so on.  The index
uses chains of two segments: a fingerprint is filed under (i, p) with bit p
of segment i + 1 masked out, so partners meet on about 25 equal bits.  In a
bucket the longer prefixes prune pairs before the full Hamming check.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import WORD, batches_of, materialise, with_workers
from .components import components

BITS = 64
#: Rows of one bucket that a task compares at once; larger buckets are cut
#: into blocks and every two blocks meet in a task of their own.
BLOCK = 16384
#: Places in which a component's members meet its id.
SALTS = 32

_WORDS = re.compile(WORD.encode())
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PLACES = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_LANE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash: a bit is 1 if set in over half of the shingles'
    XXH64 (seed 42).  Null, empty and blank texts give 0."""
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []
    if not words:
        return 0
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], 42) for a, b in
                     zip(starts[:n].tolist(), ends[shingle - 1:].tolist())), np.uint64, n)
    bytes_ = h.view(np.uint8).reshape(n, 8) + _LANE
    per_byte = np.bincount(bytes_.ravel(), minlength=2048).reshape(8, 256)
    ones = (per_byte @ _PLACES).ravel()          # bit k of byte j is bit 8 j + k
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    @pandas_udf("long")
    def f(text: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, shingle) for t in text), np.uint64,
                                     len(text)).view(np.int64))
    return f


def chains(max_bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Index patterns: (mask of the bits that must agree, [(mask of a longer
    chain, bits it may differ in), ...]).  Together they cover every pair
    within ``max_bits``."""
    m = max_bits + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    seg = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(m)]
    out = []
    for i in range(m):
        ring = [seg[(i + j) % m] for j in range(m)]
        longer = [(sum(ring[:n]), n * max_bits // m) for n in range(3, m)]
        if m == 1:
            out.append((seg[0], []))
            continue
        second = (i + 1) % m
        out += [(ring[0] | ring[1] & ~(1 << b), longer) for b in range(cuts[second], cuts[second + 1])]
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _bucket_links(fps: np.ndarray, rules, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star edges (member, smallest member) of the components that the links
    within one bucket make.  Breadth first; a row is compared only with rows
    not yet reached, so a dense bucket costs little more than its size."""
    left, out = np.sort(fps), []
    while len(left) > 1:
        seed, left, todo, found = left[0], left[1:], [left[0]], []
        while todo and len(left):
            x = np.bitwise_xor(left, todo.pop())
            near = np.ones(len(left), bool)
            for mask, most in rules:
                near &= np.bitwise_count(x & mask) <= most
            near &= np.bitwise_count(x) <= max_bits
            if near.any():
                new = left[near]
                todo.extend(new)
                found.append(new)
                left = left[~near]
        if found:
            got = np.concatenate(found)
            out.append((got, np.full(len(got), seed)))
    return out


def _link_batches(max_bits: int):
    rules = [[(np.uint64(mask), most) for mask, most in longer] for _, longer in chains(max_bits)]

    def whole_runs(frames):
        """Frames cut only between buckets (rows come sorted by bucket)."""
        held: list = []
        for pdf in frames:
            if not len(pdf):
                continue
            keys = pdf[["k", "v", "unit"]].to_numpy()
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 \
                if (keys[0] != keys[-1]).any() else 0
            if held and (last or (held[-1][["k", "v", "unit"]].to_numpy()[-1] != keys[0]).any()):
                yield pd.concat([*held, pdf[:last]])
                held = []
            elif last:
                yield pdf[:last]
            held.append(pdf[last:])
        if held:
            yield pd.concat(held)

    def f(frames):
        for pdf in whole_runs(frames):
            if len(pdf) < 2:
                continue
            k, v, unit = (pdf[c].to_numpy() for c in ("k", "v", "unit"))
            fps = pdf["fp"].to_numpy().view(np.uint64)
            cut = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1]) | (unit[1:] != unit[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(k)]))
            size, parts = ends - starts, []
            # Buckets of two, all at once.
            at = starts[size == 2]
            a, b = np.minimum(fps[at], fps[at + 1]), np.maximum(fps[at], fps[at + 1])
            x, ok = a ^ b, np.ones(len(at), bool)
            for j, longer in enumerate(rules):
                mine = k[at] == j
                for mask, most in longer:
                    ok &= ~mine | (np.bitwise_count(x & mask) <= most)
            ok &= np.bitwise_count(x) <= max_bits
            parts.append((b[ok], a[ok]))
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                parts += _bucket_links(fps[s:e], rules[k[s]], max_bits)
            got = np.unique(np.stack([np.concatenate([p[0] for p in parts]),
                                      np.concatenate([p[1] for p in parts])], axis=1), axis=0)
            if len(got):
                yield pd.DataFrame({"a": got[:, 0].copy().view(np.int64),
                                    "b": got[:, 1].copy().view(np.int64)})
    return f


def links(fps: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct
    fingerprints (column fp, no repeats) with at most ``max_bits`` differing
    bits.  A bucket gives at most a spanning set of its links, never all
    pairs."""
    patterns = chains(max_bits)
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    # Few bytes come in and 64 times as many rows go out: spread them first.
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (fps.select("fp").repartition(width, "fp").select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(_signed(mask))) for mask, _ in patterns])).alias("k", "v")))
    # Only buckets within a crowded first segment can be crowded: the counts
    # of first segments are (max_bits + 1) * 2^13 rows or so at any size.
    m = max_bits + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    seg = [_signed(sum(1 << b for b in range(cuts[i], cuts[i + 1]))) for i in range(m)]
    crowded = (fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(s)) for s in seg]))
                          .alias("i", "s")).groupBy("i", "s").count().where(F.col("count") > block))
    if crowded.isEmpty():
        units = rows.withColumn("unit", F.lit(0))
    else:
        big = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        big = big.select("k", "v", F.ceil(F.col("n") / (block // 2)).cast("int").alias("g"))
        b = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        other = F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0)))
                          .otherwise(F.sequence(F.lit(0), F.col("g") - 1))).alias("o")
        units = (rows.join(big, ["k", "v"], "left")
                 .select("fp", "k", "v", F.coalesce(b, F.lit(0)).alias("b"),
                         F.coalesce("g", F.lit(1)).alias("g"), other)
                 .select("fp", "k", "v",
                         (F.least("b", "o") * F.col("g") + F.greatest("b", "o")).alias("unit")))
    return (units.select("k", "v", F.col("unit").cast("int").alias("unit"), "fp")
            .repartition("k", "v", "unit").sortWithinPartitions("k", "v", "unit")
            .mapInPandas(_link_batches(max_bits), "a long, b long").distinct())


def _with_fingerprint(docs: DataFrame, text: str, shingle: int, out: str) -> DataFrame:
    with_workers(docs.sparkSession)
    return docs.withColumn(out, _fingerprints(shingle)(F.col(text)))


def _roots(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, linked: has it any link?) for every distinct fingerprint of
    ``fps``."""
    nodes = materialise(fps.select("fp").distinct(), "simhash-nodes")
    with batches_of(fps.sparkSession, 50_000):
        found = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"),
                                                  F.col("root").isNotNull().alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id
    (smallest id of the component).

    Null, empty and blank texts have fingerprint 0 and link like any other;
    repeated rows stay repeated; a null id keeps its row and never is a
    component_id unless its component has no other id; no rows give none;
    other columns are ignored."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fps = materialise(_with_fingerprint(d, "text", shingle, "fp").select("id", "fp"), "simhash")
    roots = materialise(_roots(fps, max_bits), "simhash-roots")
    low = materialise(fps.groupBy("fp").agg(F.min("id").alias("low")).join(roots, "fp"), "simhash-lowest")
    # A fingerprint without links is its own component.  A root may own a third
    # of the others: they are aggregated map-side and meet their component's id
    # in SALTS places.
    linked = low.where("linked").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    by_root = (linked.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("component_id"))
               .withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    member = (linked.join(by_root, (F.col("root") == F.col("of")) & (F.col("salt") == F.col("at")))
              .select("fp", "component_id")
              .unionByName(low.where("not linked").select("fp", F.col("low").alias("component_id"))))
    return fps.join(member, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id
    (nulls last; of repeated rows one).  All columns stay as they are."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, key = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    work = materialise(_with_fingerprint(safe, text, shingle, "fp")
                       .withColumn("row", F.monotonically_increasing_id()), "simhash-docs")
    roots = _roots(work, max_bits)
    kept = (work.groupBy("fp").agg(F.min(F.struct(F.col(key).isNull().alias("n"),
                                                  F.col(key).alias("key"), "row")).alias("w"))
            .join(roots, "fp").groupBy("root").agg(F.min("w").alias("w")).select("w.row"))
    return (work.join(kept, "row", "left_semi")
            .select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]))
