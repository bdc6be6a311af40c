"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range
(one in SCALE), so it grows with its document, and the share of one sketch
found in another estimates containment even between very unequal texts.  The
sketch of two texts together is the union of theirs.  A text none of whose
hashes are that low keeps its lowest one, so only texts without words have an
empty sketch.

Neighbours in id order are compared after one move of the texts: bounds taken
from the ids (a number of them set by the shuffle partitions, sent to every
task) cut the order into chunks, and the first row of a chunk also goes to the
chunk before it, whose last row it follows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import with_workers

#: One hash in SCALE is kept; words in a shingle; chunks for each shuffle
#: partition, and the fewest rows (on average) that a chunk is cut for.
SCALE, SHINGLE, CHUNKS, CHUNK_ROWS = 8, 5, 16, 32
BITS = 48                                   # of a kept hash: eight base64 digits
_MASK = (1 << 64) - 1
_FACTORS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)]
Sketch = np.ndarray                         # ascending, distinct, uint64


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """A BITS-bit hash of every shingle of ``size`` words (A-Z in lower case,
    words as in ``common.WORD``); fewer words make one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    x = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        x += h[j:len(h) - k + 1 + j] * np.uint64(_FACTORS[j])
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - BITS)


def _limit(scale: int) -> np.uint64:
    return np.uint64((1 << BITS) // scale)


def sketch(text: str | None, scale: int = SCALE, size: int = SHINGLE) -> Sketch:
    h = shingle_hashes(text, size)
    low = h[h < _limit(scale)]
    return np.unique(low) if len(low) else h[:0] if not len(h) else h.min(keepdims=True)


def merge(a: Sketch, b: Sketch, scale: int = SCALE) -> Sketch:
    """The sketch of all shingles of both."""
    both = np.union1d(a, b)
    low = both[both < _limit(scale)]
    return low if len(low) else both[:1]


def common(a: Sketch, b: Sketch) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of either that both hold; two texts
    without words are alike."""
    n = common(a, b)
    return n / (len(a) + len(b) - n) if len(a) or len(b) else 1.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b holds; 1 if a has none."""
    return common(a, b) / len(a) if len(a) else 1.0


def dump(s: Sketch) -> str:
    """URL-safe base64, eight digits for a hash, ascending."""
    raw = s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8:]
    return base64.urlsafe_b64encode(raw.tobytes()).decode()


def load(text: str) -> Sketch:
    raw = np.frombuffer(base64.urlsafe_b64decode(text), np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - BITS // 8:] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def _sketched(scale, size):
    def f(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t or "") for t in texts], pa.int64()),
                 pa.array([dump(sketch(t, scale, size)) for t in texts], pa.string())],
                ["doc_id", "n_chars", "fingerprint"])
    return f


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE,
                 size: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row, in one pass.  A null text is
    an empty one; repeated rows stay; no rows give none; other columns are
    ignored."""
    with_workers(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_sketched(scale, size), "doc_id long, n_chars long, fingerprint string"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                  ("near_next", pa.float64()), ("kept_edited", pa.float64()), ("kept_next", pa.float64())])
_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, kept_edited double, kept_next double")


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of ``after``'s start."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _compared(scale, size):
    def f(batches):
        held = None
        for b in batches:
            out = []
            for chunk, peek, i, text in zip(*(b.column(n).to_pylist() for n in ("chunk", "peek", "doc_id", "text"))):
                text = text or ""
                s = sketch(text, scale, size)
                if held is not None and held[0] == chunk:
                    _, j, t, a = held
                    changed = edited(t, text)
                    e = sketch(changed, scale, size)
                    out.append((j, len(t), hashlib.sha256(changed.encode()).hexdigest(), dump(a), dump(e),
                                likeness(a, e), likeness(a, s), containment(a, e), containment(a, s)))
                held = None if peek else (chunk, i, text, s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t.type) for k, t in enumerate(_OUT)], schema=_OUT)
    return f


def _bounds(ids: DataFrame, chunks: int) -> list[int]:
    """Distinct values of ``nid`` that begin the chunks, ascending, at most
    ``chunks`` of them: quantiles, and the smallest value."""
    rows, least = ids.agg(F.count(F.lit(1)), F.min("nid")).first()
    chunks = max(1, min(chunks, rows // CHUNK_ROWS))
    if not rows or chunks == 1:
        return [least] if rows else []
    at = [k / chunks for k in range(1, chunks)]
    cut = ids.agg(F.percentile_approx("nid", at, max(10_000, 4 * chunks))).first()[0]
    return sorted({least, *cut})


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE,
                       size: int = SHINGLE, chunks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text
    (:func:`edited`, with the next row by descending id; the first follows the
    last), and how near it is to that text and to the next row: near_* is
    :func:`likeness`, kept_* is :func:`containment` of the row in the other.

    A null text is an empty one; rows of equal ids follow each other by a hash
    of their text, null ids come last; a lone row is its own next; no rows give
    none; other columns are ignored.  Rows of one id lie in one chunk."""
    spark = with_workers(docs.sparkSession)
    # ~x falls as x rises, without overflow.
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "nid", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)))
    chunks = chunks or CHUNKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(d.select("nid"), chunks)
    if not bounds:
        return spark.createDataFrame([], _DDL)
    n, known = len(bounds), spark.sparkContext.broadcast(np.array(bounds, np.int64))

    @pandas_udf("long")
    def place(nid: pd.Series) -> pd.Series:
        """Twice the chunk, and one more for a row that begins it."""
        at = np.searchsorted(known.value, nid.to_numpy(), "right") - 1
        return pd.Series(2 * at + (known.value[at] == nid.to_numpy()))
    d = d.withColumn("at", place("nid"))
    here = F.struct(F.shiftright("at", 1).alias("chunk"), F.lit(False).alias("peek"))
    before = F.struct(F.pmod(F.shiftright("at", 1) - 1, F.lit(n)).alias("chunk"), F.lit(True).alias("peek"))
    begins = F.col("at") % 2 == 1
    d = d.select("doc_id", "text", "nid", F.explode(F.when(begins, F.array(here, before)).otherwise(F.array(here))).alias("to"))
    d = d.select("to.*", "doc_id", "nid", F.col("doc_id").isNull().alias("unnamed"),
                 F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    d = d.repartition("chunk").sortWithinPartitions("chunk", "peek", "nid", "unnamed", "h")
    return d.select("chunk", "peek", "doc_id", "text").mapInArrow(_compared(scale, size), _DDL)
