"""Vector code compression: product codes with integer codebooks.

A vector's components become integers and are cut into four parts, each coded
by the index of its nearest codebook entry.  Entries start as the first
vectors' parts and move to the floor of their parts' mean in a few rounds.
Nearest entries come from a tree over the entries (``gnat``).  Tasks add up
their own rows per entry before anything is shuffled, so a hot entry costs no
more than any other; the driver sees the codebooks only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialise, with_workers
from .gnat import Gnat

UNIT, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a batch of vectors; copies of a label's total for its rows to meet.
BATCH, SALTS = 4096, 32
_DDL = "vec_id long, label long, code string, error long"


@dataclass
class Codebooks:
    entries: list[np.ndarray]            # of each part: entries x width, int64
    cuts: list[int]                      # where the parts of a vector begin and end

    @staticmethod
    def first(vectors: list[list[int]], width: int) -> Codebooks:
        v = np.array(vectors, np.int64).reshape(len(vectors), width)
        cuts = [k * width // PARTS for k in range(PARTS + 1)]
        return Codebooks([v[:, a:b] for a, b in zip(cuts, cuts[1:])], cuts)

    def assign(self, trees: list[Gnat], v: np.ndarray):
        """(entry, squared distance) of every row, for each part."""
        return [t.nearest(v[:, a:b]) for t, a, b in zip(trees, self.cuts, self.cuts[1:])]

    def trees(self) -> list[Gnat]:
        return [Gnat(e) for e in self.entries]

    def sha256(self) -> str:
        """Of all components, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def integer_vector(c: Column) -> Column:
    return F.transform(c, lambda x: F.floor(x.cast("double") * F.lit(UNIT)).cast("long"))


def kept(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is whole: not null, no null
    or non-finite component, as long as that of the smallest kept id."""
    c = F.col(vec_col)
    finite = F.coalesce(F.forall(c, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))),
                        F.lit(False))
    d = materialise(embeddings.where(finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        integer_vector(c).alias("v")), "codes-vectors")
    head = _in_order(d).select(F.size("v").alias("n")).first()
    return d.where(F.size("v") == head.n) if head else d


def _in_order(vectors: DataFrame) -> DataFrame:
    return vectors.orderBy(F.asc_nulls_last("vec_id"), "v")


def _matrix(column, width: int) -> np.ndarray:
    return column.values.slice(column.offset * width, len(column) * width).to_numpy(
        zero_copy_only=False).reshape(len(column), width) if width else np.zeros((len(column), 0), np.int64)


def _sums(books, width):
    """Per task: (part, entry, count, sum of each component) of its rows."""
    def f(batches):
        cb = books.value
        trees = cb.trees()
        count = [np.zeros(len(e), np.int64) for e in cb.entries]
        total = [np.zeros(e.shape, np.int64) for e in cb.entries]
        for b in batches:
            v = _matrix(b.column(0), width)
            for p, (who, _) in enumerate(cb.assign(trees, v)):
                count[p] += np.bincount(who, minlength=len(count[p]))
                np.add.at(total[p], who, v[:, cb.cuts[p]:cb.cuts[p + 1]])
        rows = [(p, int(e), int(count[p][e]), k, int(x)) for p in range(PARTS) for e in np.flatnonzero(count[p])
                for k, x in enumerate(total[p][e].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)],
                                         ["part", "entry", "n", "at", "s"])
    return f


def _coded(books, width):
    def f(batches):
        cb = books.value
        trees = cb.trees()
        for b in batches:
            found = cb.assign(trees, _matrix(b.column(2), width))
            codes = np.stack([who for who, _ in found], 1).astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([codes[2 * PARTS * i:2 * PARTS * (i + 1)] for i in range(b.num_rows)], pa.string()),
                 pa.array(sum(d for _, d in found), pa.int64())], ["vec_id", "label", "code", "error"])
    return f


def train(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks:
    """Codebooks of the vectors (vec_id, label, v) of :func:`kept`.  They begin
    as the ``entries`` (256 at most) smallest ids' parts; null ids come last,
    equal ids by vector.  An entry without parts stays."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = with_workers(vectors.sparkSession)
    head = _in_order(vectors).limit(entries).collect()       # at most 256 rows
    width = len(head[0].v) if head else 0
    most = vectors.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] or 0
    if 4 * most * most * max(width, 1) >= 1 << 63:
        raise ValueError(f"components up to {most}: squared distances do not fit into 64 bits")
    cb = Codebooks.first([r.v for r in head], width)
    for _ in range(rounds if width else 0):
        books = spark.sparkContext.broadcast(cb)                   # 256 vectors
        with batches_of(spark, BATCH):
            got = (vectors.select("v").mapInArrow(_sums(books, width), "part long, entry long, n long, at long, s long")
                   .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
        moved = [e.copy() for e in cb.entries]
        for r in got:                                              # one row per component of a codebook
            moved[r.part][r.entry, r.at] = r.s // r.n
        cb = Codebooks(moved, cb.cuts)
    return cb


def encode(vectors: DataFrame, cb: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error (squared
    distance to the entries) of every row; written once."""
    spark, width = with_workers(vectors.sparkSession), cb.cuts[-1]
    books = spark.sparkContext.broadcast(cb)
    with batches_of(spark, BATCH):
        return materialise(vectors.select("vec_id", "label", "v").mapInArrow(_coded(books, width), _DDL), "codes")


def decode(codes: DataFrame, cb: Codebooks) -> DataFrame:
    """``codes`` with the vector each code stands for, in the given unit."""
    col = F.lit(None)
    parts = []
    for p, e in enumerate(cb.entries):
        book = F.array(*[F.array(*[F.lit(float(x) / UNIT) for x in row]) for row in e.tolist()])
        parts.append(F.element_at(book, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1))
    return codes.withColumn("decoded", F.concat(*parts) if parts else col)


def compress(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (error summed over the rows of the
    label, nulls together) and codebooks_sha256 of every kept row.

    Rows with a null vector, or null or non-finite components, are dropped, and
    vectors of another length than that of the smallest kept id.  Repeated rows
    count and stay; a null id stays null; fewer than 256 rows make fewer
    entries; no rows give none; other columns are ignored.  Components too
    large for 64-bit distances (beyond about 10^5) are an error."""
    vectors = kept(embeddings, id_col, vec_col, label_col)
    cb = train(vectors, rounds)
    codes = encode(vectors, cb).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    # A hot label's rows meet its total in SALTS places.
    totals = (codes.groupBy("label", "salt").agg(F.sum("error").alias("e")).groupBy(F.col("label").alias("of"))
              .agg(F.sum("e").alias("label_error")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at"))).select(
        "vec_id", "code", "error", "label_error", F.lit(cb.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The SQL of :func:`compress`, its rounds written out."""
    near = """near{r} AS (
    SELECT id, part, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d
    FROM (SELECT id, p.part, entry, CAST(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c)
          AS HUGEINT) AS d FROM parts p JOIN book{r} b ON p.part = b.part) GROUP BY id, part)"""
    move = """book{n} AS (
    SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
        SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS c FROM (
            SELECT part, entry, pos, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM (
                SELECT e.part, e.entry, unnest(x) AS v, unnest(range(len(x))) AS pos
                FROM near{r} e JOIN parts p ON e.id = p.id AND e.part = p.part) GROUP BY ALL) GROUP BY part, entry) m
    ON b.part = m.part AND b.entry = m.entry)"""
    steps = [near.format(r=0)]
    for r in range(ROUNDS):
        steps += [move.format(r=r, n=r + 1), near.format(r=r + 1)]
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label,
           list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT id, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x
          FROM kept, (SELECT unnest(range(4)) AS part)),
book0 AS (SELECT part, id AS entry, x AS c FROM parts WHERE id < 256),
{(',' + chr(10)).join(steps)},
codes AS (SELECT id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM near{ROUNDS} GROUP BY id),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ','
                  ORDER BY part, entry)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN codes USING (id), digest
"""


ORACLE = _oracle()
