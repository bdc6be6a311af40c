"""Product codes: the tree is exact, the rounds match brute force and SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from windlass.llm import vector_codes as vc
from windlass.llm.catalog import QUERIES
from windlass.llm.gnat import Gnat, squared

SCHEMA = "vec_id long, embedding array<float>, label int, code string, salt int"


@pytest.mark.parametrize("spread", [2, 40, 1000, 1 << 27])
@pytest.mark.parametrize("width", [1, 3, 16])
def test_tree_is_exact_with_ties(spread, width):
    rnd = np.random.default_rng(spread + width)
    p = rnd.integers(-spread, spread + 1, (256, width))
    p[100:120] = p[3]                                      # equal points: the first wins
    q = np.concatenate([rnd.integers(-spread, spread + 1, (600, width)), p, (p[:-1] + p[1:]) // 2])
    who, best = Gnat(p).nearest(q)
    d = np.array([[int(((a - b) ** 2).sum()) for b in p] for a in q])
    assert np.array_equal(who, d.argmin(1)) and np.array_equal(best, d.min(1))


def test_tree_leaves_out_subtrees():
    rnd = np.random.default_rng(1)
    p = (rnd.integers(0, 16, (256, 1)) * 5000 + rnd.integers(0, 300, (256, 16))).astype(np.int64)
    t = Gnat(p)
    q = p[rnd.integers(0, 256, 2000)] + rnd.integers(-20, 20, (2000, 16))
    t.nearest(q)
    assert t.compared < 0.4 * 2000 * 256


def test_small_trees():
    assert Gnat(np.zeros((300, 4), np.int64)).nearest(np.ones((2, 4), np.int64))[0].tolist() == [0, 0]
    assert Gnat(np.array([[5]])).nearest(np.array([[9], [5]]))[1].tolist() == [16, 0]
    assert squared(np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64)).tolist() == [[0, 0]] * 3


def brute(rows, rounds=4):
    ok = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v], lab) for i, v, lab in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(ok[0][1])
    ok = [r for r in ok if len(r[1]) == w]
    cut = [k * w // 4 for k in range(5)]
    books = [[r[1][a:b] for r in ok[:256]] for a, b in zip(cut, cut[1:])]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for step in range(rounds + 1):
        got = [[near(r[1][a:b], book) for book, a, b in zip(books, cut, cut[1:])] for r in ok]
        if step == rounds:
            break
        for p in range(4):
            for k in range(len(books[p])):
                mine = [r[1][cut[p]:cut[p + 1]] for r, g in zip(ok, got) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    err = [sum(d for d, _ in g) for g in got]
    total = {}
    for r, e in zip(ok, err):
        total[r[2]] = total.get(r[2], 0) + e
    return [(r[0], "".join(f"{k:02x}" for _, k in g), e, total[r[2]], h) for r, g, e in zip(ok, got, err)]


def test_compress(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(8)], rnd.choice([0, 1, None])) for i in range(400)]
    rows += [(500 + i, rows[7][1], 1) for i in range(200)] + [rows[7], rows[7]]      # copies, repeated rows
    rows += [(None, rows[9][1], 0), (900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [0.1] * 7 + [float("nan")], 1),
             (903, [float("-inf")] + [0.0] * 7, 1), (904, [0.5] * 12, 1), (905, [], 1)]
    df = spark.createDataFrame([(*r, "c", 7) for r in rows], SCHEMA).repartition(5)
    assert sorted(map(str, map(tuple, vc.compress(df).collect()))) == sorted(map(str, brute(rows)))


def test_few_rows_and_none(spark):
    rows = [(2, [0.5, -0.5, 1.0, 2.0, 0.1], 1), (1, [0.0, 0.25, -1.0, 0.0, 0.2], 1)]   # parts of 1, 1, 1, 2
    df = spark.createDataFrame([(*r, "c", 7) for r in rows], SCHEMA)
    assert sorted(map(tuple, vc.compress(df).collect())) == sorted(brute(rows))
    assert vc.compress(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        vc.compress(spark.createDataFrame([(1, [1e30] * 4, 1, "c", 7)], SCHEMA))


def test_codes_stand_for_the_vectors(spark):
    v = vc.kept(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    cb = vc.train(v, rounds=1)
    for r in vc.decode(vc.encode(v, cb), cb).join(v, "vec_id").limit(50).collect():
        assert sum((round(a * 1024) - b) ** 2 for a, b in zip(r.decoded, r.v)) == r.error


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
    got = QUERIES["op11_vectorcodes"](spark, sf)
    want = con.sql(vc.ORACLE)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
