"""Threshold-scaled sketches: definition, merging, estimates, neighbours."""

import hashlib
import random

import numpy as np
import pytest

from windlass.llm import fingerprints as fp

SCHEMA = "text string, doc_id long, chunk int, peek string, fingerprint string"


def text(seed, n):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(t, scale):
    """Every shingle on its own: its hash, then the rule."""
    h = {int(fp.shingle_hashes(s)[0]) for s in shingles(t)}
    low = {x for x in h if x < (1 << 48) // scale}
    return sorted(low or sorted(h)[:1])


@pytest.mark.parametrize("t", ["", " \n", "one", "a b c d", "A b c d E", "a b c d e f", text(1, 400), "x y " * 300,
                               text(2, 20_000)])
def test_sketch_is_the_rule(t):
    s = fp.sketch(t)
    assert s.tolist() == brute(t, fp.SCALE)
    assert np.array_equal(fp.load(fp.dump(s)), s)
    assert fp.dump(fp.sketch(t.upper())) == fp.dump(s)


def test_hashes_differ_by_order_and_share():
    assert fp.shingle_hashes("a b c d e")[0] != fp.shingle_hashes("b a c d e")[0]
    h = fp.shingle_hashes(text(3, 40_000))
    assert abs((h < (1 << 48) // 8).mean() - 1 / 8) < 0.01


def test_merge_is_the_sketch_of_all_shingles():
    a, b = "p q r s t", text(5, 90)
    union = {int(x) for t in (a, b) for x in fp.shingle_hashes(t)}
    low = sorted(x for x in union if x < (1 << 48) // fp.SCALE)
    for x, y in ((a, b), (b, a)):
        assert fp.merge(fp.sketch(x), fp.sketch(y)).tolist() == (low or [min(union)])
    assert fp.merge(fp.sketch(""), fp.sketch("")).tolist() == []


def test_estimates():
    long = text(7, 12_000)
    w = long.split()
    part, other = " ".join(w[3000:4200]), text(8, 3000)
    a, b, c = map(fp.sketch, (long, part, other))
    assert fp.containment(b, a) > 0.99 and 0.05 < fp.containment(a, b) < 0.16       # very unequal
    assert fp.likeness(a, c) < 0.01
    for t in (" ".join(w[:8000]), long + " " + other):
        true = len(shingles(t) & shingles(long)) / len(shingles(t) | shingles(long))
        assert abs(fp.likeness(a, fp.sketch(t)) - true) < 0.05


def neighbours(rows):
    """Rows in order, each with the next one's text."""
    return [(i, t or "", (rows[(k + 1) % len(rows)][1] or "")) for k, (i, t) in enumerate(rows)]


def check(spark, rows, got):
    want = []
    for i, t, after in neighbours(rows):
        half = len(t) // 2
        changed = t[:len(t) - half] + after[:half]
        a, e, s = (set(brute(x, fp.SCALE)) for x in (t, changed, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        share = lambda x, y: len(x & y) / len(x) if x else 1.0
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fp.dump(fp.sketch(t)),
                     fp.dump(fp.sketch(changed)), like(a, e), like(a, s), share(a, e), share(a, s)))
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("chunks", [1, 7])
def test_neighbours(spark, monkeypatch, chunks):
    monkeypatch.setattr(fp, "CHUNK_ROWS", 2)
    rows = [(i, text(i, 3 + i * 5 % 200)) for i in range(60, 0, -1)]
    rows += [(0, "üñ€ 🙂🙂 é" * 9), (-5, ""), (-6, None), (-(1 << 63), "last one of all"), (None, "no id at all")]
    rows[10] = (rows[10][0], rows[11][1])                                            # copies
    df = spark.createDataFrame([(t, i, 9, "p", "f") for i, t in rows], SCHEMA).repartition(3)
    check(spark, rows, map(tuple, fp.compare_neighbours(df, chunks=chunks).collect()))


def test_repeated_rows_and_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "CHUNK_ROWS", 1)
    rows = [(3, "c c c")] + [(2, "b b b b b b b")] * 5 + [(1, "a")]
    df = spark.createDataFrame([(t, i, 9, "p", "f") for i, t in rows], SCHEMA)
    check(spark, rows, map(tuple, fp.compare_neighbours(df, chunks=20).collect()))
    lone = spark.createDataFrame([("one two three", 1, 9, "p", "f")], SCHEMA)
    got = fp.compare_neighbours(lone).first()
    assert got.near_next == 1.0 and got.fingerprint == fp.dump(fp.sketch("one two three"))
    assert fp.compare_neighbours(lone.limit(0)).count() == 0


def test_plain_fingerprints(spark):
    df = spark.createDataFrame([("a b", 1, 0, "", ""), (None, None, 0, "", "")], SCHEMA)
    got = {tuple(r) for r in fp.fingerprints(df).collect()}
    assert got == {(1, 3, fp.dump(fp.sketch("a b"))), (None, 0, "")}
