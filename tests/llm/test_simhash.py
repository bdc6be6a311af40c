"""SimHash operator against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from windlass.llm import simhash


def plain_fingerprint(text, k=4):
    out, word = [], ""
    for ch in text or "":
        if ch in " \t\n\v\f\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    words = out + [word] * bool(word)
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    a = np.array(sorted(fps), np.uint64)
    for i, x in enumerate(a):
        for y in a[i + 1:][np.bitwise_count(a[i + 1:] ^ x) <= bits]:
            p, q = find(int(x)), find(int(y))
            root[max(p, q)] = min(p, q)
    return {f: find(f) for f in fps}


def test_fingerprint_equals_plain_form():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 40):
        t = " \n".join(rng.choice(["Ünï", "THE", "a b", "x"]) for _ in range(n))
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0


@pytest.mark.parametrize("bits", [1, 3, 4])
def test_patterns_cover_every_pair(bits):
    rng, patterns = random.Random(bits), simhash.chains(bits)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits)))
        assert any(not x & mask and all((x & m).bit_count() <= most for m, most in longer)
                   for mask, longer in patterns)


@pytest.mark.parametrize("block", [16384, 8])
def test_links_equal_brute_force(spark, block):
    """Chains of close fingerprints, a dense ball, and noise; small blocks
    force the split of crowded buckets."""
    from windlass.llm.components import components
    rng, fps = random.Random(7), set()
    for _ in range(5):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(20)}
    fps |= {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {int(np.int64(r.node).view(np.uint64)): r.root
           for r in components(simhash.links(df, 4, block)).collect()}
    want = brute_roots(fps, 4)
    for f in fps:
        same = {g for g in fps if want[g] == want[f]}
        if len(same) == 1:
            assert f not in got
        else:
            assert {g for g in got if got[g] == got[f]} == same


def test_documents_of_the_table(spark):
    from llm_helpers import SF
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in d.collect()}
    fp = {i: plain_fingerprint(t) for i, t in rows.items()}
    roots = brute_roots(set(fp.values()), 4)
    low = {}
    for i in sorted(rows):
        low.setdefault(roots[fp[i]], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert got == {i: (f"{fp[i]:016x}", low[roots[fp[i]]]) for i in rows}
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(low.values())


def test_nulls_ties_and_clashing_names(spark):
    rows = [(3, None, "p", 1), (2, "", None, 2), (2, "", None, 2), (None, " ", "q", 3),
            (7, "one two three four five", "r", 4), (None, "other words stand in here now", None, 5),
            (9, "w " * 200_000, "s", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp string, row int")
    got = sorted(((r.doc_id, r.component_id, r.fingerprint[:1] == "0") for r in
                  simhash.near_duplicates(d).collect()), key=str)
    assert len(got) == 7
    assert {g[:2] for g in got} >= {(3, 2), (2, 2), (None, 2), (7, 7), (None, None), (9, 9)}
    kept = simhash.keep_one(d)
    assert kept.columns == ["doc_id", "text", "fp", "row"]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "7", "9", "None"]
    none = d.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
