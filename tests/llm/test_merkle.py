"""Merkle manifest: leaves, subtrees, proofs and tampering, by brute force."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from windlass.llm import merkle
from windlass.llm.catalog import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def low(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tree(hs):
    """(root, [path of each leaf]): path = [(left, right), ...]."""
    paths, cur, at = [[] for _ in hs], list(hs), list(range(len(hs)))
    while len(cur) > 1:
        for k in range(len(hs)):
            i = at[k]
            run = range(i // 16 * 16, min(i // 16 * 16 + 16, len(cur)))
            paths[k].append(("".join(cur[j] for j in run if j < i), "".join(cur[j] for j in run if j > i)))
            at[k] = i // 16
        cur = [sha("".join(cur[i:i + 16])) for i in range(0, len(cur), 16)]
    return cur[0], paths


def brute(rows):
    leaf = lambda i, t, lang, s, n: sha("".join(map(enc, (i, s, lang, n, t))))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0], leaf(*r[:5]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[s] = tree([h for _, h, _ in by[s]])
    root, top = tree([subs[s][0] for s in names])
    out = []
    for s, up in zip(names, top):
        for (i, h, r), path in zip(by[s], subs[s][1]):
            path = path + up
            acc = leaf(i, low(r[1]), *r[2:5]) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else h
            for a, b in path:
                acc = sha(a + acc + b)
            out.append((i, h, subs[s][0], root, sha("".join(a + b for a, b in path)), acc, acc == root))
    return out


def check(spark, rows):
    got = merkle.audit(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_brute_force(spark):
    rows = [(i, f"Text {i} ÄB", "en", f"s{i % 3}", i) for i in range(280)]
    rows += [(1000 + i, f"T{i}", None, None, None) for i in range(17)]                 # a run of one
    rows += [(2000 + i, f"lone {i}", "de", f"Z{i}", 1) for i in range(15)]             # 19 sources: two levels above
    rows += [(5, None, "en", "s0", None), (5, "", "en", "s0", 0), (5, "", "en", "s0", 0), (None, "n", "en", "s1", 1),
             (3000, "L" * 50_000, "en", "", 50_000)]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 16, 257])
def test_one_source(spark, n):
    check(spark, [(i, f"T{i}", "en", "s", 1) for i in range(n)])


def test_empty(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_path_proves_a_leaf(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", 1) for i in range(40)]
    m = merkle.manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert all(r.fold == r.root for r in m.select("root", merkle.fold(m.leaf, m.path).alias("fold")).collect())
    assert m.select("root").distinct().count() == 1


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    got = QUERIES["op13_merkle"](spark, sf)
    want = con.sql(merkle.ORACLE)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
