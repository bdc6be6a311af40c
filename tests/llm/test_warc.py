"""WARC archive: exact round trip, types, damage."""

import base64
import hashlib

import pytest

from windlass.llm import warc
from windlass.session import shared_dir

PAGES = [(3, "http://a/", "same"), (1, "http://b/\r\nX: y", "same"), (2, None, None), (7, "http://c/", ""),
         (9, "http://d/", "ünï" * 50_000), (None, "http://e/", "same"), (5, "u", "one"), (5, "u", "one"), (None, "n", "lone")]


def archive(spark, rows=PAGES, **kw):
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int")
    path = shared_dir(spark, "test-warc")
    warc.write_archive(pages, path, **kw)
    return path


def test_round_trip(spark):
    path = archive(spark)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(PAGES)
    for r in got:
        head, n = bytes(r.header).decode(), len(r.payload)
        assert bytes(r.record) == bytes(r.header) + bytes(r.payload) + b"\r\n\r\n"
        assert head.startswith("WARC/1.1\r\n") and head.endswith("\r\n\r\n") and "\r\nX: y" not in head
        assert f"Content-Length: {n}\r\n" in head
    assert sorted(bytes(r.payload) for r in got) == sorted((h or "").encode() for _, _, h in PAGES)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        raw, f = (h or "").encode(), first.get(h or "")
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                     "response" if i == f else "revisit", None if i == f else f))
    assert sorted(map(tuple, warc.describe(warc.read_archive(spark, path)).collect()), key=str) == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark):
    got = warc.describe(warc.read_archive(spark, archive(spark, min_bytes=5))).collect()
    assert all(r.record_type == "response" and r.refers_to is None for r in got)


def test_damage_stops_the_read(spark):
    path = archive(spark)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("key", "concat(bytes, bytes, x'00') as bytes")
    other = shared_dir(spark, "test-warc")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    bad.write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="does not hash"):
        warc.read_archive(spark, other).collect()
    lost = shared_dir(spark, "test-warc")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{lost}/headers")
    bad.limit(0).write.parquet(f"{lost}/payloads")
    with pytest.raises(Exception, match="no payload"):
        warc.read_archive(spark, lost).collect()


def test_empty(spark):
    assert warc.read_archive(spark, archive(spark, [])).count() == 0
