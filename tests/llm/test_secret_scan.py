"""Secret scans: base findings against a plain form, nested layers, spans."""

import base64
import bz2
import gzip
import hashlib
import lzma
import os
import re
import urllib.parse
import zlib

import zstandard

from windlass.llm import secret_scan as s

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def plain(text):
    """The contract word by word: all matches, then the failing ones dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_findings():
    for t in ("password=hunter22", 'x "Api_Key": "abcdef"', "secret: token: abcdefgh", "token=abc",
              "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAKIA" + "B" * 15, "a" * 23, "f" * 24 + "g",
              "ſecret=abcdefg", "éé PASSWD = 'abcdef' " + "0" * 40):
        assert s.scan(t) == plain(t) == s.find(t)[0]


def only(text, secret_kind=0):
    base, found, _, _ = s.find(text)
    assert set(base) <= set(found)
    return [f for f in found if f not in base and f[1] == secret_kind]


def test_nested_layers_map_to_the_run():
    inner = "password=hunter2two"
    b64 = base64.b64encode(inner.encode()).decode()
    assert only(f"see {b64} end") == [(4, 0, 4 + len(b64))]
    twice = base64.b64encode(f"x {b64} y".encode()).decode()
    assert only(f"é {twice}") == [(2, 0, 2 + len(twice))]
    for pack in (gzip.compress, zlib.compress, zstandard.ZstdCompressor().compress):
        run = base64.urlsafe_b64encode(pack(pack(inner.encode()))).decode()
        assert only(f"- {run}.") == [(2, 0, 2 + len(run))]
    url = "".join(f"%{b:02X}" for b in inner.encode())
    assert only(f"go {url}!") == [(3, 0, 3 + len(url))]
    assert only("a password%3Dhunter22 b") == [(2, 0, 21)]
    uni = "".join(f"\\u{ord(c):04x}" for c in inner)
    assert only(f"{uni} z") == [(0, 0, len(uni))]
    mixed = urllib.parse.quote(base64.b64encode(inner.encode()).decode(), safe="")
    assert only(mixed)
    assert only("ｐassword=hunter22") == [(0, 0, 17)]


def test_every_member_of_a_payload_is_opened():
    filler = b"plain words " * 900
    zstd = zstandard.ZstdCompressor().compress
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstd, zlib.compress):
        for parts in ((b"first ", b"password=hunter2secret"), (filler, os.urandom(9000).hex().upper().encode(),
                                                              b"x", b"token=hunter2secret")):
            run = base64.b64encode(b"".join(map(pack, parts))).decode()
            assert only(f"- {run}.")[0][:2] == (2, 0), (pack, len(parts))
    damaged = gzip.compress(b"password=hunter2secret") + b"\x1f\x8b junk"
    assert only(base64.b64encode(damaged).decode())


def test_ends_on_cycles_bombs_and_junk():
    bomb = base64.b64encode(gzip.compress(b"a" * 5_000_000)).decode()
    assert s.find(bomb, 1 << 20)[3] == 1
    for t in ("%25" * 300, "%", "\\u", "&#9999999;", "A" * 1000, "=" * 50, "\\ud800\\u0041", "\\U00110000"):
        s.find(t)
    t = "".join("%25" for _ in range(1)) + "2525" * 200
    assert s.find(t)[2] <= 402


SECRET = "the key is password=hunter2secret, keep it"


def wrapped(raw, width=76, end="\n"):
    run = base64.b64encode(raw).decode()
    return end.join(run[i:i + width] for i in range(0, len(run), width))


def test_wrapped_base64():
    """Lines of 64 or 76 letters are one run: a secret across a line end, and a
    compressed payload whose secret is far behind its first line."""
    for width, end in ((76, "\n"), (64, "\r\n"), (64, "\n  ")):
        for shift in range(0, 60, 7):
            run = wrapped(b"." * shift + SECRET.encode() * 3, width, end)
            assert only(f"a {run} b")[0] == (2, 0, 2 + len(run))
        for pack in (gzip.compress, bz2.compress, zlib.compress):
            run = wrapped(pack(os.urandom(3000) + SECRET.encode()), width, end)
            assert s.find(f"a {run}\n\nb")[3] == 0
            run = wrapped(pack(b"words and more words " * 900 + os.urandom(900).hex().upper().encode() + SECRET.encode()), width, end)
            assert only(f"a {run}\n\nb")[0] == (2, 0, 2 + len(run))


def test_base64_after_other_letters():
    for inner in (SECRET, SECRET + "?" * 40, "token=abc/def+ghi " * 3):
        run = base64.b64encode(inner.encode()).decode().rstrip("=")
        for before in ("session-", "/api/v1/x/", "a", "id_", "k-v-", "xy/", "q"):
            (a, kind, b), *_ = only(f"see {before}{run} end")
            assert kind == 0 and 4 <= a <= 4 + len(before) and b == 4 + len(before) + len(run)


def test_other_charsets_and_damage():
    for kind in ("utf-16-le", "utf-16-be", "utf-16"):
        run = base64.b64encode(SECRET.encode(kind)).decode()
        assert only(f"x {run}") == [(2, 0, 2 + len(run))]
    raw = bytearray(SECRET.encode())
    raw[3] = 0xE9
    run = base64.b64encode(bytes(raw)).decode()
    assert only(f"x {run}") == [(2, 0, 2 + len(run))]


def test_large_layers_are_scanned_in_chunks():
    """A secret behind 65 MiB, and one on the edge of two chunks."""
    for size in (65 << 20, s.CHUNK - 9):
        for pack in (gzip.compress, zstandard.ZstdCompressor().compress):
            run = base64.b64encode(pack(b" " * size + SECRET.encode() + b"." * 99)).decode()
            found = s.find(f"- {run}")
            assert found[1] == [(2, 0, 2 + len(run))] and found[3] == 0


def test_redaction_merges_overlaps():
    t = "a password=hunter22 b " + "0" * 30 + " c"
    assert s.redacted(t) == "a [assign] b [hex] c"
    assert s.redacted("token=" + "a" * 40) == "[assign]"
    assert s.redacted(None) is None and s.redacted("") == ""


def test_table(spark):
    from llm_helpers import SF
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in s.secrets(d).collect()}
    rows = d.collect()
    assert len(got) == len(rows)
    for r in rows:
        base = plain(r.text)
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        text = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(g.spans.split(","))
    clean = s.redact(d)
    assert clean.schema == d.schema or clean.columns == d.columns
    for r in clean.collect():
        assert not plain(r.text) and r.n_chars is not None


def test_nulls_repeats_long_empty(spark):
    rows = [(None, None, "x"), (5, "", "y"), (5, "", "y"), (6, "z " * 100_000 + "token=abcdef1", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, new string")
    got = sorted(((r.doc_id, r.n_assign, r.spans) for r in s.secrets(d).collect()), key=str)
    assert got == [(5, 0, ""), (5, 0, ""), (6, 1, "assign:200000:200013"), (None, 0, "")]
    c = s.redact(d)
    assert c.columns == d.columns and c.where("text is null").count() == 1
    assert s.secrets(d.limit(0)).count() == 0 and s.redact(d.limit(0)).count() == 0
