"""Secret scans through nested encodings.

A text is the first layer of a worklist.  Each layer is scanned; then its
URL escapes, Unicode escapes, base64 runs and compressed payloads are opened
into new layers, which join the worklist, until nothing new appears.  A
layer that was seen before (by digest and place) is not opened again, so
self-reproducing payloads end.  Every character of a layer knows the span of
the original text it came from, and findings are reported there.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import with_workers

KINDS = ("assign", "access", "hex")
#: A guard against decompression bombs: the compressed layers of a text may
#: open to so many times its own length, LEAST bytes at least.  What lies beyond
#: is counted in n_unopened.
EXPANSION, LEAST = 4096, 256 << 20
#: Opened payloads are scanned in chunks of so many bytes as they inflate, each
#: with the end of the one before it.
CHUNK, OVERLAP = 16 << 20, 1 << 20
SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
          "spans string, n_layers long, n_unopened long")

_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")           # maximal runs; shorter ones fail anyway
_URL = re.compile("(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
                      r"|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|[！-～])+")
_UNIT = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})"
                   r"|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);|([！-～])")
_BASE64 = re.compile("[A-Za-z0-9+/_-]{16,}")
_WRAPPED = re.compile("[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+")
_BREAKS, _STANDARD = re.compile("[\r\n\t ]+"), str.maketrans("-_", "+/")
#: Separators of a run after which base64 is tried to begin.
STARTS = 16
_MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"\x28\xb5\x2f\xfd", lambda: zstandard.ZstdDecompressor().decompressobj()),
          (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lzma.LZMADecompressor),
          (b"\x78\x01", zlib.decompressobj), (b"\x78\x5e", zlib.decompressobj),
          (b"\x78\x9c", zlib.decompressobj), (b"\x78\xda", zlib.decompressobj))


def scan(text: str) -> list[tuple[int, int, int]]:
    """Base findings (start, kind number, end), in order."""
    out, low = [], None
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in _KEYS):
            out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text and where each of its characters lies in the original: ``at``
    is None (itself), a span shared by all, or two arrays."""

    def __init__(self, text, at=None):
        self.text, self.at = text, at

    def span(self, start, end):
        if self.at is None:
            return start, end
        if isinstance(self.at[0], int):
            return self.at
        return int(self.at[0][start]), int(self.at[1][end - 1])

    def key(self):
        at = self.span(0, len(self.text))
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), at

    def replaced(self, pattern, decode):
        """The layer with every match decoded, or None if none is."""
        parts, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            if not (new := decode(m[0])):
                continue
            for text, a, b in ((self.text[last:m.start()], last, m.start()), (new, m.start(), m.end())):
                parts.append(text)
                if text is new:
                    n = len(new)
                    s, e = self.span(a, b)
                    starts.append(np.full(n, s)), ends.append(np.full(n, e))
                elif text:
                    self._copy(a, b, starts, ends)
            last = m.end()
        if not parts:
            return None
        parts.append(self.text[last:])
        if last < len(self.text):
            self._copy(last, len(self.text), starts, ends)
        if self.at is not None and isinstance(self.at[0], int):
            return Layer("".join(parts), self.at)
        return Layer("".join(parts), (np.concatenate(starts), np.concatenate(ends)))

    def _copy(self, a, b, starts, ends):
        if self.at is None:
            starts.append(np.arange(a, b)), ends.append(np.arange(a + 1, b + 1))
        elif isinstance(self.at[0], int):
            starts.append(np.full(b - a, self.at[0])), ends.append(np.full(b - a, self.at[1]))
        else:
            starts.append(self.at[0][a:b]), ends.append(self.at[1][a:b])


def _from_url(run):
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _from_unicode(run):
    units = []
    for m in _UNIT.finditer(run):
        brace, four, eight, two, dec, hexa, wide = m.groups()
        units.append(ord(wide) - 0xFEE0 if wide else int(dec) if dec
                     else int(brace or four or eight or two or hexa, 16))
    if max(units) > 0x10FFFF:
        return None
    raw = b"".join(chr(u).encode("utf-16-le", "surrogatepass") for u in units)
    return raw.decode("utf-16-le", "replace")


def _readable(raw: bytes) -> str | None:
    """The text of a layer: UTF-8, also with some damaged bytes, or UTF-16; None
    for what is no text."""
    if len(raw) >= 8 and (zeros := raw.count(0)) * 4 > len(raw):
        kind = "utf-16-be" if raw[::2].count(0) > zeros // 2 else "utf-16-le"
        text = raw[:len(raw) & ~1].decode(kind, "replace").lstrip("\ufeff")
    else:
        text = raw.decode("utf-8", "replace")
    if "\ufffd" not in text and text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable():
        return text or None
    odd = sum(c == "\ufffd" or not (c.isprintable() or c in "\t\n\r") for c in text)
    return text if text and 10 * odd <= len(text) else None


class _Source:
    """Pieces of bytes, which can be put back."""

    def __init__(self, pieces):
        self.pieces, self.back = iter(pieces), []

    def next(self):
        return self.back.pop() if self.back else memoryview(next(self.pieces, b""))

    def put(self, piece) -> None:
        if len(piece):
            self.back.append(memoryview(piece))

    def head(self, n: int = 6) -> bytes:
        got = []
        while sum(map(len, got)) < n and len(piece := self.next()):
            got.append(piece)
        for piece in reversed(got):
            self.put(piece)
        return b"".join(p[:n] for p in got)[:n]


class _Budget:
    def __init__(self, left):
        self.left, self.unopened = left, 0

    def _members(self, src: _Source, magic: bytes, opener):
        """Pieces of what the members (or frames) at the front of ``src`` hold;
        if nothing can be opened ``src`` is as before."""
        used, some = [], False
        while src.head().startswith(magic):
            d = opener()
            while not getattr(d, "eof", False) and len(piece := src.next()):
                src.put(piece[1024:])
                piece = piece[:1024]                  # little in, so never much out at once
                if not some:
                    used.append(piece)
                try:
                    part = d.decompress(piece)
                except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
                    self.unopened += some
                    break
                self.left -= len(part)
                if self.left < 0:
                    self.unopened += 1
                    return
                if part:
                    some = True
                    yield part
            if not getattr(d, "eof", False):
                break
            src.put(d.unused_data)
            while len(rest := src.next()) and not len(rest := bytes(rest).lstrip(b"\0") if not rest[0] else rest):
                pass
            src.put(rest)
        if not some:
            src.put(b"".join(used))

    def payload(self, raw: bytes):
        """The bytes inside a compressed layer in overlapping chunks, or None if
        ``raw`` is none.  What is compressed more than once is opened through."""
        src, opened = _Source([raw]), False
        while found := next(((m, o) for m, o in _MAGIC if src.head().startswith(m)), None):
            out = _Source(self._members(src, *found))
            if not out.head(1):
                break
            src, opened = out, True
        return self._chunks(src) if opened else None

    @staticmethod
    def _chunks(src: _Source):
        held, size = [], 0
        while len(piece := src.next()):
            held.append(piece)
            size += len(piece)
            if size >= CHUNK:
                whole = b"".join(held)
                yield whole
                held, size = [whole[-OVERLAP:]], min(OVERLAP, len(whole))
                if not len(piece := src.next()):
                    return
                src.put(piece)
        yield b"".join(held)


def _decoded(run: str):
    """What a run of base64 letters, of either alphabet, may stand for: it may
    begin at any of its first four letters."""
    run = run.translate(_STANDARD)
    for k in range(4):
        part = run[k:]
        part = part[:len(part) - (len(part) % 4 == 1)]
        yield base64.b64decode(part + "=" * (-len(part) % 4))


def _texts(run: str, budget: _Budget):
    """The texts of the first reading of ``run`` that has any."""
    for raw in _decoded(run):
        chunks = budget.payload(raw)
        some = False
        for chunk in (raw,) if chunks is None else chunks:
            if (text := _readable(chunk)) is not None:
                some = True
                yield text
        if some or chunks is not None:
            return


def _base64_layers(layer: Layer, budget: _Budget):
    """Runs of base64 letters, those broken by line ends whole; of a run that
    says nothing, its ends after separators and its pieces between them."""
    text = layer.text

    def span(a, b):
        end = b
        while end < len(text) and text[end] == "=" and end - b < 2:
            end += 1
        return layer.span(a, end)
    wrapped = []
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        some = False
        for new in _texts(_BREAKS.sub("", m[0]), budget):
            some = True
            yield Layer(new, span(m.start(), m.end()))
        if some:
            wrapped.append(m.span())
    at = 0
    for m in _BASE64.finditer(text):
        while at < len(wrapped) and wrapped[at][1] <= m.start():
            at += 1
        if at < len(wrapped) and wrapped[at][0] <= m.start():
            continue                                       # a line of an opened run
        some = False
        for new in _texts(m[0], budget):
            some = True
            yield Layer(new, span(m.start(), m.end()))
        if some:
            continue
        parts = {(p.end(), len(m[0])) for p in itertools.islice(re.finditer("[/_-]+", m[0]), STARTS)}
        parts |= {p.span() for seps in ("/", "_-") for p in re.finditer(f"[^{seps}]+", m[0])}
        for a, b in sorted(parts - {(0, len(m[0]))}):
            if b - a >= 16:
                for new in _texts(m[0][a:b], budget):
                    yield Layer(new, span(m.start() + a, m.start() + b))


def _opened(layer: Layer, budget: _Budget):
    text = layer.text
    if "%" in text and (new := layer.replaced(_URL, _from_url)):
        yield new
    if (not text.isascii() or "\\" in text or "&#" in text) and \
            (new := layer.replaced(_UNICODE, _from_unicode)):
        yield new
    yield from _base64_layers(layer, budget)


def find(text: str | None, max_inflated: int | None = None):
    """(base findings, all findings, layers, unopened layers) of one text;
    findings are (start, kind number, end) in code points of the text.

    The worklist holds layers still to be opened, each as the rest of what its
    parent opens to, so that of a large payload one chunk at a time is held."""
    root = Layer(text or "")
    base = scan(root.text)
    budget = _Budget(max(LEAST, EXPANSION * len(root.text)) if max_inflated is None else max_inflated)
    found, seen, layers = set(base), {root.key()}, 1
    todo = [_opened(root, budget)]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
        elif (key := layer.key()) not in seen:
            seen.add(key)
            layers += 1
            for start, kind, end in scan(layer.text):
                a, b = layer.span(start, end)
                found.add((a, kind, b))
            todo.append(_opened(layer, budget))
    return base, sorted(found), layers, budget.unopened


def _joined(findings) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in findings)


def _scanned(max_inflated):
    def f(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, found, layers, unopened = find(text, max_inflated)
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                out.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(),
                            _joined(found), layers, unopened))
            names = [x.split() for x in SCHEMA.split(", ")]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if t == "long" else pa.string())
                     for c, (_, t) in zip(zip(*out), names)], [n for n, _ in names])
    return f


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            max_inflated: int | None = None) -> DataFrame:
    """One row per input row: counts of the base findings by kind, the digest
    of their spans, and the spans of all layers' findings.

    A null text is an empty one, repeated rows stay, a null id stays null,
    no rows give none, other columns are ignored.  Spans from inside an
    encoded run cover the whole run."""
    with_workers(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_scanned(max_inflated), SCHEMA))


def redacted(text: str | None, max_inflated: int | None = None) -> str | None:
    """``text`` with every finding replaced by its kind; overlapping findings
    become one, named after the first."""
    if not text:
        return text
    _, found, _, _ = find(text, max_inflated)
    if not found:
        return text
    parts, last, i = [], 0, 0
    while i < len(found):
        start, kind, end = found[i]
        i += 1
        while i < len(found) and found[i][0] < end:
            end = max(end, found[i][2])
            i += 1
        parts += [text[last:start], f"[{KINDS[kind]}]"]
        last = end
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars",
           max_inflated: int | None = None) -> DataFrame:
    """``docs`` with the secrets in the texts replaced by ``[kind]``, and the
    length column, if there is one, brought up to date in changed rows.  All
    rows and columns stay; a null text stays null."""
    with_workers(docs.sparkSession)

    @pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redacted(t, max_inflated), na_action="ignore").astype(object)

    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t = f"c{names.index(text_col)}"
    out = safe.withColumn("new", clean(F.col(t)))
    cols = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    if length_col in cols:
        kind = docs.schema[length_col].dataType
        cols[length_col] = F.when(F.col("new") == F.col(t), cols[length_col]).otherwise(
            F.length("new").cast(kind))
    cols[text_col] = F.col("new")
    return out.select(*[c.alias(n) for n, c in cols.items()])
