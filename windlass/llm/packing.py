"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers (512 ... 4096 tokens), each tier
is packed into windows of its own size from the longest tier down, gaps of
long windows are filled with whole pieces of shorter tiers and then with a
cut one, and the finished windows are dealt to training steps of equal token
counts with the same mix of tiers.  A window is full, so nothing is padded;
only a group's last rest is cut into power-of-two windows.

Everything happens in one pass over the texts: a task packs its own rows in
groups of bounded tokens, so there is no shuffle, no key and no skew.
"""

from __future__ import annotations

import bisect
import itertools
import re
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_workers

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens of one packing group (4 bytes each), and windows of TIERS[-1]
#: tokens in one training step.
GROUP_TOKENS, STEP_WINDOWS = 1 << 21, 8
#: Word pieces a worker remembers; a full memory starts anew.
MEMORY = 1_000_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, context_size long, step_id long")

# Characters for which NFC and lower-casing work character by character.
_SAFE = re.compile("[\t\n\r\x20-\x7e¡-įı-ž]*")
_kind = {k: re.escape("".join(c for c in map(chr, range(33, 0x17f))
                              if unicodedata.category(c)[0] == k)) for k in "LN"}
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_kind['L']}]+|[{_kind['N']}]"
                    f"|[^\\s{_kind['L']}{_kind['N']}]+")


class Tokens:
    """Ids of texts, as little-endian 32-bit bytes.

    Texts of Latin letters are cut into the tokenizer's own word pieces, and
    each piece's ids are remembered; any other text, and one that holds an
    added token of the tokenizer (such as an end mark), goes through the
    tokenizer as a whole.  The ids are the same either way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = t = Tokenizer.from_file(path)
        model, byte = t.model, _byte_letters()
        # In any case: an added token may be looked for after normalisation.
        added = [re.escape(a.content) for a in t.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.I) if added else None

        class Memory(dict):
            def __missing__(self, piece):
                if len(self) >= MEMORY:
                    self.clear()
                s = piece if piece.isascii() else "".join(byte[b] for b in piece.encode())
                ids = self[piece] = np.array([x.id for x in model.tokenize(s)], "<u4").tobytes()
                return ids
        self.memory = Memory()

    def ids(self, text: str) -> bytes:
        if _SAFE.fullmatch(text) and not (self.added and self.added.search(text)):
            return b"".join(map(self.memory.__getitem__, _PIECE.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters for themselves, the rest from U+0100 on."""
    more = itertools.count(256)
    shown = lambda b: 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
    return [chr(b) if shown(b) else chr(next(more)) for b in range(256)]


def _tokens(path: str) -> Tokens:
    """One per worker process and file: the memory outlives a task."""
    kept = sys.modules[__name__].__dict__.setdefault("_KEPT", {})
    if path not in kept:
        kept[path] = Tokens(path)
    return kept[path]


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows for documents of these lengths: lists of (document, start,
    length).  Every window's length is a tier size, or for the last rest a
    power of two."""
    top, windows = tiers[-1], []
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]   # (length, document, start)

    def put(doc, start, n):
        bisect.insort(pools[bisect.bisect_left(tiers, n)], (n, doc, start))

    rests = []
    for doc, n in enumerate(lengths):
        windows += [[(doc, s, top)] for s in range(0, n - n % top, top)]
        if n % top:
            rests.append((n % top, doc, n - n % top))
    for n, doc, start in sorted(rests):
        pools[bisect.bisect_left(tiers, n)].append((n, doc, start))

    def take(gap, highest):
        """The longest piece of tiers up to ``highest`` that fits the gap."""
        for k in range(min(highest, bisect.bisect_left(tiers, gap)), -1, -1):
            at = bisect.bisect_right(pools[k], (gap, sys.maxsize, sys.maxsize)) - 1
            if at >= 0:
                return pools[k].pop(at)
        return None

    for k in range(len(tiers) - 1, -1, -1):
        size = tiers[k]
        while pools[k]:
            n, doc, start = pools[k].pop()
            window, gap = [(doc, start, n)], size - n
            while gap:
                if (got := take(gap, k)) is None:
                    # Nothing fits: cut the shortest longer piece.
                    pool = next((p for p in pools[:k + 1] if p), None)
                    if pool is None:
                        break
                    m, doc, start = pool.pop(0)
                    put(doc, start + gap, m - gap)
                    got = (gap, doc, start)
                window.append((got[1], got[2], got[0]))
                gap -= got[0]
            windows += [window] if not gap else _powers(window)
    return windows


def _powers(window):
    """A rest cut into windows whose lengths are powers of two."""
    total, out = sum(x[2] for x in window), []
    todo = list(reversed(window))
    for bit in range(total.bit_length() - 1, -1, -1):
        want = total & (1 << bit)
        part = []
        while want:
            doc, start, n = todo.pop()
            if n > want:
                todo.append((doc, start + want, n - want))
                n = want
            part.append((doc, start, n))
            want -= n
        if part:
            out.append(part)
    return out


def steps(sizes: list[int], top: int = TIERS[-1], step_windows: int = STEP_WINDOWS) -> list[int]:
    """A step for each window: windows of a tier are bundled to ``top``
    tokens, and the bundles, tier after tier, are dealt round-robin, so that
    steps hold equal tokens and the same mix.  Rests join the last steps."""
    bundles, open_ = [], {}
    for w in sorted(range(len(sizes)), key=lambda w: -sizes[w]):
        b = open_.setdefault(sizes[w], [])
        b.append(w)
        if len(b) * sizes[w] >= top:
            bundles.append(open_.pop(sizes[w]))
    bundles += open_.values()
    n, out = max(1, -(-len(bundles) // step_windows)), [0] * len(sizes)
    for i, b in enumerate(bundles):
        for w in b:
            out[w] = i % n
    return out


def _packed(path, tiers, group_tokens, step_windows):
    def rows(batches):
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    def f(batches):
        if path is None:
            import public_tokenizers
            tokens = _tokens(public_tokenizers.path("word_bpe_49k.json"))
        else:
            tokens = _tokens(path)
        end = np.array([END_ID], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        step, held, size = sequence, [], 0
        for doc_id, text in itertools.chain(rows(batches), [(None, False)]):
            last = text is False
            if not last:
                ids = tokens.ids(text or "") + end
                held.append((doc_id, ids))
                size += len(ids) // 4
            if held and (last or size >= group_tokens):
                windows = plan([len(ids) // 4 for _, ids in held], tiers)
                sizes = [sum(x[2] for x in w) for w in windows]
                of = steps(sizes, tiers[-1], step_windows)
                out = []
                for w, window in enumerate(windows):
                    offset = 0
                    for doc, start, n in window:
                        i, ids = held[doc]
                        out.append((i, start, n, zlib.crc32(memoryview(ids)[4 * start:4 * (start + n)]),
                                    len(ids) // 4, sequence + w, offset, sizes[w], step + of[w]))
                        offset += n
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                sequence, step, held, size = sequence + len(windows), step + max(of) + 1, [], 0
    return f


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS,
         group_tokens: int = GROUP_TOKENS, step_windows: int = STEP_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, context_size, step_id.

    A null or empty text is a document of its end id alone; repeated rows
    are packed once each, a null id stays null, no rows give no pieces,
    other columns are ignored.  ``tokenizer`` is the vocabulary file, at the
    same path on every executor (default: the installed public one)."""
    with_workers(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_packed(tokenizer, tiers, group_tokens, step_windows), SCHEMA))
