"""Quality rules: base counts and zstandard compression bands.

A document is rejected when its whole text, or most of its fixed chunks,
compress too well (repetition) or too badly (noise, encoded data) for their
length: the ratio compressed / plain of short texts is higher by nature, so
every length class has limits of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, with_workers

#: (from this many bytes on, lowest ratio, highest ratio); shorter texts pass.
DOCUMENT_BANDS = ((64, 0.20, 1.15), (256, 0.18, 1.00), (1024, 0.14, 0.85), (4096, 0.12, 0.75),
                  (16384, 0.10, 0.70), (131072, 0.05, 0.70))
#: The same for one full chunk, and the share of full chunks that may be outside.
CHUNK, CHUNK_BAND, CHUNK_SHARE, LEVEL = 4096, (0.10, 0.75), 0.5, 3
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, "
          "chunks_outside long, chunks long")

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile("[#*$%&|<>]")


def repeat_words(words: list[str], window: int = 5) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    if len(seen) ** window < 2 ** 63:
        key = np.zeros(n, np.int64)
        for j in range(window):
            key = key * len(seen) + ids[j:j + n]
    else:                       # rank pairs of (window so far, next word) exactly
        key = ids[:n]
        for j in range(1, window):
            key = np.unique(key * len(seen) + ids[j:j + n], return_inverse=True)[1].astype(np.int64)
    _, of, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[of] > 1
    covered = np.zeros(len(words), bool)
    for j in range(window):
        covered[j:j + n] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = _WORDS.findall(text)
    lines, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in lines:
                dup += 1
            elif _WORDS.search(line):
                lines.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeat_words(words)


def _band(n, bands):
    return next(((lo, hi) for size, lo, hi in reversed(bands) if n >= size), (0.0, np.inf))


class Compression:
    """Ratios and verdict of one text at a time."""

    def __init__(self, bands=DOCUMENT_BANDS, chunk=CHUNK, chunk_band=CHUNK_BAND,
                 chunk_share=CHUNK_SHARE, level=LEVEL):
        self.bands, self.chunk, self.chunk_band = bands, chunk, chunk_band
        self.chunk_share, self.level = chunk_share, level
        self.one = zstandard.ZstdCompressor(level=level)

    def judge(self, text: str) -> tuple[bool, float | None, int, int]:
        """(passes, ratio of the whole, full chunks outside, full chunks)."""
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        if not n:
            return True, None, 0, 0
        ratio = len(self.one.compress(raw)) / n
        lo, hi = _band(n, self.bands)
        outside, chunks, view = 0, n // self.chunk, memoryview(raw)
        for i in range(chunks):
            r = len(self.one.compress(view[i * self.chunk:(i + 1) * self.chunk])) / self.chunk
            outside += not self.chunk_band[0] <= r <= self.chunk_band[1]
        return lo <= ratio <= hi and outside <= self.chunk_share * chunks, ratio, outside, chunks


def _judged(options):
    def f(batches):
        compression = Compression(**options)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = base_counts(text or "")
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                passes, ratio, outside, chunks = compression.judge(text or "")
                out.append((doc_id, *counts, failed, passes and not failed, ratio, outside, chunks))
            types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            names = [x.split() for x in SCHEMA.split(", ")]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, types[t]) for c, (_, t) in zip(zip(*out), names)],
                    [n for n, _ in names])
    return f


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: the base counts, base_failed, kept, and the
    compression figures.  ``options`` go to :class:`Compression`.

    A null text is an empty one (no words: base_failed), repeated rows stay,
    a null id stays null, no rows give none, other columns are ignored."""
    with_workers(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_judged(options), SCHEMA))
