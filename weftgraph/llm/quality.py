"""Quality rules by compression bands.

Text that repeats itself (tables, decorated words, lists of one pattern)
compresses better than prose of its length, and text without the structure of a
language (keys, encoded blobs, random letters) worse. The ratio of bytes to
zstandard bytes is taken of the whole document and of each fixed chunk, and is
held against limits that rise with the length, as short inputs compress less.

The limits were set by measuring prose: between a knot and the next they run
straight over the logarithm of the length. They lie about as far above the
median ratio of prose as its highest half percent, and 0.3 below.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Sequence
from math import log2

import zstandard
from pyspark.sql import DataFrame

from .common import filter_rows, map_texts

#: (bytes, least ratio, largest ratio) at the knots of the bands.
BANDS = (
    (128, 0.80, 1.70),
    (256, 1.05, 1.82),
    (512, 1.30, 1.94),
    (1024, 1.55, 2.03),
    (2048, 1.73, 2.165),
    (4096, 1.86, 2.28),
    (8192, 1.96, 2.40),
    (16384, 2.03, 2.50),
    (32768, 2.08, 2.58),
    (65536, 2.10, 2.66),
    (1 << 20, 2.10, 2.90),
)
CHUNK_BYTES = 4096
#: A document falls when more than this share of its bytes lies in chunks outside the bands.
MAX_BAD_CHUNKS = 0.25
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long"


def repeated_words(ws: Sequence[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(ws) < 4:
        return 0
    seen: set = set()
    again: set = set()
    windows = list(zip(ws, ws[1:], ws[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        if w in seen:
            again.add(w)
        else:
            seen.add(w)
    n = end = 0
    for i, w in enumerate(windows):
        if w in again:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    real = [x for x in lines if x.strip(" \t\n\v\f\r")]
    return len(real) - len(set(real))


class Bands:
    """Limits of the ratio by length."""

    def __init__(self, knots: Sequence[tuple[float, float, float]] = BANDS):
        size, low, high = zip(*knots, strict=True)
        self.at = [log2(x) for x in size]
        self.low, self.high = low, high

    def limits(self, size: int) -> tuple[float, float]:
        """The least and the largest ratio of so many bytes; before the first and after the last knot they stay."""
        x = log2(max(size, 1))
        i = min(max(bisect(self.at, x), 1), len(self.at) - 1)
        share = min(max((x - self.at[i - 1]) / (self.at[i] - self.at[i - 1]), 0.0), 1.0)
        return tuple(v[i - 1] + share * (v[i] - v[i - 1]) for v in (self.low, self.high))

    def outside(self, ratio: float, size: int) -> bool:
        low, high = self.limits(size)
        return not low <= ratio <= high


class Judge:
    """Measures and judges texts; holds the compressors of a task."""

    def __init__(self, bands: Sequence[tuple[float, float, float]] = BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad: float = MAX_BAD_CHUNKS, level: int = 3):
        self.bands, self.chunk_bytes, self.max_bad = Bands(bands), chunk_bytes, max_bad
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.zstd.compress(data)) if data else 0.0

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        data = text.encode("utf-8", "replace")
        ws = data.split()
        n = len(ws)
        repeated = repeated_words(ws)
        failed = n < MIN_WORDS or 100 * repeated > 50 * n
        ratio = self.ratio(data)
        chunks = [data[i : i + self.chunk_bytes] for i in range(0, len(data), self.chunk_bytes)] if len(data) > self.chunk_bytes else []
        bad = [len(c) for c in chunks if self.bands.outside(self.ratio(c), len(c))]
        kept = not failed and not self.bands.outside(ratio, len(data)) and sum(bad) <= self.max_bad * len(data)
        return n, len(text) - len(data) + sum(map(len, ws)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, kept, ratio, len(bad)


def quality(docs: DataFrame, **limits) -> DataFrame:
    """The figures and the verdict of each document: doc_id and COLUMNS.

    A null or blank text has no words: base_failed, not kept. A text of any
    length is judged whole, in chunks too. Repeated rows each get a row, an
    empty table gives none; other columns, whatever their names, are ignored.
    No shuffle, one pass.
    """
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def make():
        judge = Judge(**limits)
        return lambda texts: dict(zip(names, zip(*map(judge, texts), strict=True), strict=True)) if texts else dict.fromkeys(names, ())

    return map_texts(docs, make, COLUMNS)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, with all their columns; rows without a text go."""

    def make():
        judge = Judge(**limits)
        return lambda texts: [judge(t)[6] for t in texts]

    return filter_rows(docs, make)
