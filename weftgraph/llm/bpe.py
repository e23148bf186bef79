"""Byte-level BPE by monoid tree reduction.

A piece is halved down to single bytes, whose ids stand in the vocabulary, and
neighbours are joined up the tree. To join, a window over the last tokens of
the left and the first tokens of the right is encoded anew. An encoding is the
one of its bytes exactly when every two neighbouring tokens encode to
themselves; both halves hold this inside, and so does the window, so the join is
right as soon as the two pairs at the window's edges hold it. Until then the
window grows on the side that fails. Joining is associative, so any tree gives
the same ids. What pairs of tokens and short pieces become is remembered.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

CACHE_ENTRIES = 300_000
CACHED_CHARS = 48
#: The ids of parts of so many bytes are remembered.
KEPT_BYTES = 7
#: Up to so many bytes, looking through all pairs is faster than a heap.
SCANNED_BYTES = 32
NEVER = 1 << 62
#: A blank between two characters that are not white space starts a new piece whatever else stands in the text.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ODD = re.compile(f"[{_WS}] | [{_WS}]|\\A | \\Z")
_CUT = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeEncoder:
    """Encodes and decodes whole texts with the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = load_ranks(path)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.pieces = regex.compile(pattern).findall
        #: What two neighbouring tokens become; None if they stay as they are.
        self.pairs: dict[tuple[int, int], list[int] | None] = {}
        self.parts: dict[bytes, list[int]] = {bytes([b]): [ranks[bytes([b])]] for b in range(256)}
        self.cache: dict[str, bytes] = {}

    def merge(self, tokens: list[int]) -> list[int]:
        """The ids of the tokens' bytes: single bytes, of which the pair of lowest rank, the leftmost first, is merged again and again."""
        data = b"".join(map(self.bytes_of.__getitem__, tokens))
        get = self.ranks.get
        if len(data) > SCANNED_BYTES:
            return self.merge_by_heap(data)
        cuts = list(range(len(data) + 1))
        while len(cuts) > 2:
            found = [get(data[i:j], NEVER) for i, j in zip(cuts, cuts[2:], strict=False)]
            least = min(found)
            if least == NEVER:
                break
            del cuts[found.index(least) + 1]
        return [get(data[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def merge_by_heap(self, data: bytes) -> list[int]:
        """The same, with the ranks in a heap, so that long runs take n log n steps."""
        ranks, n = self.ranks, len(data)
        # start -> end of each part, and the start of the part before it
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            # left over from before a merge of either part
            if middle < 0 or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    def pair(self, a: int, b: int) -> list[int] | None:
        """What two neighbouring tokens become; None if they encode to themselves."""
        try:
            return self.pairs[a, b]
        except KeyError:
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            both = [a, b]
            got = self.merge(both)
            self.pairs[a, b] = got = None if got == both else got
            return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: the ids of both byte strings together."""
        if not left or not right:
            return left or right
        window = self.pair(left[-1], right[0])
        if window is None:
            return left + right
        i = j = 1
        while True:
            low = i == len(left) or self.pair(left[-i - 1], window[0]) is None
            high = j == len(right) or self.pair(window[-1], right[j]) is None
            if low and high:
                return left[: len(left) - i] + window + right[j:]
            if not low:
                i = min(2 * i, len(left))
            if not high:
                j = min(2 * j, len(right))
            window = self.merge(left[len(left) - i :] + right[:j])

    def piece(self, data: bytes) -> list[int]:
        """The ids of a piece, by halves."""
        got = self.parts.get(data)
        if got is None:
            half = len(data) // 2
            got = self.join(self.piece(data[:half]), self.piece(data[half:])) if data else []
            if len(data) <= KEPT_BYTES:
                if len(self.parts) >= CACHE_ENTRIES:
                    self.parts = {bytes([b]): [self.ranks[bytes([b])]] for b in range(256)}
                self.parts[data] = got
        return got

    def run(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        found: list[int] = []
        for p in self.pieces(text):
            found += self.piece(p.encode("utf-8", "replace"))
        return struct.pack(f"<{len(found)}I", *found)

    def chunk(self, text: str) -> bytes:
        got = self.cache.get(text)
        if got is None:
            got = self.run(text)
            if len(text) <= CACHED_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[text] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; none for null."""
        if not text:
            return b""
        parts = (_CUT if _ODD.search(text) else _PLAIN).split(text)
        get, chunk = self.cache.get, self.chunk
        out = [get(k) or chunk(k) for k in [" " + p for p in parts[1:]]]
        return chunk(parts[0]) + b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids: those of each half, one after the other."""
        table, a = self.bytes_of, np.frombuffer(ids, "<u4").tolist()

        def half(lo: int, hi: int) -> bytes:
            if hi - lo <= 4096:
                return b"".join(map(table.__getitem__, a[lo:hi]))
            mid = (lo + hi) // 2
            return half(lo, mid) + half(mid, hi)

        return half(0, len(a))


class _Plain:
    """Where every blank stands between two other characters, splitting at blanks does."""

    @staticmethod
    def split(text: str) -> list[str]:
        return text.split(" ")


_PLAIN = _Plain
_SHARED: dict[tuple[str, str], TreeEncoder] = {}


def shared(path: str, pattern: str) -> TreeEncoder:
    """One for all tasks of a Python worker, so that what was joined stays known from task to task."""
    if (path, pattern) not in _SHARED:
        _SHARED[path, pattern] = TreeEncoder(path, pattern)
    return _SHARED[path, pattern]


COLUMNS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the count and digest of its ids and the digest of the bytes they decode to.

    path: the vocabulary file, at the same place on every executor. A null text
    counts as empty: no ids. Repeated rows each get a row; an empty table gives
    none. Other columns, whatever their names, are ignored. A text of any length
    is taken whole. No shuffle, one pass.
    """
    return map_texts(docs, lambda: _digests(shared(path, pattern)), COLUMNS)


def _digests(encoder: TreeEncoder) -> Callable[[list], dict[str, list]]:
    def work(texts: list) -> dict[str, list]:
        n, ids, back = [], [], []
        for t in texts:
            got = encoder.encode(t)
            n.append(len(got) // 4)
            ids.append(hashlib.sha256(got).hexdigest())
            back.append(hashlib.sha256(encoder.decode(got)).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

    return work
