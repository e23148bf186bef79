"""Lexical retrieval packing.

Documents are cut into shards of bounded size in an order by a min-hash of
their tokens, which brings texts with common words together and lets one huge
group of copies go on over many shards. Each shard has a BM25 inverted index
over token ids, weighted by the statistics of the whole corpus. A window starts with a seed, the first unused document; the
index returns the seed's nearest unused neighbours, best first, which fill the
window, and the last of them is cut where the window ends and goes on in the
next. Only the end of a partition leaves less than a window: it is cut into
sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize, release

WINDOW = 4096
END_ID = 2
SHARD_DOCS = 1024
SHARD_TOKENS = 1_500_000
K1, B = 1.2, 0.75
CACHE_ENTRIES = 800_000
CACHED_BYTES = 48
SLICE_BYTES = 8 << 20
#: Between an ASCII letter or digit and another ASCII sign than the apostrophe, either way round, no token goes on.
_SIGNS = r"[!-&(-/:-@\[-`{-~]"
_BEFORE, _AFTER = f"([a-z0-9])({_SIGNS})", f"({_SIGNS})([a-z0-9])"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Token ids of whole texts.

    White space only separates, and letters, digits and other signs are never in
    one token, so the ids of the parts between these borders can be kept.
    Letters A-Z can be small from the start, as the vocabulary is.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.most = cache_entries
        self.cache: dict[bytes, bytes] = {b"": b""}

    def of_parts(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """The ids of parts as unsigned 32-bit integers; letters go many at a time and are told apart by their last tokens."""
        texts = [c.decode("utf-8", "replace") for c in parts]
        found: dict[bytes, bytes] = {}
        alpha = [i for i, t in enumerate(texts) if t.isalpha()]
        for lo in range(0, len(alpha), 256):
            here = alpha[lo : lo + 256]
            ids = np.array(self.tokenizer.encode(" ".join(texts[i] for i in here), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(here) and cut[-1] == len(ids):
                found.update((parts[i], ids[a:b].tobytes()) for i, a, b in zip(here, [0, *cut.tolist()], cut.tolist(), strict=False))
        rest = [i for i in range(len(parts)) if parts[i] not in found]
        if rest:
            encoded = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
            found.update((parts[i], np.array(x.ids, "<u4").tobytes()) for i, x in zip(rest, encoded, strict=True))
        return found

    def known(self, keys: list[bytes]) -> list[bytes]:
        """The ids of distinct parts. A full cache keeps what was just asked for."""
        cache = self.cache
        missing = [k for k in keys if k not in cache]
        if missing:
            made = self.of_parts(missing)
            if len(cache) + len(missing) > self.most:
                keep = {k: cache[k] for k in keys if k in cache}
                cache.clear()
                cache.update(keep)
            cache.update(made)
        out = list(map(cache.__getitem__, keys))
        for k in missing:
            if len(k) > CACHED_BYTES:
                del cache[k]
        return out

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and the end id. Only distinct parts are looked at one by one."""
        cut = pc.ascii_lower(pc.fill_null(texts, ""))
        for border in (_BEFORE, _AFTER):
            cut = pc.replace_substring_regex(cut, border, r"\1 \2")
        split = pc.ascii_split_whitespace(cut)
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()
        found = split.flatten().dictionary_encode()
        del cut, split
        pa.default_memory_pool().release_unused()
        codes = found.indices.to_numpy()
        ids = self.known(found.dictionary.cast(pa.binary()).to_pylist())
        # there are no more ids than bytes, so the numbers of Arrow's offsets do
        lens = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        first = np.cumsum(lens, dtype=np.int32) - lens
        each = lens[codes]
        upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(each, dtype=np.int32)])
        at = np.repeat(first[codes] - upto[:-1], each)
        del found, codes, each
        at += np.arange(len(at), dtype=np.int32)
        whole = np.frombuffer(b"".join(ids), "<u4")[at]
        edges = upto[edges].tolist()
        del ids, at, upto
        end = np.array([END_ID], "<u4")
        return [np.concatenate([whole[a:b], end]) for a, b in zip(edges, edges[1:], strict=False)]


_SHARED: dict[str, Ids] = {}


def shared_ids(path: str) -> Ids:
    """One for all tasks of a Python worker, so that common words stay known from task to task."""
    if path not in _SHARED:
        _SHARED[path] = Ids(path)
    return _SHARED[path]


def slices(batch: pa.RecordBatch, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded text, or of one row; the text is its second column."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(size) // most_bytes
    cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cut, cut[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def route(ids: np.ndarray) -> int:
    """Two min-hashes of the set of ids, one after the other."""
    x = ids.astype(np.uint64)
    a = (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).min()
    b = ((x + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).min()
    return int(a) << 31 | int(b)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, route, ids): the ids with the end id, compressed."""
    schema = pa.schema([("doc_id", pa.int64()), ("route", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, zstd = shared_ids(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch):
                ids = encode(part.column(1))
                narrow = [x.astype("<u2") if x.max() < 1 << 16 else x for x in ids]
                data = [bytes([x.itemsize]) + zstd.compress(x.tobytes()) for x in narrow]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([route(x) for x in ids], pa.int64()), pa.array(data, pa.binary())], schema=schema)
                del ids, narrow, data
                release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, route long, ids binary")


class Corpus(NamedTuple):
    """What BM25 needs of all documents: their number, mean length, and how many hold each id."""

    n: int
    mean: float
    df: np.ndarray


def statistics(rows: DataFrame) -> Corpus:
    """Of all rows of tokenised(); what reaches the driver is bounded by the vocabulary."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, df = zstandard.ZstdDecompressor(), np.zeros(1 << 16, np.int64)
        docs = tokens = 0
        for batch in batches:
            for data in batch.column(0):
                ids = unpacked(zstd, data.as_py())
                docs += 1
                tokens += len(ids)
                terms = np.unique(ids)
                if terms[-1] >= len(df):
                    df = np.pad(df, (0, int(terms[-1]) + 1 - len(df)))
                df[terms] += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, [-1, -2])), pa.array(np.append(df[found], [docs, tokens]))], schema=schema)

    sums = {r["term"]: r["n"] for r in rows.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, tokens = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(max(sums, default=0) + 1, np.int64)
    df[list(sums)] = list(sums.values())
    return Corpus(n, tokens / max(n, 1), df)


def unpacked(zstd: zstandard.ZstdDecompressor, data: bytes) -> np.ndarray:
    return np.frombuffer(zstd.decompress(data[1:]), f"<u{data[0]}")


class Index:
    """A BM25 inverted index over the documents of one shard; without a corpus they are the corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        self.n = len(docs)
        terms, tf, doc = [], [], []
        for i, x in enumerate(docs):
            t, c = np.unique(x, return_counts=True)
            terms.append(t)
            tf.append(c)
            doc.append(np.full(len(t), i, np.int64))
        self.of_doc = terms
        t, c, d = np.concatenate(terms), np.concatenate(tf).astype(float), np.concatenate(doc)
        order = np.argsort(t, kind="stable")
        t, c, self.doc = t[order], c[order], d[order]
        size = np.array([len(x) for x in docs], float)
        self.terms, self.first, df = np.unique(t, return_index=True, return_counts=True)
        self.end = self.first + df
        n, mean, of_all = (self.n, size.mean(), df) if corpus is None else (corpus.n, corpus.mean, corpus.df[self.terms])
        self.idf = np.log1p((n - of_all + 0.5) / (of_all + 0.5))
        self.df = df
        self.weight = np.repeat(self.idf, df) * c * (K1 + 1) / (c + K1 * (1 - B + B * size[self.doc] / mean))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share a term with the seed, best first by all of its terms."""
        at = np.searchsorted(self.terms, self.of_doc[seed])
        at = at[self.df[at] > 1]
        size = self.df[at]
        where = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score = np.bincount(self.doc[where], self.weight[where], self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def order(docs: list[np.ndarray], room: int, window: int = WINDOW, corpus: Corpus | None = None) -> Iterator[int]:
    """The documents in the order in which they fill windows; room: what the open window has left."""
    index = Index(docs, corpus)
    unused = np.ones(len(docs), bool)
    seed = 0
    while True:
        while seed < len(docs) and not unused[seed]:
            seed += 1
        if seed == len(docs):
            return
        unused[seed] = False
        yield seed
        room -= len(docs[seed])
        if room > 0:
            for i in index.neighbours(seed, unused).tolist():
                unused[i] = False
                yield i
                room -= len(docs[i])
                if room <= 0:
                    break
        if room <= 0:
            room = window - (-room) % window


class Writer:
    """Cuts a stream of documents into sequences."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.sequence, self.window = first_sequence, window
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, tokens of the document
        self.held = 0
        self.rows: list[tuple] = []

    @property
    def room(self) -> int:
        return self.window - self.held

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(self.room, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + n], len(ids)))
            self.held += n
            at += n
            if self.held == self.window:
                self.close(self.window)

    def close(self, length: int) -> None:
        """Write a sequence of that many of the open tokens."""
        offset = 0
        while offset < length:
            doc_id, start, ids, total = self.open.pop(0)
            n = min(len(ids), length - offset)
            if n < len(ids):
                self.open.insert(0, (doc_id, start + n, ids[n:], total))
            self.rows.append((doc_id, start, n, zlib.crc32(ids[:n].astype("<u4").tobytes()), total, self.sequence, offset))
            offset += n
        self.held -= length
        self.sequence += 1

    def end(self) -> None:
        while self.held:
            self.close(1 << (self.held.bit_length() - 1))

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all documents: PIECES.

    Each row of docs, repeated ones too, is packed once; a null text is the end
    id alone. sequence_id is unique, not gapless: the partition and a running
    number. Documents longer than a window go on over several. An empty table
    gives no rows. Other columns are ignored.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        writer = Writer(TaskContext.get().partitionId() << 32, window)
        ids: list[int | None] = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for i in order(docs, writer.room, window, corpus) if docs else ():
                writer.add(ids[i], docs[i])
            ids.clear()
            docs.clear()
            release()
            if rows := writer.take():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                ids.append(doc_id)
                docs.append(unpacked(zstd, data))
                held += len(docs[-1])
                if len(docs) >= shard_docs or held >= shard_tokens:
                    held = 0
                    yield from flush()
        yield from flush()
        writer.end()
        yield from flush()

    rows = materialize(tokenised(docs, path))
    corpus = statistics(rows)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rows.repartitionByRange(parts, "route", "doc_id").sortWithinPartitions("route", "doc_id")
    return near.select("doc_id", "ids").mapInArrow(run, PIECES)
