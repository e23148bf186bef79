"""Language-model scores by deleted interpolation.

p(w|h) mixes the maximum-likelihood bigram, the maximum-likelihood unigram and
the uniform distribution. The mixture depends on the bucket of h's frequency;
its weights are learned by expectation-maximisation on the counts of documents
that were held out of the counts being mixed. Scores then use all training
counts.

Counting and looking up is an exchange of sorted key blocks. A task cuts its
documents into blocks of bounded size and sends, to the owner of each range of
key hashes, the block's distinct keys with their counts; the owner adds up and
answers with totals in the same order. So a frequent word is one key of a block,
not a row of each occurrence, and no table of counts lies in one place. Words
and pairs are known by 64-bit hashes.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, crc_of_id, materialize

BLOCK_WORDS = 1_000_000
BLOCK_DOCS = 20_000
FOLDS, HELD_OUT = 5, 1
#: One training document in so many is held out of the counts on which the weights are learned.
DEV_ONE_IN = 10
#: Powers of two of a context's frequency, beyond any corpus.
BUCKETS = 64
ROUNDS = 60
#: To learn the weights, ratios of probabilities are gathered in steps of 1/STEPS of a power of two (2% off at most).
STEPS = 16
#: Codes of ratios: so many bits each, with the ratio one in the middle.
CODE_BITS = 12
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as f:
        return {k: f[k] for k in f.files}


def squeeze(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as bytes of their differences, low bytes last, which compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def unsqueeze(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.T.copy().view("<u8").reshape(-1), dtype=np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first * np.uint64(0x87C37B91114253D5) ^ (second + np.uint64(0x52DCE729))) * _MIX
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The owner of each key; it never falls as keys rise."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def check_of(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Tells other keys from these: totals are given in the order of the keys, so they must be of the same ones."""
    return np.array([xxh64_intdigest(words.tobytes()), xxh64_intdigest(pairs.tobytes())], np.uint64)


def fold(doc_id: int | None) -> tuple[bool, bool]:
    """(held out, dev) of a document."""
    held = crc_of_id(doc_id) % FOLDS == HELD_OUT
    return held, not held and xxh64_intdigest(str(doc_id).encode(), 7) % DEV_ONE_IN == 0


class Block:
    """Documents as runs BEGIN, words, END of word hashes."""

    def __init__(self) -> None:
        self.ids: list = []
        self.held: list[bool] = []
        self.runs: list[np.ndarray] = []
        self.words = 0

    def add(self, doc_id, text: str | None, held: bool) -> None:
        ws = (text or "").encode("utf-8", "replace").translate(LOWER).split()
        run = np.empty(len(ws) + 2, np.uint64)
        run[0], run[-1] = BEGIN, END
        run[1:-1] = np.fromiter(map(xxh64_intdigest, ws, repeat(1)), np.uint64, len(ws))
        self.ids.append(doc_id)
        self.held.append(held)
        self.runs.append(run)
        self.words += len(ws)

    @property
    def full(self) -> bool:
        return self.words >= BLOCK_WORDS or len(self.ids) >= BLOCK_DOCS

    def close(self) -> None:
        self.all = np.concatenate(self.runs)
        self.lens = np.array([len(r) for r in self.runs], np.int64)
        self.keys, index = np.unique(self.all, return_inverse=True)
        self.index = index.astype(np.uint32)

    def pairs(self) -> np.ndarray:
        """Keys of each neighbour pair within a document."""
        inner = np.ones(len(self.all), bool)
        inner[np.cumsum(self.lens) - self.lens] = False
        at = np.flatnonzero(inner)
        return pair_keys(self.all[at - 1], self.all[at])

    def counts(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """For each owner: keys and training counts."""
        counted = np.repeat(~np.array(self.held), self.lens)
        n1 = np.bincount(self.index[counted], minlength=len(self.keys))
        keys2, index2 = np.unique(self.pairs(), return_inverse=True)
        n2 = np.bincount(index2[np.repeat(~np.array(self.held), self.lens - 1)], minlength=len(keys2))
        cut1 = np.searchsorted(part_of(self.keys, parts), np.arange(parts + 1))
        cut2 = np.searchsorted(part_of(keys2, parts), np.arange(parts + 1))
        for p in np.flatnonzero((np.diff(cut1) > 0) | (np.diff(cut2) > 0)).tolist():
            a, b = slice(cut1[p], cut1[p + 1]), slice(cut2[p], cut2[p + 1])
            yield p, pack(k1=squeeze(self.keys[a]), n1=n1[a], k2=squeeze(keys2[b]), n2=n2[b], check=check_of(self.keys[a], keys2[b]))

    def itself(self) -> bytes:
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        return pack(ids=ids, null=np.array([i is None for i in self.ids]), held=np.array(self.held), lens=self.lens, keys=squeeze(self.keys), index=self.index)


def blocks(docs: DataFrame, parts: int, dev: bool | None, counts: bool) -> DataFrame:
    """(block, dev, part, data): requests of the blocks to the owners, or the blocks themselves (part -1).

    Blocks are made the same way each time, as scores() sees to it that the
    splits of the input and the order within are the same; dev documents have
    blocks of their own.
    """
    schema = pa.schema([("block", pa.int64()), ("dev", pa.bool_()), ("part", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        made = {True: 0, False: 0}
        open_ = {True: Block(), False: Block()}

        def emit(kind: bool) -> Iterator[pa.RecordBatch]:
            block, open_[kind] = open_[kind], Block()
            number = (here << 24) + 2 * made[kind] + kind
            made[kind] += 1
            block.close()
            rows = block.counts(parts) if counts else [(-1, block.itself())]
            for part, data in rows:
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([kind]), pa.array([part], pa.int32()), pa.array([data], pa.binary())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, kind = fold(doc_id)
                if dev is None or dev == kind:
                    open_[kind].add(doc_id, text.as_py(), held)
                    if open_[kind].full:
                        yield from emit(kind)
        for kind in (False, True):
            if open_[kind].ids:
                yield from emit(kind)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if len(held) >= 64:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(gathered, "block long, dev boolean, part int, data binary")


_ANSWER = "block long, dev boolean, part int, data binary, v long, n long, v_kept long, n_kept long"


def answer(group: pa.Table) -> pa.Table:
    """An owner's totals for each block, and a row (block -1) with its sums over all words."""
    block, dev, part = (group.column(c).to_pylist() for c in ("block", "dev", "part"))
    asked = [unpack(x.as_py()) for x in group.column("data")]
    out: list[dict[str, np.ndarray]] = [{"check": x["check"]} for x in asked]
    sums = (0, 0, 0, 0)
    for k, n in (("k1", "n1"), ("k2", "n2")):
        keys = [unsqueeze(x[k]) for x in asked]
        distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.concatenate([x[n] for x in asked]).astype(np.int64)
        of_dev = np.repeat(np.array(dev, bool), [len(x) for x in keys])
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, index, count)
        held = np.zeros(len(distinct), np.int64)
        np.add.at(held, index[of_dev], count[of_dev])
        at = 0
        for i, x in enumerate(keys):
            here = index[at : at + len(x)]
            out[i][f"all{k[1]}"] = narrow(total[here])
            out[i][f"dev{k[1]}"] = narrow(held[here])
            at += len(x)
        if k == "k1":
            word = distinct != BEGIN
            kept = total - held
            sums = (int((total[word] > 0).sum()), int(total[word].sum()), int((kept[word] > 0).sum()), int(kept[word].sum()))
    rows = [pack(**x) for x in out]
    zero = [0] * len(rows)
    return pa.table(
        {"block": pa.array([*block, -1], pa.int64()), "dev": pa.array([*dev, False]), "part": pa.array([*part, part[0]], pa.int32()), "data": pa.array([*rows, b""], pa.binary())}
        | {c: pa.array([*zero, s], pa.int64()) for c, s in zip(("v", "n", "v_kept", "n_kept"), sums, strict=True)}
    )


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def restore(group: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """A block and its totals: words' all1 and dev1 by key, pairs' all2 and dev2 by position."""
    part = np.array(group.column("part").to_pylist())
    data = group.column("data")
    own = unpack(data[int(np.flatnonzero(part < 0)[0])].as_py())
    order = [int(i) for i in np.argsort(part) if part[i] >= 0]
    got = [unpack(data[i].as_py()) for i in order]
    totals = {k: np.concatenate([x[k] for x in got]).astype(np.int64) for k in ("all1", "dev1", "all2", "dev2")}
    own["keys"] = unsqueeze(own["keys"])
    block = Block()
    block.lens, block.all = own["lens"], own["keys"][own["index"]]
    distinct, index = np.unique(block.pairs(), return_inverse=True)
    at = [0, 0]
    for x in got:
        end = [at[0] + len(x["all1"]), at[1] + len(x["all2"])]
        if (check_of(own["keys"][at[0] : end[0]], distinct[at[1] : end[1]]) != x["check"]).any():
            raise RuntimeError("the totals are of another block: the input's rows came in another order")
        at = end
    if at != [len(own["keys"]), len(distinct)]:
        raise RuntimeError("totals are missing: the input's rows came in another order")
    for k in ("all2", "dev2"):
        totals[k] = totals[k][index]
    first = np.zeros(len(block.all), bool)
    first[np.cumsum(block.lens) - block.lens] = True
    own["word"], own["context"] = own["index"][~first], own["index"][np.flatnonzero(~first) - 1]
    return own, totals


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else by powers of two of its frequency."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def ratio_code(p: np.ndarray, uniform: float) -> np.ndarray:
    """0 for probability zero, else the rounded logarithm of the ratio to uniform, above 0."""
    with np.errstate(divide="ignore"):
        middle = 1 << CODE_BITS - 1
        return np.where(p > 0, np.clip(np.rint(np.log2(np.maximum(p, 1e-300) / uniform) * STEPS), 1 - middle, middle - 1).astype(np.int64) + middle, 0)


def dev_codes(v: int, n: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        own, got = restore(group)
        kept1, kept2 = got["all1"] - got["dev1"], got["all2"] - got["dev2"]
        context = kept1[own["context"]]
        two = ratio_code(kept2 / np.maximum(context, 1), 1 / (v + 1))
        one = ratio_code(kept1[own["word"]] / max(n, 1), 1 / (v + 1))
        codes, times = np.unique(bucket(context) << 2 * CODE_BITS | two << CODE_BITS | one, return_counts=True)
        return pa.table({"code": pa.array(codes, pa.int64()), "times": pa.array(times, pa.int64())})

    return run


def learn(codes: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of (pair, word, uniform) for each bucket by expectation-maximisation, from one pseudo-count each."""
    at = codes >> 2 * CODE_BITS
    p = np.ones((len(codes), 3))
    for i, shift in ((0, CODE_BITS), (1, 0)):
        c = codes >> shift & (1 << CODE_BITS) - 1
        p[:, i] = np.where(c > 0, 2.0 ** ((c - (1 << CODE_BITS - 1)) / STEPS), 0)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[at] * p
        share *= (times / share.sum(1))[:, None]
        new = np.ones((BUCKETS, 3))
        np.add.at(new, at, share)
        weights = new / new.sum(1, keepdims=True)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scorer(v: int, n: int, weights: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        own, got = restore(group)
        count, context = got["all1"][own["word"]], got["all1"][own["context"]]
        w = weights[bucket(context)]
        p = w[:, 0] * got["all2"] / np.maximum(context, 1) + w[:, 1] * count / max(n, 1) + w[:, 2] / (v + 1)
        at = np.cumsum(own["lens"] - 1) - (own["lens"] - 1)
        add = lambda x: np.add.reduceat(x, at)  # noqa: E731  no document is without tokens
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        ids = pa.array(own["ids"], pa.int64(), mask=own["null"])
        columns = (ids, own["held"], own["lens"] - 1, add((count > 0).astype(np.int64)), np.full(len(at), n, np.int64), add(base), add(np.log10(p)))
        return pa.table(dict(zip((x.split()[0] for x in _SCORE.split(", ")), map(pa.array, columns), strict=True)))

    return run


def replayable(docs: DataFrame) -> DataFrame:
    """doc_id and text in an order that a task run anew finds again: a scan's, or that of a checkpoint where rows were exchanged."""
    rows = docs.select("doc_id", "text")
    return materialize(rows) if "Exchange" in rows._jdf.queryExecution().executedPlan().toString() else rows


def scores(docs: DataFrame, figures: dict | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Logarithms are to base 10. A null text is the end token alone; repeated rows
    count and are scored each. A null doc_id trains. Without training documents
    all words are unknown; an empty table gives no rows. Texts of any length are
    taken whole; other columns are ignored. figures gets the weights, and the
    number of distinct and of all training tokens.
    """
    spark = docs.sparkSession
    docs = replayable(docs)
    splits = docs.rdd.getNumPartitions()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * splits)
    asked = blocks(docs, parts, None, True).repartition(parts, "part")
    answers = materialize(asked.groupBy("part").applyInArrow(answer, _ANSWER))
    v, n, v_kept, n_kept = (x or 0 for x in answers.where("block = -1").agg(*[F.sum(c) for c in ("v", "n", "v_kept", "n_kept")]).first())
    columns = ["block", "part", "data"]
    dev = blocks(docs, parts, True, False).select(columns).unionByName(answers.where("block >= 0 and dev").select(columns))
    codes = dev.groupBy("block").applyInArrow(dev_codes(v_kept, n_kept), "code long, times long").groupBy("code").agg(F.sum("times").alias("times"))
    # a table of rounded ratios, not of documents: some ten thousand codes, which the range of ratios bounds
    found = codes.toPandas()
    weights = learn(found["code"].to_numpy(np.int64), found["times"].to_numpy(np.int64))
    if figures is not None:
        figures.update(weights=weights, distinct=v, tokens=n)
    rows = blocks(docs, parts, None, False).select(columns).unionByName(answers.where("block >= 0").select(columns))
    return rows.groupBy("block").applyInArrow(scorer(v, n, weights), _SCORE)
