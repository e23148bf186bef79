"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of 64 bits link at a Hamming distance of DISTANCE or less. The bits
are cut into SEGMENTS consecutive segments on a ring. If two fingerprints link,
there is a segment from which every chain of 1, 2, ... segments differs in at
most (chain length) * DISTANCE / SEGMENTS bits; otherwise one could add up
chains around the ring and exceed DISTANCE. Chains whose budget is below one bit
must be equal, so they serve as join keys; the longer chains prune the pairs
that share a key before the full Hamming check.

Only distinct fingerprints take part. A key that very many of them share is not
compared pair by pair: its fingerprints are keyed again on the same ring rule
over the bits that the key leaves open, level by level, until the open bits
bound what one key can hold. So nothing is capped and no bucket grows without
bound. Buckets return trees of links, not all pairs.

Links by a similarity of shingle sets are exact, too: fingerprints only find the
likeliest pairs first. Whatever those leave apart is found by prefixes: alike
sets share one of their first shingles in any one order, rare ones first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import LOWER, map_texts, materialize, slices
from .components import connected_components

DISTANCE = 2
SEGMENTS = 5
SHINGLE = 3
SEED = 42
#: A key with more fingerprints than this is keyed anew on its open bits.
BUCKET = 512
#: Text classes of 8 bytes up to which they are sent to every task.
BROADCAST = 1_000_000
#: Links of alike texts up to which one task goes through their components: the rounds of more cost a hundred shuffles.
FEW = 500_000
#: Tasks over which the fingerprints of one component are dealt.
SALTS = 32
#: Rows sampled for the order of shingles, and the most shingles that the order tells apart by their number.
SAMPLE, FREQUENT = 10_000, 100_000
#: Rounding allowed for where bounds are compared; only makes candidates more.
SLACK = 1e-6
_STEP = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: each is set when over half the shingles' hashes set it; 0 for no words."""
    if not text:
        return 0
    ws = text.encode("utf-8", "replace").translate(LOWER).split()
    if not ws:
        return 0
    shingles = map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False)) if len(ws) >= shingle else [b" ".join(ws)]
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), _STEP):
        bits = np.unpackbits(h[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed 64-bit number."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, make, "fp long")


def ring(bits: tuple[int, ...], segments: int) -> list[tuple[int, ...]]:
    """The bit positions dealt to consecutive segments of nearly equal length."""
    cut = [len(bits) * i // segments for i in range(segments + 1)]
    return [bits[cut[i] : cut[i + 1]] for i in range(segments)]


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def keys_of(bits: tuple[int, ...], segments: int, distance: int) -> list[int]:
    """Masks of the chains that a linked pair shares one of: as long as their budget is below one bit."""
    length = next(n for n in range(segments, 0, -1) if n * distance < segments)
    parts = ring(bits, segments)
    return [mask_of(b for k in range(length) for b in parts[(i + k) % segments]) for i in range(segments)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def levels(distance: int = DISTANCE, segments: int = SEGMENTS, depth: int = 3) -> list[dict[int, list[int]]]:
    """For each level, the masks that a mask of the level before is refined to."""
    out: list[dict[int, list[int]]] = []
    now = [0]
    for _ in range(depth):
        step = {m: [m | k for k in keys_of(tuple(b for b in range(64) if not m >> b & 1), segments, distance)] for m in now}
        out.append(step)
        now = [m for ms in step.values() for m in ms]
    return out


def chains_hold(diff: np.ndarray, masks: list[int], distance: int) -> np.ndarray:
    """Whether from some segment all chains of differing bits stay within their proportional budgets."""
    boxes = [np.bitwise_count(diff & np.uint64(m)) for m in masks]
    n = len(boxes)
    found = np.zeros(diff.shape, bool)
    for i in range(n):
        total = np.zeros(diff.shape, np.uint8)
        good = np.ones(diff.shape, bool)
        for length in range(1, n + 1):
            total = total + boxes[(i + length - 1) % n]
            good &= total.astype(np.int64) * n <= length * distance
        found |= good
    return found


def bucket_links(fps: np.ndarray, distance: int = DISTANCE, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """A forest of links that connects exactly what the links within the bucket connect.

    Memory is that of one block of rows against the bucket.
    """
    n = len(fps)
    if n < 2:
        return []
    masks = [mask_of(p) for p in ring(tuple(range(64)), segments)]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    step = max(1, (1 << 20) // n)
    for lo in range(0, n, step):
        diff = fps[lo : lo + step, None] ^ fps[None, :]
        i, j = np.nonzero(chains_hold(diff, masks, distance))
        bits = np.bitwise_count(diff[i, j])
        near = np.flatnonzero((i + lo < j) & (bits <= distance))
        # the nearest first, so that the forest's links are the likeliest to hold
        near = near[np.argsort(bits[near], kind="stable")]
        for a, b in zip((i[near] + lo).tolist(), j[near].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[rb] = ra
                out.append((a, b))
    return out


def _links(distance: int, segments: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by (mask, part); a bucket may go on in the next batch."""
        rest = np.zeros((3, 0), np.int64)
        for batch in batches:
            now = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            change = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            last = change[-1] if len(change) else 0
            rest = now[:, last:]
            yield from emit(now[:, :last], change[:-1])
        yield from emit(rest, np.zeros(0, np.int64))

    def emit(now: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        edges = [0, *change.tolist(), now.shape[1]]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo > 1:
                fps = now[2, lo:hi]
                for i, j in bucket_links(fps.view(np.uint64), distance, segments):
                    a.append(fps[i])
                    b.append(fps[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def keyed(fps: DataFrame, step: dict[int, list[int]]) -> DataFrame:
    """(mask, part, fp) from (mask, fp): each fingerprint under every finer mask."""
    finer = F.create_map(*[x for m, ms in step.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)) for k in ms]))])
    out = fps.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
    return out.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("part"), "fp")


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within the distance do.

    fps: one column fp of distinct fingerprints.
    """
    steps = levels(distance, segments)
    found = None
    now = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    for i, step in enumerate(steps):
        rows = keyed(now, step)
        sizes = rows.groupBy("mask", "part").count()
        if i + 1 < len(steps):
            crowded = materialize(sizes.where(F.col("count") > bucket).select("mask", "part"))
            here = rows.join(sizes.where((F.col("count") > 1) & (F.col("count") <= bucket)).select("mask", "part"), ["mask", "part"], "left_semi")
        else:
            crowded = None
            here = rows
        pairs = here.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(_links(distance, segments), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None or crowded.isEmpty():
            break
        now = materialize(rows.join(crowded, ["mask", "part"], "left_semi").select("mask", "fp"))
    return found


def groups(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, component_id) of each fingerprint; root is the component's least fingerprint."""
    of_doc = materialize(fingerprints(docs, shingle))
    distinct = materialize(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return of_doc, named(distinct, links(distinct.select("fp"), distance, segments, bucket))


def named(distinct: DataFrame, found: DataFrame, few: int = 0) -> DataFrame:
    """(fp, root, component_id) of each row of distinct (fp, least) by the links found."""
    roots = materialize(connected_components(found, few=few).withColumnRenamed("node", "fp"))
    ids = roots.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    # a component of very many fingerprints meets its id in SALTS tasks
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = roots.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(ids, ["root", "salt"]).select("fp", "root", "component_id")
    out = distinct.join(linked, "fp", "left")
    return out.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    component_id is the least doc_id reachable over links, the row's own
    included. Null and blank texts have fingerprint zero and link like others.
    Repeated rows each get a row. Rows with a null doc_id take part; they get
    the least id of their component, null if it has none. Texts of any length
    are taken whole. An empty table gives no rows. Other columns, whatever their
    names, are ignored.
    """
    of_doc, about = groups(docs, distance, segments, bucket, shingle)
    return of_doc.join(about, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def normal(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []


def text_class(text: str | None) -> int:
    """A signed 64-bit hash of the word sequence: texts that differ in case or white space alone are one class."""
    return signed(xxh64_intdigest(b" ".join(normal(text)), SEED))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles; fewer words: that of the whole sequence; none: empty."""
    ws = normal(text)
    if not ws:
        return np.zeros(0, np.int64)
    shingles = map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False)) if len(ws) >= shingle else [b" ".join(ws)]
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)).view(np.int64)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, s) from (node, text)."""
    schema = pa.schema([("node", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = pa.array([shingle_set(t, shingle) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], schema=schema)

    return texts.mapInArrow(run, "node long, s array<long>")


def least_common(size: int, similarity: float) -> int:
    """The least number of shingles that a set of so many shares with any set so alike."""
    return math.ceil(similarity * size - SLACK)


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of common, so many that alike sets share one of theirs.

    A set shares least_common of its shingles or more, so not all of those can
    lie behind the prefix; the first shared one, in one order for all sets, lies in both.
    """
    if not len(s):
        return s
    values, counts = common
    rank = np.zeros(len(s), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        rank = np.where(values[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))][: len(s) - least_common(len(s), similarity) + 1]


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, of two or more texts in a sample of about SAMPLE rows, and in how many; the FREQUENT first ones.

    They only decide an order, so that prefixes hold rare shingles; any sample gives the same links.
    """
    share = max(1, docs.count() // SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)

    def make():
        return lambda texts: {"node": [text_class(t) for t in texts], "s": [shingle_set(t, shingle) for t in texts]}

    # keys and sets in one pass: of two in a row each holds a Python worker, and all four of an executor's then stay and take turns
    one = map_texts(rows, make, "node long, s array<long>").dropDuplicates(["node"])
    found = one.select(F.explode("s").alias("s")).groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow()
    values, counts = (c.to_numpy().astype(np.int64) for c in found.columns)
    order = np.argsort(values)
    return values[order], counts[order]


def fitting(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles with a first shared one at places at and bt can be so alike: a matrix."""
    need = similarity / (1 + similarity) * (n[:, None] + m[None, :]) - SLACK
    left = np.minimum((n - at)[:, None], (m - bt)[None, :])
    return (left >= need) & (np.minimum(n[:, None], m[None, :]) >= similarity * np.maximum(n[:, None], m[None, :]) - SLACK)


def fitting_pairs(n: np.ndarray, at: np.ndarray, root: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index pairs of a bucket that fit and differ in root, block by block; the largest root's rows are not met by each other."""
    roots, where, sizes = np.unique(root, return_inverse=True, return_counts=True)
    if len(roots) < 2:
        return
    inside = where == np.argmax(sizes)
    most, rest = np.flatnonzero(inside), np.flatnonzero(~inside)
    step = max(1, (1 << 20) // len(rest))
    for rows, square in ((most, False), (rest, True)):
        for lo in range(0, len(rows), step):
            i = rows[lo : lo + step]
            good = fitting(n[i], at[i], n[rest], at[rest], similarity) & (root[i][:, None] != root[rest][None, :])
            if square:
                good &= i[:, None] < rest[None, :]
            x, y = np.nonzero(good)
            yield i[x], rest[y]


def buckets(work: Callable[..., Iterator[list[np.ndarray]]], names: list[str]):
    """A function of Arrow batches sorted by their first column that gives work(rows of one value) one after another.

    Rows are a matrix with a line for each column of 64-bit numbers; other columns follow as Arrow arrays. Output is gathered to batches of _STEP.
    """
    schema = pa.schema([(n, pa.int64()) for n in names])

    def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)

    def joined(held: list[tuple[np.ndarray, list[pa.Array]]]) -> tuple[np.ndarray, list[pa.Array]]:
        return held[0] if len(held) == 1 else (np.concatenate([h for h, _ in held], axis=1), [pa.concat_arrays(c) for c in zip(*(m for _, m in held), strict=True)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        held: list[tuple[np.ndarray, list[pa.Array]]] = []
        for batch in batches:
            plain = [pa.types.is_int64(c.type) for c in batch.columns]
            now = np.stack([c.to_numpy(zero_copy_only=False) for c, p in zip(batch.columns, plain, strict=True) if p])
            more = [c for c, p in zip(batch.columns, plain, strict=True) if not p]
            edges = [0, *(np.flatnonzero(np.diff(now[0])) + 1).tolist(), now.shape[1]]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    if held and held[0][0][0, 0] != now[0, lo]:
                        yield joined(held)
                        held = []
                    held.append((now[:, lo:hi], [c.slice(lo, hi - lo) for c in more]))
        if held:
            yield joined(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        size = 0
        for rows, more in whole(batches):
            if rows.shape[1] > 1:
                for found in work(rows, *more):
                    if len(found[0]):
                        parts.append(found)
                        size += len(found[0])
                    if size >= _STEP:
                        yield out(parts)
                        parts, size = [], 0
        if parts:
            yield out(parts)

    return run


def by_bucket(rows: DataFrame, work: Callable[..., Iterator[list[np.ndarray]]], names: list[str]) -> DataFrame:
    key = rows.columns[0]
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(buckets(work, names), ", ".join(f"{n} long" for n in names))


def shared(distinct: DataFrame, similarity: float) -> DataFrame:
    """(s, at, n, fp): each prefix shingle of two or more classes, of n shingles, that can be alike; at is its place."""

    def work(rows: np.ndarray) -> Iterator[list[np.ndarray]]:
        if rows.shape[1] > BUCKET:
            yield list(rows)
            return
        _, at, n, _ = rows
        good = fitting(n, at, n, at, similarity)
        np.fill_diagonal(good, False)
        yield list(rows[:, good.any(axis=1)])

    rows = distinct.select(F.posexplode("prefix").alias("at", "s"), "n", "fp")
    return by_bucket(rows.select("s", F.col("at").cast("long").alias("at"), "n", "fp"), work, ["s", "at", "n", "fp"])


def neighbours(rows: DataFrame, similarity: float) -> DataFrame:
    """(x, y): in each bucket of shared() the classes that follow each other, by number and by size."""

    def work(rows: np.ndarray) -> Iterator[list[np.ndarray]]:
        _, at, n, fp = rows
        for order in (np.argsort(fp), np.lexsort((fp, n))):
            i, j = order[:-1], order[1:]
            good = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - SLACK
            good &= np.minimum(n[i] - at[i], n[j] - at[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - SLACK
            yield [np.minimum(fp[i], fp[j])[good], np.maximum(fp[i], fp[j])[good]]

    return by_bucket(rows, work, ["x", "y"])


def sketch(s: np.ndarray) -> bytes:
    """For each of a power of two of bits, four to eight a shingle, whether an odd number of shingles fall on it."""
    size = max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount(s & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A number of bits that no more differ in than shingles lie in just one of the two sets.

    The larger sketch is folded upon itself, which gives the set's sketch of half the size.
    """
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_differ(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """The most shingles that lie in just one of two so alike sets of n and m."""
    return (1 - similarity) / (1 + similarity) * (n + m) + SLACK


def across(rows: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """(x, y), each once: in the buckets of (s, at, n, fp, root) all classes of different roots that sizes, places and sketches let be alike.

    A pair is looked at in the bucket of its first shared shingle alone. Each
    row brings its sketch and the shingles before its place, where its bucket
    has more than one root.
    """

    def work(rows: np.ndarray, before: pa.Array, sketches: pa.Array) -> Iterator[list[np.ndarray]]:
        _, at, n, fp, root = rows
        sets: list[set[int]] = []
        for i, j in fitting_pairs(n, at, root, similarity):
            if len(i) and not sets:
                sets = [set(v) for v in before.to_pylist()]
                bits = sketches.to_pylist()
            for lo in range(0, len(i), _STEP):
                x, y = i[lo : lo + _STEP], j[lo : lo + _STEP]
                most = may_differ(n[x], n[y], similarity)
                good = [sets[a].isdisjoint(sets[b]) and differing(bits[a], bits[b]) <= m for a, b, m in zip(x.tolist(), y.tolist(), most.tolist(), strict=True)]
                x, y = x[good], y[good]
                yield [np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y])]

    several = rows.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("s")
    rows = rows.join(several, "s", "left_semi").join(distinct.select("fp", "prefix", "sketch"), "fp")
    rows = rows.select("s", "at", "n", "fp", "root", F.slice("prefix", F.lit(1), F.col("at").cast("int")).alias("before"), "sketch")
    return by_bucket(rows, work, ["x", "y"])


def possible(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) whose sketches don't rule the similarity out: no alike pair goes."""
    one, two = (distinct.select(F.col("fp").alias(k), F.col("n").alias("n" + k), F.col("sketch").alias("s" + k)) for k in "xy")
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            most = may_differ(b.column(2).to_numpy(), b.column(3).to_numpy(), similarity)
            bits = [differing(u, v) for u, v in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            good = pa.array(np.array(bits) <= most)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], schema=schema)

    return pairs.join(one, "x").join(two, "y").select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(run, "x long, y long")


def sets_of(ends: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, s): the shingle sets of the text classes in ends (node); only their texts have them made and moved."""
    ends = materialize(ends.distinct())
    if ends.count() <= BROADCAST:
        ends = F.broadcast(ends)
    texts = with_key(docs.select(F.col("text").cast("string").alias("text")), "node", text_class)
    one = texts.join(ends, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    return materialize(shingle_sets(one.select("node", "text"), shingle))


def held(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) of text classes with a Jaccard similarity of their shingle sets of at least so much."""
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("s").alias("s")), "x").join(sets.select(F.col("node").alias("y"), F.col("s").alias("t")), "y")
    common = F.size(F.array_intersect("s", "t"))
    return both.where(common >= similarity * (F.size("s") + F.size("t") - common)).select("x", "y")


def alike(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """As held(), with the sets of the texts in docs."""
    return held(pairs, sets_of(ends_of(pairs), docs, shingle), similarity)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node")))


def similar_groups(docs: DataFrame, similarity: float, verify: int, distance: int, segments: int, bucket: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """As groups(), of text classes in place of fingerprints; two link exactly where the classes' shingles are so alike.

    First the likeliest pairs are held to the similarity: the links between
    fingerprints, each by its least class, a fingerprint's other classes with its
    least, and neighbours in the buckets of prefix shingles. What these connect is
    not compared again. Then all other pairs that share a prefix shingle, and can
    be alike by their sizes and its places, are: no alike pair is without one. Of
    both, pairs that sketches rule out need no sets.
    """
    common = frequent(docs, verify)

    def make():
        def work(texts: list) -> dict[str, list]:
            sets = [shingle_set(t, verify) for t in texts]
            return {
                "sim": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64),
                "fp": [text_class(t) for t in texts],
                "n": [len(s) for s in sets],
                "prefix": [prefix(s, common, similarity) for s in sets],
                "sketch": [sketch(s) for s in sets],
            }

        return work

    about = materialize(map_texts(docs, make, "sim long, fp long, n long, prefix array<long>, sketch binary"))
    distinct = materialize(about.groupBy("fp").agg(F.min("sim").alias("sim"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")))
    rows = materialize(shared(distinct, similarity))

    centres = materialize(distinct.groupBy("sim").agg(F.min("fp").alias("centre"), F.count("*").alias("n")))
    near = links(centres.select(F.col("sim").alias("fp")), distance, segments, bucket).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = near.join(centres.select(F.col("sim").alias("a"), F.col("centre").alias("x")), "a").join(centres.select(F.col("sim").alias("b"), F.col("centre").alias("y")), "b")
    same = distinct.join(centres.where("n > 1").select("sim", "centre"), "sim").where("fp <> centre").select(F.col("fp").alias("x"), F.col("centre").alias("y"))
    first = near.select("x", "y").unionByName(same).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    first = materialize(first.unionByName(neighbours(rows, similarity)).distinct())

    found = materialize(alike(materialize(possible(first, distinct, similarity)), docs, similarity, verify))
    roots = materialize(connected_components(found, few=FEW).select(F.col("node").alias("fp"), "root"))
    rooted = rows.join(roots, "fp", "left").select("s", "at", "n", "fp", F.coalesce("root", "fp").alias("root"))
    rest = materialize(across(rooted, distinct, similarity).join(first, ["x", "y"], "left_anti"))
    if not rest.isEmpty():
        found = materialize(found.unionByName(alike(rest, docs, similarity, verify)))
    return about.select("doc_id", "fp"), named(distinct.select("fp", "least"), found, FEW)


def with_key(docs: DataFrame, name: str, key: Callable[[str | None], int]) -> DataFrame:
    """The rows with all their columns and the signed 64-bit key of their texts."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = pa.array([key(t) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(
    docs: DataFrame,
    distance: int = DISTANCE,
    segments: int = SEGMENTS,
    bucket: int = BUCKET,
    shingle: int = SHINGLE,
    similarity: float | None = None,
    verify: int = 5,
) -> DataFrame:
    """One row of each component, with all its columns: that of the least doc_id.

    Of rows that repeat that doc_id, and of a component none of whose rows has
    one, the row of the least key and text hash stays. With a similarity, texts
    link exactly where their sets of shingles of verify words have at least that
    Jaccard similarity, whatever the fingerprints; equal word sequences always are one.
    """
    if similarity is None:
        of_doc, about = groups(docs, distance, segments, bucket, shingle)
        key = lambda text: signed(fingerprint(text, shingle))
    else:
        of_doc, about = similar_groups(docs, similarity, verify, distance, segments, bucket, shingle)
        key = text_class
    about = materialize(about)
    least = of_doc.join(about, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialize(least.groupBy(F.col("doc_id").alias("_id")).agg((F.count("*") > 1).alias("_again")))
    plain = kept.where("_id IS NOT NULL AND NOT _again").select("_id")
    out = docs.join(plain, docs["doc_id"].cast("long") == plain["_id"], "left_semi")
    unclear = kept.where("_id IS NULL OR _again").select("_id")
    if unclear.isEmpty():
        return out
    rows = with_key(docs.join(unclear, docs["doc_id"].cast("long").eqNullSafe(unclear["_id"]), "left_semi"), "_key", key)
    ids = about.select(F.col("fp").alias("_key"), F.col("root").alias("_root"), F.col("component_id").alias("_component"))
    rows = rows.join(ids, "_key").where(F.col("doc_id").cast("long").eqNullSafe(F.col("_component")))
    first = rows.groupBy("_root").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct("_key", F.xxhash64("text"))).alias("_row"))
    return out.unionByName(first.select("_row.*"))
