"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and over how words begin and end is trained from
confirmed toxic documents and from documents whose labels are not looked at.
With the class prior p, the risk is

    p * mean(loss(+) of positives) + max(0, mean(loss(-) of unlabelled) - p * mean(loss(-) of positives))

so that unlabelled toxic text isn't learned as clean; where the second part
falls below zero, its gradient is turned round, which keeps a flexible model
from fitting it away. A feature's value is its share of a text's words, full
from one word in a hundred, so that what a long text holds by chance says
little. Only features whose shares differ clearly between the two samples take
part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, fsum
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, filter_rows, map_texts, slices

PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (4, 5, 6)
#: At most so many confirmed toxic and so many unlabelled documents are fitted on.
POSITIVES, UNLABELLED = 3000, 6000
#: Standard errors by which a feature's shares of the two samples differ at least, and sampled documents that have it.
LEAST_Z, LEAST_DOCS = 4.5, 5
#: Features that are rarer in toxic text say less, as most text lacks any one word; only the most telling are used.
MOST_FEATURES = 4000
#: A text counts as this many words at least, and a feature has its full value from one of so many words on.
FULL_WORDS = 100
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
CACHE_ENTRIES = 300_000
_EDGE = ".,;:!?\"'()[]{}#*$%&|<>-_/\\~+=@^`"


def features(word: str) -> list[int]:
    """Features of a word as 32-bit hashes: itself, how it begins, how it ends."""
    w = word.strip(_EDGE)
    if not w:
        return []
    out = [crc32(b"w" + w.encode("utf-8", "replace"))]
    out += [crc32(b"p" + w[:n].encode("utf-8", "replace")) for n in PREFIXES if n < len(w)]
    out += [crc32(b"s" + w[-n:].encode("utf-8", "replace")) for n in SUFFIXES if n < len(w)]
    return out


def counted_words(text: str | None) -> tuple[Counter, float]:
    """How often each word occurs, and the value that one word adds to its features."""
    ws = (text or "").lower().split()
    return Counter(ws), FULL_WORDS / max(len(ws), FULL_WORDS)


def features_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text, sorted, and their values from 0 to 1."""
    found, one = counted_words(text)
    at = [(f, n) for w, n in found.items() for f in features(w)]
    keys, index = np.unique(np.array([f for f, _ in at], np.uint32), return_inverse=True)
    sums = np.bincount(index, np.array([n for _, n in at], float), len(keys)) if len(keys) else np.zeros(0)
    return keys, np.minimum(1, sums * one).astype(np.float32)


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        """texts -> scores from 0 to 1; remembers which words tell something."""
        known: dict[str, tuple[int, ...]] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            words, one = counted_words(text)
            sums: dict[int, int] = {}
            for w, n in words.items():
                f = known.get(w)
                if f is None:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    f = known[w] = tuple(x for x in features(w) if x in weights)
                for x in f:
                    sums[x] = sums.get(x, 0) + n
            # fsum, so that the order of words makes no difference
            return 1 / (1 + exp(-max(-60.0, min(60.0, fsum([bias, *(weights[x] * min(1.0, n * one) for x, n in sums.items())])))))

        return lambda texts: [score(t) for t in texts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


Sample = list[tuple[np.ndarray, np.ndarray]]


def telling(positive: Sample, unlabelled: Sample, most: int = MOST_FEATURES, ranges: int = 16) -> np.ndarray:
    """The features whose mean values in the two samples differ clearly, sorted. One range of hashes is looked at after another, to bound memory."""
    n_p, n_u = len(positive), len(unlabelled)
    found: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    for i in range(ranges):
        bounds = np.array([(i << 32) // ranges, ((i + 1) << 32) // ranges])
        cuts = [np.searchsorted(k, bounds) for k, _ in positive + unlabelled]
        here = [(k[lo:hi], v[lo:hi]) for (k, v), (lo, hi) in zip(positive + unlabelled, cuts, strict=True)]
        keys, index = np.unique(np.concatenate([k for k, _ in here]), return_inverse=True)
        value = np.concatenate([v for _, v in here]).astype(float)
        cut = sum(len(k) for k, _ in here[:n_p])
        sums = [np.bincount(index[at], value[at], len(keys)) for at in (slice(None, cut), slice(cut, None))]
        mean = (sums[0] + sums[1]) / (n_p + n_u)
        spread = np.bincount(index, value**2, len(keys)) / (n_p + n_u) - mean**2 + 1e-6
        z = np.abs(sums[0] / n_p - sums[1] / n_u) / np.sqrt(spread * (1 / n_p + 1 / n_u))
        clear = np.flatnonzero((z >= LEAST_Z) & (np.bincount(index, minlength=len(keys)) >= LEAST_DOCS))
        found.append(keys[clear])
        scores.append(z[clear])
    keys = np.concatenate(found)
    return np.sort(keys[np.argsort(-np.concatenate(scores), kind="stable")[:most]])


def train(positive: Sample, unlabelled: Sample, prior: float, rounds: int = 400, rate: float = 0.05, penalty: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss.

    positive, unlabelled: sorted distinct features of each document and their
    values. Without positives or without unlabelled text all scores are 0.
    """
    if not positive or not unlabelled:
        return Model(-60.0)
    keys = telling(positive, unlabelled)
    docs = positive + unlabelled
    used = [np.isin(k, keys, assume_unique=True) for k, _ in docs]
    cols = np.concatenate([np.searchsorted(keys, k[u]) for (k, _), u in zip(docs, used, strict=True)]).astype(np.int64)
    value = np.concatenate([v[u] for (_, v), u in zip(docs, used, strict=True)]).astype(float)
    row = np.repeat(np.arange(len(docs)), [int(u.sum()) for u in used])
    is_p = np.arange(len(docs)) < len(positive)
    n_p, n_u = is_p.sum(), (~is_p).sum()
    w, b = np.zeros(len(keys)), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for t in range(1, rounds + 1):
        f = np.bincount(row, w[cols] * value, len(docs)) + b
        loss_minus = np.logaddexp(0, f)
        negative = loss_minus[~is_p].mean() - prior * loss_minus[is_p].mean()
        up = sigmoid(f)  # the derivative of loss(-)
        g = np.zeros(len(docs))
        if negative >= 0:
            g[is_p] = -prior / n_p  # of loss(+) less that of loss(-)
            g[~is_p] = up[~is_p] / n_u
        else:
            g[is_p] = prior * up[is_p] / n_p
            g[~is_p] = -up[~is_p] / n_u
        grad = np.append(np.bincount(cols, g[row] * value, len(keys)) + penalty * w, g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(float(b), dict(zip(keys.tolist(), w.tolist(), strict=True)))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, f, v): the distinct features of each text as unsigned 32-bit integers, and their values."""

    def work(texts: list) -> dict[str, list]:
        found = [features_of(t) for t in texts]
        return {"f": [k.tobytes() for k, _ in found], "v": [v.tobytes() for _, v in found]}

    return map_texts(docs, lambda: work, "f binary, v binary")


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from the documents outside the held-out fold.

    prior: the share of toxic documents; by default that among the labels of
    those folds. The sample is the bounded number of documents whose hashed
    doc_id is least, so it is the same each time.
    """
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(own & F.col("toxic").isNotNull())
    if prior is None:
        share = known.agg(F.avg("toxic")).first()[0]
        prior = float(np.clip(share if share is not None else 0.1, 1e-3, 0.5))
    first = lambda ids, n: [r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]  # noqa: E731  n ids at most
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    p_ids = first(known.where("toxic = 1").select("doc_id").distinct().join(ids, "doc_id", "left_semi"), positives)
    u_ids = first(ids.where(own), unlabelled)
    rows = spark.createDataFrame([(i, True) for i in p_ids] + [(i, False) for i in u_ids], "doc_id long, positive boolean").distinct()
    # at most positives + unlabelled rows
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows.select("doc_id").distinct()), "doc_id", "left_semi")
    p_set, u_set = set(p_ids), set(u_ids)
    p, u = [], []
    for r in featured(chosen).toLocalIterator():
        x = np.frombuffer(r["f"], np.uint32), np.frombuffer(r["v"], np.float32)
        if r["doc_id"] in p_set and len(p) < positives:
            p.append(x)
        if r["doc_id"] in u_set and len(u) < unlabelled:
            u.append(x)
    return train(p, u, prior)


COLUMNS = "held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    A null text scores as an empty one. Without labels, or without toxic ones,
    all scores are 0. Repeated rows each get a row; other columns are ignored.
    """
    model = fit(docs, labels, **options)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in slices(batches):
            ids = b.column(0)
            s = np.array(score(b.column(1).to_pylist()), float)
            held = [crc_of_id(i) % FOLDS == HELD_OUT for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    model = fit(docs, labels, **options)

    def make():
        score = model.scorer()
        return lambda texts: [s < threshold for s in score(texts)]

    return filter_rows(docs, make)
