"""Toxicity scores: FTRL-proximal logistic regression over hashed word
n-grams and skip-grams.

Features of a whole text: the set of its hashed word 1-, 2- and 3-grams and
of its skip-grams (two words with one or two words between). Training walks
once over a bounded sample of labelled rows, in a fixed order, with
per-coordinate learning rates; the L1 term keeps almost all of the 2**20
coordinates at exactly zero, so the weights that the scoring tasks get are
small. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import textbytes as B

#: log2 of the number of coordinates.
HASH_BITS = 20
#: Most labelled rows that the model learns from (those with the least id hash).
MAX_TRAIN_ROWS = 16_000
#: Least rows of either label that the sums are rescaled on.
LEAST_EACH = 30
NGRAMS = (1, 2, 3)
SKIPS = (2, 3)


@dataclass(frozen=True)
class Rates:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0


@dataclass(frozen=True)
class Model:
    """Nonzero coordinates and their weights, sorted; the constant term."""
    index: np.ndarray
    weight: np.ndarray
    constant: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << HASH_BITS, np.float32)
        w[self.index] = self.weight
        return w


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    """Coordinate of each hashed feature; kinds don't share hashes."""
    return (B.mix(h + np.uint64(kind * 0x51ED270B + 1)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def features(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, coordinate) arrays, one pair for each kind of feature; repeats
    included."""
    low = B.LOWER[data]
    s, e, row = B.runs(B.WORD[low], starts)
    h = B.hashes(low, s, e) if len(s) else np.empty(0, np.uint64)
    yield row, _slots(h, 0)
    gram = h
    for n in NGRAMS[1:]:
        if len(h) < n:
            return
        gram = B.mix(gram[:-1] * np.uint64(3)) + h[n - 1:]
        same = row[n - 1:] == row[: 1 - n]
        yield row[n - 1:][same], _slots(gram[same], n)
    for gap in SKIPS:
        if len(h) <= gap:
            return
        same = row[gap:] == row[:-gap]
        pair = B.mix(h[:-gap] * np.uint64(5)) + h[gap:]
        yield row[gap:][same], _slots(pair[same], 16 + gap)


def train(examples: Iterator[tuple[np.ndarray, int]], rates: Rates = Rates()) -> Model:
    """One FTRL-proximal walk over (distinct coordinates, label) pairs.

    Shrunk weights give timid probabilities, so the sums are rescaled by a
    logistic fit to the sums that the second half of the walk saw before it
    learned from each label.
    """
    seen: list[tuple[float, int]] = []
    size = (1 << HASH_BITS) + 1  # the last coordinate is the constant
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = (np.sign(zi) * rates.l1 - zi) / ((rates.beta + np.sqrt(n[i])) / rates.alpha + rates.l2)
        w[np.abs(zi) <= rates.l1] = 0.0
        return w

    for index, label in examples:
        i = np.append(index, size - 1)
        w = weights(i)
        total = float(w.sum())
        seen.append((total, label))
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        g = p - label
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rates.alpha
        z[i] += g - sigma * w
        n[i] += g * g
    every = np.arange(size)
    w = weights(every)
    index = np.flatnonzero(w[:-1]).astype(np.int32)
    scale, shift = _calibrated(np.array(seen[len(seen) // 2:], np.float64).reshape(-1, 2))
    return Model(index, (scale * w[index]).astype(np.float32), float(scale * w[-1] + shift))


def _calibrated(seen: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of the sums that make their logistic probabilities fit
    the labels; unchanged where either label is rare."""
    total, label = np.clip(seen[:, 0], -35, 35), seen[:, 1]
    if min(label.sum(), len(label) - label.sum()) < LEAST_EACH:
        return 1.0, 0.0
    x, w = np.stack([total, np.ones(len(total))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (label - q) - (w - [1.0, 0.0])
        hess = (x * (q * (1 - q))[:, None]).T @ x + np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -1, 1)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    for b in batches:
        labels = b.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, starts in B.pieces(b.column(0)):
            parts = [(x, np.searchsorted(r, np.arange(hi - lo + 1))) for r, x in features(data, starts)]
            for k in range(hi - lo):
                yield np.unique(np.concatenate([x[at[k]: at[k + 1]] for x, at in parts])), int(labels[lo + k])


def _train_batches(rates: Rates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = train(_examples(batches), rates)
        index = np.append(m.index.astype(np.int64), -1)
        weight = np.append(m.weight.astype(np.float64), m.constant)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(weight)], names=["index", "weight"])
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", train_on: Column | None = None, rates: Rates = Rates(),
        max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from the labelled rows.

    ``labels`` has the id and a 0/1 label; null labels are ignored and an id
    with several labels takes the largest. At most ``max_rows`` ids, those
    with the least hash, are used. No labels at all: a model that scores
    everything alike (0.5).
    """
    kept = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if train_on is not None:
        kept = kept.where(train_on)
    sample = (kept.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
              .withColumn("_order", F.xxhash64(F.col(id_col))).orderBy("_order", id_col).limit(max_rows))
    # At most max_rows small rows: safe to broadcast.
    rows = (docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), id_col)
            .select("_text", "_label", "_order").repartition(1).sortWithinPartitions("_order", "_text"))
    found = rows.select("_text", "_label").mapInArrow(B.lean(_train_batches(rates)), "index long, weight double").toArrow()
    index, weight = found["index"].to_numpy(), found["weight"].to_numpy()
    if not len(index):
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), 0.0)
    return Model(index[:-1].astype(np.int32), weight[:-1].astype(np.float32), float(weight[-1]))


def scores(column: pa.Array, dense: np.ndarray, constant: float) -> np.ndarray:
    """Score of each text of an Arrow column."""
    out = np.full(len(column), constant)
    for lo, hi, data, starts in B.pieces(column):
        keys = []
        for row, slot in features(data, starts):
            w = np.flatnonzero(dense[slot])
            keys.append(row[w].astype(np.int64) << HASH_BITS | slot[w])
        key = np.unique(np.concatenate(keys))
        out[lo:hi] += np.bincount(key >> HASH_BITS, dense[key & ((1 << HASH_BITS) - 1)], hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for b in batches:
            got = scores(b.column(b.num_columns - 1), dense, model.constant)
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(got)], names=b.schema.names[:-1] + ["score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)``, one row per row of ``docs``; score is between 0 and 1,
    higher where a label 1 is likelier.

    Null, blank and wordless texts get the model's constant. Ids may be null
    or repeat. Other columns are ignored. An empty table gives an empty table.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", kept.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(B.lean(_score_batches(model)), schema)
