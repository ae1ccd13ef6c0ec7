"""Quality scores: a generalised additive model with pairwise interactions.

A text's surface features (lengths, shares of kinds of characters, repeats)
are cut into at most ``BINS`` bins each. Cyclic boosting: every round walks
over the features in turn and fits one shallow tree on that feature's bins to
the current gradient; trees of a feature add up to one lookup table. Then the
pairs with the greatest gain get a two-dimensional table, boosted the same
way. Scoring reads the tables: a sum of bin values per text, in numpy, in one
pass without a shuffle. Learning takes a bounded sample of labelled rows;
only their features (a few numbers a row) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import textbytes as B

#: Most labelled rows that the model learns from (those with the least id hash).
MAX_TRAIN_ROWS = 16_000
BINS = 48
PAIR_BINS = 12
PAIRS = 6
ROUNDS = 60
RATE = 0.15

FEATURES = ("log_bytes", "log_words", "word_length", "upper_share", "lower_share", "digit_share", "symbol_share",
            "stop_share", "bang_share", "bar_share", "wide_share", "space_share", "line_length", "distinct_words",
            "repeated_lines", "upper_words", "symbol_words", "sentence_length")

_UPPER, _LOWER_, _DIGIT = B.byte_set((65, 90)), B.byte_set((97, 122)), B.byte_set((48, 57))
_STOP = B.byte_set((46, 46), (44, 44), (63, 63))
_BANG, _BAR = B.byte_set((33, 33)), B.byte_set((124, 124))
_WIDE = B.byte_set((128, 255))
_SYMBOL = B.byte_set((33, 47), (58, 64), (91, 96), (123, 126)) & ~_STOP


def _per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum over each row's bytes."""
    total = np.empty(len(values) + 1, np.int64)
    total[0] = 0
    np.cumsum(values, out=total[1:])
    return (total[starts[1:]] - total[starts[:-1]]).astype(np.float64)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return np.bincount(r[new], minlength=n).astype(np.float64)


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; null texts are empty."""
    out = np.zeros((len(column), len(FEATURES)))
    for lo, hi, data, starts in B.pieces(column):
        n = hi - lo
        size = np.diff(starts).astype(np.float64)
        some = np.maximum(size, 1)
        share = {k: _per_row(t[data], starts) / some for k, t in (
            ("upper", _UPPER), ("lower", _LOWER_), ("digit", _DIGIT), ("symbol", _SYMBOL), ("stop", _STOP),
            ("bang", _BANG), ("bar", _BAR), ("wide", _WIDE), ("space", B.SPACE))}
        s, e, row = B.runs(~B.SPACE[data], starts)
        words = np.bincount(row, minlength=n).astype(np.float64)
        has = np.maximum(words, 1)
        ends = _per_row(B.byte_set((46, 46), (33, 33), (63, 63))[data], starts)
        ls, le, lrow = B.runs(data != 10, starts)
        lines = np.bincount(lrow, minlength=n).astype(np.float64)
        if len(s):
            # Two 32-bit halves of word and line hashes serve for counting distinct ones.
            distinct = _distinct(row, B.hashes(data, s, e) >> np.uint64(20), n)
            same_lines = lines - _distinct(lrow, B.hashes(data, ls, le), n)
            upper_w = np.bincount(row, _UPPER[data[s]] & _UPPER[data[np.minimum(s + 1, len(data) - 1)]], n)
            symbol_w = np.bincount(row, _SYMBOL[data[e - 1]], n)
        else:
            distinct = same_lines = upper_w = symbol_w = np.zeros(n)
        cols = (np.log1p(size), np.log1p(words), (size * (1 - share["space"])) / has, share["upper"], share["lower"],
                share["digit"], share["symbol"], share["stop"], share["bang"], share["bar"], share["wide"],
                share["space"], size / np.maximum(lines, 1), distinct / has, same_lines / np.maximum(lines, 1),
                upper_w / has, symbol_w / has, words / (1 + ends))
        out[lo:hi] = np.stack(cols, axis=1)
    return out


# --- model ------------------------------------------------------------------

@dataclass
class Model:
    """Bin edges and a table of added scores for each feature and pair."""
    constant: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.constant)
        if not self.tables:
            return out
        for j, (edge, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edge, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"),
                         np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    ok = (hl > 1) & (ht - hl > 1)
    gain = np.where(ok, gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1), 0.0)
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Value of each bin from a tree of at most ``leaves`` leaves."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in spans]
        gain, k, a, b = max(cuts)
        if gain <= 0:
            break
        spans.remove((a, b))
        spans += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A cut on one feature, then one on the other in each half; its gain."""
    best, gain_of = np.zeros_like(g), 0.0
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        _, k = _best_cut(gg.sum(axis=1), hh.sum(axis=1))
        for first in {k, gg.shape[0] // 2} - {0}:
            table = np.zeros_like(gg)
            gain = 0.0
            for rows in (slice(0, first), slice(first, None)):
                gr, hr = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                _, c = _best_cut(gr, hr)
                for cols in (slice(0, c), slice(c, None)) if c else (slice(None),):
                    table[rows, cols] = gr[cols].sum() / (hr[cols].sum() + 1)
                    gain += gr[cols].sum() ** 2 / (hr[cols].sum() + 1)
            if gain > gain_of:
                best, gain_of = (table.T if turned else table), gain
    return best, gain_of


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the tables to rows of features and 0/1 labels."""
    if len(y) == 0:
        return Model()
    p = (y.sum() + 1) / (len(y) + 2)
    m = Model(constant=float(np.log(p / (1 - p))))
    n = x.shape[1]
    m.edges = [_edges(x[:, j], BINS) for j in range(n)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    f = np.full(len(y), m.constant)

    def sums(index, size):
        q = _sigmoid(f)
        return np.bincount(index, y - q, size), np.bincount(index, q * (1 - q), size)

    for _ in range(ROUNDS):
        for j in range(n):
            step = RATE * _shallow_tree(*sums(at[j], len(m.tables[j])))
            m.tables[j] += step
            f += step[at[j]]
    m.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(n)]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.pair_edges)]
    wide = [len(e) + 1 for e in m.pair_edges]

    def grid(a, b):
        g, h = sums(low[a] * wide[b] + low[b], wide[a] * wide[b])
        return g.reshape(wide[a], wide[b]), h.reshape(wide[a], wide[b])

    ranked = sorted(combinations(range(n), 2), key=lambda ab: -_pair_tree(*grid(*ab))[1])
    m.pairs = ranked[:PAIRS]
    m.pair_tables = [np.zeros((wide[a], wide[b])) for a, b in m.pairs]
    for _ in range(ROUNDS // 3):
        for k, (a, b) in enumerate(m.pairs):
            step = RATE * _pair_tree(*grid(a, b))[0]
            m.pair_tables[k] += step
            f += step[low[a], low[b]]
    return m


# --- operator ---------------------------------------------------------------

def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b.column(b.num_columns - 1))
        cols = b.columns[:-1] + [pa.array(list(x), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1] + ["features"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", train_on: Column | None = None, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from the labelled rows.

    ``labels`` has the id and a 0/1 label; null labels are ignored and an id
    with several labels takes the least. At most ``max_rows`` ids, those with
    the least hash, are used; their features are collected (``max_rows`` rows
    of some numbers). No labels: a model that scores everything alike.
    """
    kept = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if train_on is not None:
        kept = kept.where(train_on)
    sample = (kept.groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
              .withColumn("_order", F.xxhash64(F.col(id_col))).orderBy("_order", id_col).limit(max_rows))
    # At most max_rows small rows: safe to broadcast.
    rows = (docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), id_col)
            .select("_order", F.xxhash64("_text").alias("_key"), "_label", "_text"))
    # A repeated id counts once (the text with the least hash).
    found = (rows.mapInArrow(B.lean(_feature_batches), "_order long, _key long, _label int, features array<double>")
             .groupBy("_order").agg(F.min(F.struct("_key", "_label", "features")).alias("r"))
             .select("_order", "r._label", "r.features").orderBy("_order").toArrow())
    x = np.array(found["features"].to_pylist(), np.float64).reshape(len(found), len(FEATURES))
    return boost(x, found["_label"].to_numpy().astype(np.float64))


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _sigmoid(model.logits(features(b.column(b.num_columns - 1))))
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(got)], names=b.schema.names[:-1] + ["score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)``, one row per row of ``docs``; score is between 0 and 1,
    higher where a label 1 is likelier.

    Null and blank texts are scored by their (all zero) features. Ids may be
    null or repeat. Other columns are ignored. An empty table gives an empty
    table.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", kept.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(B.lean(_score_batches(model)), schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that score at least ``threshold``."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.get_field_index(text_col) if at is None else at
            text = b.column(at).cast(pa.large_string())
            yield b.filter(pa.array(_sigmoid(model.logits(features(text))) >= threshold))

    return docs.mapInArrow(B.lean(run), fields)
