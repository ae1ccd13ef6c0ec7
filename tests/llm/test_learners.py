"""The two learners against plain Python: FTRL-proximal on 200 rows, cyclic
boosting on 150, coordinate by coordinate and bin by bin."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from stayspark.llm import quality, toxicity

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def texts(n, seed):
    rnd = random.Random(seed)
    calm, rude = "the day was fine and we walked by an old river".split(), "you utter fool go away Ähm now".split()
    out = []
    for i in range(n):
        y = int(rnd.random() < 0.4)
        words = [rnd.choice(calm + (rude * 2 if y else [])) for _ in range(rnd.randrange(0, 25))]
        out.append((rnd.choice([" ", ", ", "\n"]).join(words), y))
    return out


def grams(text):
    """The features of a text, by name."""
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text))
    found = {(n, *w[i: i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    return found | {("skip", gap, w[i], w[i + gap]) for gap in (2, 3) for i in range(len(w) - gap)}


def examples(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([y for _, y in rows])], ["t", "y"])
    return list(toxicity._examples([batch]))


def test_features_are_the_distinct_grams():
    rows = texts(60, 1) + [("", 0), ("one", 1), ("a b c d", 0)]
    for (coordinates, y), (text, label) in zip(examples(rows), rows):
        assert y == label and len(coordinates) == len(grams(text))  # 2**20 places: no clash among so few
    places = set().union(*(c.tolist() for c, _ in examples(rows)))
    names = set().union(*(grams(t) for t, _ in rows))
    # k names in 2**20 places share k^2 / 2**21 of them on average: about one here
    assert 0 <= len(names) - len(places) <= 5
    assert [c.tolist() for c, _ in examples(rows)] == [c.tolist() for c, _ in examples([(t.upper() if t.isascii() else t, y) for t, y in rows])]


@pytest.mark.parametrize("rates", [toxicity.Rates(), toxicity.Rates(alpha=0.3, beta=0.5, l1=0.2, l2=2.0)])
def test_ftrl_against_plain_python(rates):
    rows = examples(texts(200, 2))
    z, n, sums = {}, {}, []
    last = 1 << toxicity.HASH_BITS

    def weight(i):
        if abs(z.get(i, 0.0)) <= rates.l1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return (sign * rates.l1 - z[i]) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

    for coordinates, y in rows:
        index = [*coordinates.tolist(), last]
        w = {i: weight(i) for i in index}
        total = sum(w.values())
        sums.append((total, y))
        g = 1 / (1 + math.exp(-total)) - y
        for i in index:
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / rates.alpha * w[i]
            n[i] = old + g * g
    scale, shift = toxicity._calibrated(np.array(sums[100:]))
    want = {i: scale * weight(i) for i in z if i != last and weight(i) != 0.0}
    model = toxicity.train(iter(rows), rates)
    got = dict(zip(model.index.tolist(), model.weight.tolist()))
    assert got.keys() == want.keys() and (len(want) > 3)
    assert all(got[i] == pytest.approx(want[i], rel=1e-5) for i in want)
    assert model.constant == pytest.approx(scale * weight(last) + shift, rel=1e-9)


def plain_cut(g, h):
    best = (0.0, 0)
    for k in range(1, len(g)):
        a, b, c, d = sum(g[:k]), sum(h[:k]), sum(g[k:]), sum(h[k:])
        if b > 1 and d > 1:
            gain = a * a / (b + 1) + c * c / (d + 1) - sum(g) ** 2 / (sum(h) + 1)
            if gain > max(best[0] + 1e-12, 1e-9):
                best = (gain, k)
    return best


def plain_tree(g, h):
    spans = [(0, len(g))]
    while len(spans) < 4:
        gain, k, a, b = max((*plain_cut(g[a:b], h[a:b]), a, b) for a, b in spans)
        if gain <= 0:
            break
        spans.remove((a, b))
        spans += [(a, a + k), (a + k, b)]
    out = [0.0] * len(g)
    for a, b in spans:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + 1)] * (b - a)
    return out


def test_boosting_against_plain_python(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 6)
    monkeypatch.setattr(quality, "BINS", 7)
    monkeypatch.setattr(quality, "PAIR_BINS", 4)
    monkeypatch.setattr(quality, "PAIRS", 2)
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(150, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) | (rnd.random(150) < 0.1)).astype(float)
    m = quality.boost(x, y)
    p = (y.sum() + 1) / 152
    f = [math.log(p / (1 - p))] * 150
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 8)[1:-1])) for j in range(3)]
    bins = [[sum(e <= v for e in edges[j]) for v in x[:, j]] for j in range(3)]
    tables = [[0.0] * (len(e) + 1) for e in edges]

    def gradients(cells, size):
        g, h = [0.0] * size, [0.0] * size
        for i, c in enumerate(cells):
            q = 1 / (1 + math.exp(-f[i]))
            g[c] += y[i] - q
            h[c] += q * (1 - q)
        return g, h

    for _ in range(6):
        for j in range(3):
            step = [quality.RATE * v for v in plain_tree(*gradients(bins[j], len(tables[j])))]
            tables[j] = [a + b for a, b in zip(tables[j], step)]
            f = [v + step[c] for v, c in zip(f, bins[j])]
    for got, want in zip(m.tables, tables):
        assert got == pytest.approx(want, abs=1e-9)
    # pairs: two of the three, and what they add lowers the loss
    assert len(m.pairs) == 2 and set(m.pairs) <= set(combinations(range(3), 2)) and (0, 1) in m.pairs
    loss = lambda v: float(np.mean(np.log1p(np.exp(np.where(y > 0, -1, 1) * v))))
    assert loss(m.logits(x)) < loss(np.array(f)) < loss(np.full(150, m.constant))
    alone = quality.Model(m.constant, m.edges, m.tables)
    assert alone.logits(x) == pytest.approx(f, abs=1e-9)
    for row in (0, 7, 99):
        added = sum(t[np.searchsorted(m.pair_edges[a], x[row, a], side="right"), np.searchsorted(m.pair_edges[b], x[row, b], side="right")]
                    for (a, b), t in zip(m.pairs, m.pair_tables))
        assert m.logits(x)[row] == pytest.approx(f[row] + added, abs=1e-9)
