import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from stayspark.llm import simhash


def brute(rows, words=4, max_bits=4):
    def print_of(text):
        import re
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not w:
            return 0
        sh = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fp = [print_of(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fp[i] ^ fp[j]).count("1") <= max_bits and comp[j] > comp[i]:
                    comp[j], changed = comp[i], True
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, i), i)
    return {(i, f, least[c]) for (i, _), f, c in zip(rows, fp, comp)}


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    rows = []
    for k in range(12):
        text = [rnd.choice(base) for _ in range(rnd.choice([1, 2, 3, 5, 200, 400]))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(text)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(base)
            rows.append((len(rows) + 7, rnd.choice([" ", "\n", "\t "]).join(copy).title()))
    rows += [(500, ""), (501, None), (3, " \n"), (502, "é É ÉA x"), (503, "é É ÉA x"), (504, "word " * 5000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == brute(rows)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {c for _, _, c in got}


def test_every_close_pair_meets():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, 400).astype(np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rnd.choice(64, rnd.integers(1, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    for blocks in (2, 3, 5):
        t = 4 // blocks
        a1, i1, h1 = simhash.replicas(x, blocks, t)
        a2, i2, _ = simhash.replicas(y, blocks, t)
        homes = {(a, i) for a, i, h in zip(a1.tolist(), i1.tolist(), h1.tolist()) if h}
        visits = set(zip(a2.tolist(), i2.tolist()))
        met = {i for _, i in homes & visits}
        assert met == set(range(len(x)))


def test_hot_anchor_is_split(spark, monkeypatch):
    fps = [(i,) for i in range(64)]
    df = spark.createDataFrame(fps, "fp long")
    whole = simhash.components(simhash.fingerprint_links(df)).collect()
    monkeypatch.setattr(simhash, "CELL", 5)
    split = simhash.components(simhash.fingerprint_links(df)).collect()
    assert set(whole) == set(split) and len(whole) == 63


def test_cells_that_span_batches():
    """One cell's rows come in batches of any size: homes first, then
    visitors; only homes are kept, no link is lost."""
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 1 << 63, 9, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << rnd.integers(0, 64, 9).astype(np.uint64)) for _ in range(40)]))
    cell = np.sort(rnd.integers(0, 4, len(fp)))
    home = np.arange(len(fp)) % 3 == 0
    order = np.lexsort((~home, cell))
    c, f, h = cell[order], fp[order], home[order]
    want = {frozenset((int(f[i]), int(f[j]))) for i in range(len(f)) for j in range(len(f))
            if h[j] and i != j and c[i] == c[j] and int(f[i] ^ f[j]).bit_count() <= 4}

    def groups(links):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in links:
            root[find(a)] = find(b)
        out = {}
        for x in list(root):
            out.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in out.values()}
    for size in (1, 7, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i: i + size]), pa.array(f[i: i + size].view(np.int64)), pa.array(h[i: i + size])], ["cell", "fp", "home"])
                   for i in range(0, len(c), size)]
        got = [(u % (1 << 64), v % (1 << 64)) for b in simhash._link_batches(4)(iter(batches)) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert groups(got) == groups(tuple(p) for p in want)


def test_large_component_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 3)
    for rows in (100_000, 0):
        monkeypatch.setattr(simhash, "HOT_ROWS", rows)
        classes = spark.createDataFrame([(i, 0 if i < 50 else i % 5 + 100) for i in range(80)], "fp long, root long")
        least = spark.createDataFrame([(0, 7, 50)] + [(r, r * 2, 6 if r < 104 else 2) for r in range(100, 105)], "root long, component_id long, members long")
        got = {(r.fp, r.component_id) for r in simhash._of_component(classes, least).collect()}
        assert got == {(i, 7 if i < 50 else (i % 5 + 100) * 2) for i in range(80)}


@pytest.mark.parametrize("listed", [0, 300_000])
def test_odd_tables(spark, monkeypatch, listed):
    monkeypatch.setattr(simhash, "LISTED_ROWS", listed)  # joins by shuffle, or broadcast
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e", 1), (None, "quite another text here", 2), (4, "a b c d e", 3), (4, "a b c d e", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").withColumn("id", __import__("pyspark").sql.functions.lit(0))
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "quite another text here"), (4, "a b c d e")]
    assert simhash.near_duplicates(df).count() == 4
