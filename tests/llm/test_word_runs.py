import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stayspark.llm import word_runs


def brute(words):
    """Every run by definition: maximal stretches for each period, smallest
    period only."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            piece = words[i: i + length]
            if length >= max(6, 4 * q) and not any(all(piece[x] == piece[x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def in_memory(words):
    codes = np.unique(np.array(words, dtype=str), return_inverse=True)[1].astype(np.int32)
    _, q, lo, hi = word_runs.fragments(codes, np.array([0, len(codes)]))
    return sorted(((int(a), int(z - a + p), int(p)) for p, a, z in zip(q, lo, hi) if z - a + p >= max(6, 4 * p)), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 7)), max_size=8))
def test_fragments_of_repeats(parts):
    words = list("".join(p * n for p, n in parts))
    assert in_memory(words) == brute(words) if words else True


def thue_morse(n):
    return [str(bin(i).count("1") % 2) for i in range(n)]


def texts():
    rnd = random.Random(7)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "b " * 500, "a b " * 4, "a b " * 3 + "a", "é ß é ß é ß é ß é ß", "a\tb\x0bc\x0ca\nb\rc a b c a b c a",
           " ".join(thue_morse(300)), "x y " * 7, " ".join(thue_morse(40) * 5)]
    for _ in range(40):
        words = [rnd.choice("abcd") for _ in range(rnd.randrange(60))]
        p = rnd.randrange(1, 20)
        base = [rnd.choice("abc") for _ in range(p)]
        words += (base * 12)[: rnd.randrange(1, 8 * p + 1)] + [rnd.choice("ab") for _ in range(rnd.randrange(40))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("long", [1 << 17, 12, 40])
def test_matches_brute_force(spark, long):
    """With a small ``long`` documents are exploded into rows of tiles."""
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "q q q q q q q"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(0), "row": F.lit(1), "runs": F.lit("x")}).repartition(3)
    out = word_runs.find_runs(df, long=long)
    assert out.columns == ["id", "n_words", "runs", "collapsed"]
    got = sorted((str(r.id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        words = [w.decode() for w in words]
        runs = brute(words)
        want.append((str(i), len(words), runs, collapsed(words, runs)))
    assert got == sorted(want)


def test_empty_table(spark):
    assert word_runs.find_runs(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_long_periods_cross_tiles():
    rnd = random.Random(3)
    base = [str(rnd.randrange(10 ** 6)) for _ in range(333)]
    words = ["z", "y"] + base * 5 + ["z"]
    assert in_memory(words) == [(2, 5 * 333, 333)]


def test_planted(spark):
    import zlib

    from stayspark.llm.queries import planted
    rows = [(i, " ".join(f"w{x}" for x in range(i % 23))) for i in range(120)] + [(None, "a b"), (7, None), (8, "")]
    want = []
    for i, t in rows:
        words = (t or "").split()
        h, n = (zlib.crc32(str(i).encode()) if i is not None else 1), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        want.append((str(i), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(str(r.doc_id), " ".join((r.t or "").split())) for r in df.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("t")).collect()]
    assert sorted(got) == sorted(want)
