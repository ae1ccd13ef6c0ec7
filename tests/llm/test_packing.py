import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayspark.llm import packing as P, queries, textbytes as B

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
WORDS = P.WordTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAsStT'  \n.,19<|>éÉeJ̸̌́= ΣK", max_size=25),
                          st.sampled_from(["<|endoftext|> x", "a<|STARTOFTEXT|>", "It's DON'T 'Tis we'll", "<|startoftext|>"])), max_size=6))
def test_ids_are_the_tokenizers(texts):
    for lo, hi, data, starts in B.pieces(pa.array(texts, pa.string()), 40):
        ids, at = WORDS.texts(data, starts)
        for k in range(hi - lo):
            assert ids[at[k]: at[k + 1]].tolist() == TOK.encode(texts[lo + k] or "", add_special_tokens=False).ids


def check_plan(histogram, capacity):
    segments = P.plan(histogram, capacity)
    fill, taken = {}, Counter()
    by_length = {}
    for length, lo, each, seq, off in segments.tolist():
        by_length.setdefault(length, []).append((lo, each, seq, off))
    for length, count in histogram.items():
        own = sorted(by_length[length])
        for rank in range(count):
            lo, each, seq, off = [x for x in own if x[0] <= rank][-1]
            taken[length] += 1
            fill.setdefault(seq + (rank - lo) // each, []).append((off + (rank - lo) % each * length, length))
    assert taken == Counter(histogram)
    for parts in fill.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= capacity
    return len(fill)


def optimum(items, capacity):
    """Fewest bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {r for r in bins if r >= items[i]}:
            rest = list(bins)
            rest.remove(room)
            go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(items):
    """Fixed sets plus the best packing of the rest is a best packing."""
    left = P._Counts(Counter(items), 20)
    fixed = P.dominance_reduction(left, 20)
    rest = [s for s in range(21) for _ in range(int(left.n[s]))]
    for sizes, _ in fixed:
        assert sum(sizes) <= 20
    assert Counter(rest) + Counter(s for sizes, n in fixed for s in sizes * n) == Counter(items)
    assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == optimum(items, 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_is_a_packing(histogram):
    n = check_plan(histogram, 64)
    total = sum(k * v for k, v in histogram.items())
    assert n <= 1 + 2 * total // 64 + sum(v for k, v in histogram.items() if k > 32)


def verify(docs, rows, capacity):
    want = {}
    for i, t in docs:
        ids = TOK.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[a: a + capacity], "<u4")
            want.setdefault((i, p, a, len(cut), zlib.crc32(cut.tobytes())), []).append(1)
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == Counter({k: len(v) for k, v in want.items()})
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= capacity
    return len(fill), sum(k[3] * v for k, v in got.items())


def test_query(spark):
    rows = [r.asDict() for r in queries.QUERIES["op2_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    n, total = verify(docs, rows, 4096)
    assert n <= 1.03 * total / 4096 + 2


def test_odd_rows(spark):
    rnd = random.Random(1)
    docs = [(1, None), (2, ""), (2, ""), (None, "a b"), (None, "a b"), (4, " \n"), (5, "word " * 30_000), (6, "x" * 20_000)]
    docs += [(100 + i, " ".join("cat" for _ in range(rnd.randint(0, 40)))) for i in range(80)] + [(7, "same text")] * 30
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, length string").withColumn("id", F.lit(1)).repartition(5)
    out = P.pack_documents(df, PATH, 64, keep={"ids": F.col("ids"), "ids_crc32": F.crc32("ids")})
    rows = [{**r.asDict(), "doc_id": r.id} for r in out.collect()]
    verify(docs, rows, 64)
    seqs = {r.sequence_id: (r.length, len(bytes(r.ids))) for r in P.sequences(out).collect()}
    assert len(seqs) == len({r["sequence_id"] for r in rows}) and all(n * 4 == b and n <= 64 for n, b in seqs.values())
    assert P.pack_documents(df.where("false"), PATH).count() == 0
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 65)], "id long, length long"), ["id"], 64)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abSTß÷×ÿÿþÑñéªºİſKé̈'.5", min_size=1, max_size=9), max_size=20))
def test_words_at_once_have_the_tokenizers_ids(words):
    tok = P.WordTokenizer(PATH)
    units = [w.encode() for w in dict.fromkeys(words)]
    for u, ids in zip(units, tok.units(units), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == TOK.encode(u.decode(), add_special_tokens=False).ids


def test_simple_words_are_tokenised_many_at_once():
    tok = P.WordTokenizer(PATH)
    calls = []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **kw):
            calls.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **kw)
    tok.tokenizer, tok.words = Counted(tok.tokenizer), Counted(getattr(tok, "words", None))
    words = sorted({f"{a}{b}ñ{c}" for a in "abcdeF" for b in "stuvwx" for c in ("", "la", "ción", "OS", "ßt", "éé", "im", "z", "w", "k")})
    got = tok.units([w.encode() for w in words])
    assert [np.frombuffer(i, np.uint32).tolist() for i in got] == [e.ids for e in TOK.encode_batch(words, add_special_tokens=False)]
    assert len(calls) == -(-len(words) // P.WORDS_AT_ONCE)
