import random
import re

from pyspark.sql import functions as F

from stayspark.llm import decontaminate as D


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    got |= wins[tuple(w[k:k + n])]
        names = sorted(str(x) for x in got if x is not None)
        out.append((i, len(w), len(hit), len(names), names, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables():
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice(["the", "of", "Aé", "b2", "É", "zz", "Q"]) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(rnd.choice([1, 2, 3, 5, 9]))) for k in range(12)] + [(50, None), (51, "..."), (None, "b2 b2"), (3, "zz of the Q"), (7, "the")]
    docs = [(k, text(rnd.choice([0, 1, 4, 30, 200]))) for k in range(60)]
    docs += [(90, None), (91, ""), (92, "!!"), (93, " ,"), (None, "the of"), (None, "the of"), (5, "zz of the Q zz of the Q"), (94, "x " * 3000 + "b2 b2")]
    docs += [(95, items[3][1]), (96, "É é Ünï q" * 3), (97, "Q" * 9000)]
    return docs, items


def collected(spark, docs, items, size):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, row int").withColumn("id", F.lit("clash")).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = D.contamination(d, b, size).collect()
    return sorted(((r.id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in out), key=str), d, b


def test_matches_brute_force(spark, monkeypatch):
    docs, items = tables()
    for size in (1, 2, 4):
        assert collected(spark, docs, items, size)[0] == brute(docs, items, size)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)  # joins by shuffle
    got, d, b = collected(spark, docs, items, 4)
    assert got == brute(docs, items, 4)


def test_keeps_clean_rows(spark):
    docs, items = tables()
    items = [x for x in items if len(words(x[1])) > 3]
    _, d, b = collected(spark, docs, items, 13)
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    bad = {(i, t) for (i, t) in docs for r in [brute([(i, t)], items, 13)[0]] if r[-1]}
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in docs if (i, t) not in bad)
    assert D.decontaminate(d, b.where("false")).count() == len(docs)
    assert D.decontaminate(d.where("false"), b).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 9 + "beta gamma"), (4, "alpha beta")],
                                 "doc_id long, text string")
    found, _ = D.windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    index = D.build_index(docs, found.select(F.explode("words").alias("term")))
    ids = lambda m: {r.id for r in m.join(index.rows, "row").select("id").collect()}
    assert ids(D.proximity_matches(index, found, 0)) == {2}
    assert ids(D.proximity_matches(index, found, 3)) == {1, 2}
    assert ids(D.phrase_matches(index, found)) == set()
