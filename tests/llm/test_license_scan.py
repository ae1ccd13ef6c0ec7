import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stayspark.llm import license_scan as L

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def base(text):
    """The base fields by definition."""
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, x) for p, x in L.BASE_PHRASES.items() for i in range(len(words)) if words[i: i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), sorted({x for _, x in at})


def descend(tokens):
    """(restriction, labels) of an expression by recursive descent."""
    def either(i):
        r, x, i = both(i)
        while i < len(tokens) and tokens[i] == "OR":
            r2, y, i = both(i + 1)
            r, x = min(r, r2), x | y
        return r, x, i

    def both(i):
        r, x, i = one(i)
        while i < len(tokens) and tokens[i] == "AND":
            r2, y, i = one(i + 1)
            r, x = max(r, r2), x | y
        return r, x, i

    def one(i):
        if tokens[i] == "(":
            r, x, i = either(i + 1)
            return r, x, i + 1
        x = L.label_of(tokens[i])
        r = L.restriction_of(x)
        if tokens[i + 1: i + 2] == ["WITH"]:
            return r / 2, {f"{x} with {L.label_of(tokens[i + 2])}"}, i + 3
        return r, {x}, i + 1
    r, x, _ = either(0)
    return r, x


NAMES = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "AGPL-3.0-only", "CC-BY-NC-4.0", "LGPL-2.1+", "X-own"]
leaf = st.one_of(st.sampled_from(NAMES).map(lambda x: [x]), st.sampled_from(NAMES).map(lambda x: [x, "WITH", "Classpath-exception-2.0"]))
tree = st.recursive(leaf, lambda t: st.tuples(t, st.sampled_from(["AND", "OR"]), t, st.booleans()).map(
    lambda x: ["(", *x[0], x[1], *x[2], ")"] if x[3] else [*x[0], x[1], *x[2]]), max_leaves=9)


@settings(max_examples=200, deadline=None)
@given(tree)
def test_shunting_yard_against_descent(tokens):
    r, labels = L.evaluate(L.postfix(tokens))
    assert (r, set(labels)) == descend(tokens)
    assert L.tag_expression(" : " + " ".join(tokens) + " */ more") == tokens


@pytest.mark.parametrize("bad", [[], ["OR"], ["MIT", "MIT"], ["(", "MIT"], ["MIT", ")"], ["MIT", "AND"], ["(", ")"]])
def test_not_an_expression(bad):
    assert not L.postfix(bad) if bad else L.postfix(bad) is None


def test_labels():
    assert [L.label_of(x) for x in ("Apache-2.0", "GPL-2.0-only", "CC-BY-SA-4.0", "MPL-2.0", "LGPL-2.1-or-later")] == ["apache-2", "gpl-2", "cc-by-sa", "mpl-2", "lgpl-2.1"]
    assert L.evaluate(L.postfix("MIT or ( GPL-3.0 and Apache-2.0 )".split())) == (0.2, ("mit", "gpl-3", "apache-2"))
    assert L.evaluate(["mit", "gpl-3", "or", "x-exception", "with"]) is None


CASES = [
    ("Released under the MIT License.", "mit", 0.2),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", 0.7),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 0.9),
    ("Licensed under the Apache License, Version 2.0.", "apache-2", 0.2),
    ("licensed under either the MIT license or the GNU Affero General Public Licence, version 3, at your option", "agpl-3,mit", 0.2),
    ("released under GPL v2 or any later version with Classpath exception", "gpl-2", 0.7),
    ("distributed under GPL v2 with classpath exception and MIT", "gpl-2 with classpath-exception,mit", 0.35),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-NC-4.0\nint x;", "apache-2,cc-by-nc,mit", 0.9),
    ("SPDX-License-Identifier GPL-3.0", "", 0.0),
    ("SPDX-License-Identifier: AND", "", 0.0),
    ("the license is good. mit is a school; an apache helicopter; gpl", "", 0.0),
    ("MIT License\n\nAll rights reserved", "all-rights-reserved,mit", 1.0),
    ("x" * 9000 + " License-Identifier: ISC " + "y" * 9000, "isc", 0.2),
]


def test_scan(spark):
    rnd = random.Random(2)
    vocabulary = "under the mit license apache License version 2 cc by nc CC é\xa0x \x85 3".split(" ")
    texts = [c[0] for c in CASES] + [None, "", "...", "under the mit", "É under—the mit license", "under_the.MIT\nlicense/under the MIT license cc-by-nc-nc by nc"]
    texts += ["".join(rnd.choice(vocabulary) + rnd.choice([" ", "-", "\n", ", "]) for _ in range(rnd.randrange(40))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "cc by nc"), (1, "cc by nc"), (1, "cc by nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "score": F.lit("x")}).repartition(3)
    out = L.scan(df)
    got = out.collect()
    assert sorted((str(r.id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted((str(i), *base(t)) for i, t in rows)
    assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and r.labels == sorted(set(r.labels)) for r in got)
    by_id = {r.id: r for r in got if r.id is not None and r.id != 1}
    for i, (text, labels, score) in enumerate(CASES):
        if i != 1:
            assert (",".join(by_id[i].labels), by_id[i].score) == (labels, score), text


def test_small_pieces_and_empty(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE_BYTES", 30)
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id long, text string")
    assert {r.id: ",".join(r.labels) for r in L.scan(df).collect()} == {i: c[1] for i, c in enumerate(CASES)}
    assert L.scan(df.where("false")).collect() == []
