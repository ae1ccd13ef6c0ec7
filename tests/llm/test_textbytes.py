import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from stayspark.llm import textbytes as B


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ 9é.\n,", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    got, seen = [[] for _ in texts], {}
    for lo, hi, data, starts in B.pieces(pa.array(texts, pa.string()), limit):
        s, e, row = B.runs(B.WORD[data], starts)
        for a, b, r, h in zip(s, e, row, B.hashes(data, s, e)):
            word = bytes(data[a:b])
            got[lo + r].append(word)
            assert seen.setdefault(word, h) == h
    assert got == [re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode()) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_powers_are_inverse():
    up, down = B._power_tables(100)
    assert np.all(up * down == 1)
