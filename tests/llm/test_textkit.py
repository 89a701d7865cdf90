import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tamarack.llm import textkit as tk

KINDS = [(tk.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (tk.NONSPACE, r"[^\x20\x09-\x0D]+")]


@pytest.mark.parametrize(("inside", "pattern"), KINDS)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aB1 .\n\té", max_size=30)), max_size=8))
def test_words_like_the_pattern(inside, pattern, texts):
    column = pa.array([None, *texts, "x"], pa.string()).slice(1, len(texts))
    got = []
    for lo, hi, data, offs in tk.blocks(column, 20):
        low, s, e, h, at = tk.words(data, offs, inside)
        own = [low[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        assert tk.hash_words(own).tolist() == h.tolist()
        got += [own[at[k] : at[k + 1]] for k in range(hi - lo)]
    lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    assert got == [[w.encode() for w in re.findall(pattern, t)] for t in lower]


@pytest.mark.parametrize("n", range(8))
def test_shingles_of_few_words(n):
    h = tk.randoms(n, 1)
    assert len(tk.shingles(h, 5)) == n
    assert tk.shingles(np.concatenate([h, h]), 3)[: max(0, n - 2)].tolist() == tk.shingles(h, 3)[: max(0, n - 2)].tolist()
