import numpy as np
import pytest

from tamarack.llm import textkit as tk
from tamarack.llm.tables import Table


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_finds_what_it_holds(n):
    keys = np.sort(tk.randoms(n, 3))
    t = Table(keys, np.arange(n, dtype=float))
    others = tk.randoms(500, 4)
    assert t.find(keys).tolist() == list(range(n)) and (t.find(others) == -1).all()
    found, value = t.get(np.concatenate([others[:3], keys[:5]]))
    assert found.tolist() == [False] * 3 + [True] * min(n, 5) and value[3:].tolist() == list(range(min(n, 5)))
