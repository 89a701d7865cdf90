import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import suffix_dedup as sd

DOCS = "doc_id long, text string"


def brute(rows, n=sd.LENGTH):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k : k + n] for r in raw for k in range(len(r) - n + 1))
    out = []
    for (i, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - n + 1):
            if seen[r[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in sd.digests(df).collect())


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([tuple(r) for r in docs.collect()])


def passages(seed):
    draw = random.Random(seed)
    make = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    shared = [make(n) for n in (150, 199, 200, 201, 260, 500, 900)]
    rows = []
    for k in range(60):
        text = make(draw.randrange(300))
        for _ in range(draw.randrange(4)):
            p = draw.choice(shared)
            a = draw.randrange(len(p) // 3)
            text += p[a : a + draw.randrange(150, 900)] + make(draw.randrange(50))
        rows.append((k, text))
    return rows


@pytest.mark.parametrize(("seed", "shard", "group"), [(1, 2 << 20, 1 << 20), (2, 900, 1 << 20), (3, 3000, 2000), (4, 500, 600), (5, 1 << 20, 1)])
def test_passages(spark, monkeypatch, seed, shard, group):
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    monkeypatch.setattr(sd, "GROUP_BYTES", group)
    rows = passages(seed)
    assert got(spark.createDataFrame(rows, DOCS).repartition(3)) == brute(rows)


def test_one_line_between_varied_neighbours(spark, monkeypatch):
    """A line in every text makes one anchor's spans a large group; it is split, and only true repeats go."""
    monkeypatch.setattr(sd, "GROUP_BYTES", 20_000)
    draw = random.Random(8)
    make = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    line, long_line = make(90), make(230)
    rows = [(k, make(250) + (line if k % 3 else long_line) + make(250)) for k in range(300)]
    rows += [(300 + k, rows[k * 7][1][:500]) for k in range(20)]
    assert got(spark.createDataFrame(rows, DOCS).repartition(3)) == brute(rows)


def test_merge_across_shards():
    """Each half of the spans in a shard of its own, or all in one: the counts are the same."""
    draw = random.Random(3)
    parts = ["".join(draw.choice("ab") for _ in range(60)) for _ in range(5)]
    spans = [("".join(draw.choice(parts) for _ in range(3))).encode() for _ in range(40)]
    whole = sd.Shard(spans, np.ones(40), 100)
    for cuts in ([0, 20, 40], [0, 7, 8, 30, 40]):
        shards = [sd.Shard(spans[a:b], np.ones(b - a), 100) for a, b in zip(cuts, cuts[1:], strict=False)]
        sd.merge([(s, list(range(len(s.sizes)))) for s in shards])
        got = [s.repeated(k).tolist() for s in shards for k in range(len(s.sizes))]
        assert got == [whole.repeated(k).tolist() for k in range(40)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201), (6, "ab" * 300), (None, "q" * 50 + "é" * 200), (7, "é" * 100), (7, "é" * 99), (8, "\x00" * 250), (9, "same " * 60), (9, "same " * 60), (10, "w" * 30_000)]
    assert got(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_empty_and_extra_columns(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
    rows = [(1, "k" * 250, 3)]
    assert got(spark.createDataFrame(rows, DOCS + ", covers int")) == brute([r[:2] for r in rows])


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=120))
def test_suffix_array_and_common_prefixes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    sa, rank = sd.suffix_array(raw, 256)
    assert sa.tolist() == sorted(range(len(text)), key=lambda k: text[k:]) and (rank[sa] == np.arange(len(raw))).all()
    share = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    want = [0] + [min(9, share(text[a:], text[b:])) for a, b in zip(sa, sa[1:], strict=False)]
    cut = len(text) // 2
    for starts, sizes in (([0], [len(text)]), ([0, cut], [cut, len(text) - cut])):
        assert sd.common_prefixes(raw, sa, 9, np.array(starts), np.array(sizes)).tolist() == want


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(1)
    data = draw.integers(97, 100, 3000).astype(np.uint8)
    data[2000:2600] = data[100:700]
    r = sd.runs(data, np.array([0, 3000]))
    of = {int(f + k): int(a) for f, n, a in zip(r["first"], r["n"], r["anchor"], strict=True) for k in range(n)}
    assert len(of) == 2801 and all(of[100 + k] == of[2000 + k] for k in range(401))
