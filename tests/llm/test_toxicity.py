import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import textkit as tk
from tamarack.llm import toxicity as tx

TEXTS = [
    ("good day good day sunny", 0), ("good day sunny sunny window", 0), ("a sunny window and a good window", 0), ("goodness and goodwill", 0),
    ("vile day vile rot vilest", 1), ("vilest rot and vile rot", 1), ("a vile sunny day", 1), ("good good vileness vilerunnerlongerthantwelve", 1), ("vilerunnerlongerthantwelve and vile", 1),
]


def brute(texts, discount):
    """Log ratios of words, by themselves and after a word, straight from the definitions."""
    triples = collections.defaultdict(set)
    for text, label in texts:
        words = ["", "", *text.split()]
        for u, v, w in zip(words, words[1:], words[2:]):
            triples[v, w].add((label, u))
    pair = {k: [len({u for label, u in x if label == c}) for c in (0, 1)] for k, x in triples.items()}
    word = collections.defaultdict(lambda: [0, 0])
    for (_, w), n in pair.items():
        for c in (0, 1):
            word[w][c] += n[c] > 0
    symbols = lambda w: [w[k] for k in range(min(len(w), tx.DEPTH))] + [w[tx.DEPTH :] + "\n"]
    node = collections.defaultdict(lambda: [0, 0])
    for w, n in word.items():
        for k in range(len(symbols(w)) + 1):
            for c in (0, 1):
                node[tuple(symbols(w)[:k])][c] += n[c]
    below = collections.defaultdict(list)
    for x in node:
        if x:
            below[x[:-1]].append(x)

    def spell(w, c):
        log, x = 0.0, ()
        for k, b in enumerate(symbols(w)):
            y = (*x, b)
            both = sum(node[x]) if x in node else 0
            shared = ((sum(node[y]) if y in node else 0) + 1 / 257) / (both + 1)
            n = node[x][c] if x in node else 0
            own = max((node[y][c] if y in node else 0) - discount, 0)
            freed = n - sum(max(node[z][c] - discount, 0) for z in below[x])
            log += math.log((own + freed * shared) / n if n and k else shared)
            x = y
        return log

    def after(v, w, c):
        n = sum(p[c] for (a, _), p in pair.items() if a == v)
        kept = sum(max(p[c] - discount, 0) for (a, _), p in pair.items() if a == v)
        own = max(pair.get((v, w), [0, 0])[c] - discount, 0)
        return math.log((own + (n - kept) * math.exp(spell(w, c))) / n) if n else spell(w, c)

    return lambda w: spell(w, 1) - spell(w, 0), lambda v, w: after(v, w, 1) - after(v, w, 0)


@pytest.mark.parametrize("discount", [1.0, 2.0])
def test_probabilities_against_brute_force(spark, discount):
    texts = TEXTS + [(f"{a} {b} {c}", k % 2) for k in range(2) for a in ("sunny", "vile") for b in ("day", "rot") for c in ("good", "window", "vile")]
    made = tx.Estimates(tx.count(spark.createDataFrame(texts, "text string, label int")), discount)
    asked = [t for t, _ in texts] + ["vile vile newword good viler sunny day day vilerunnerlongerthantwelve vilerunnerlongerthanthirteen zzz v"]
    _, _, data, offs = next(tk.blocks(pa.array(asked)))
    x = tx.words_of(data, offs)
    alone, after = brute(texts, discount)
    words = [w for t in asked for w in t.split()]
    before = [v for t in asked for v in ["", *t.split()[:-1]]]
    assert np.allclose(made.ratios(x, False), [alone(w) for w in words], atol=1e-4)
    assert np.allclose(made.ratios(x, True), [after(v, w) for v, w in zip(before, words)], atol=1e-4)


def test_copies_count_once(spark):
    once = tx.Estimates(tx.count(spark.createDataFrame(TEXTS, "text string, label int")), 1.0)
    many = tx.Estimates(tx.count(spark.createDataFrame(TEXTS * 5, "text string, label int")), 1.0)
    assert np.array_equal(once.spelling.values, many.spelling.values) and np.array_equal(once.pairs.values, many.pairs.values)


def test_no_word_of_a_small_sample_is_left_out(spark):
    """Few labels: a marking word in a dozen toxic documents is enough, whatever floor a large table would bear."""
    docs = [(k, f"w{k % 17} x{k * 7 % 13} y{k % 5} " + ("blighter " if k % 8 == 1 else "") + f"z{k % 11}") for k in range(120)]
    labels = [(k, 1, int(k % 8 == 1)) for k in range(120)]
    got = {r.doc_id: r for r in tx.judged(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [k for k in range(120) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert [k for k in held if got[k].predicted] == [k for k in held if k % 8 == 1] != []


@pytest.mark.parametrize(("sf", "recall", "precision"), [("0.01", 0.5, 0.7), ("0.1", 0.85, 0.9)])
def test_held_out_documents(spark, sf, recall, precision):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.judged(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic)
    assert caught >= recall * sum(r.toxic for r in rows) and caught >= precision * sum(r.predicted for r in rows)
