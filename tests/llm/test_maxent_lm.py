import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tamarack.llm import maxent_lm as lm
from tamarack.llm import textkit as tk

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def base(rows):
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return sorted((repr(i), held(i), len(split(t)), sum(w in c for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows)


def got(df, **options):
    return sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(df, **options).collect())


def near(a, b):
    return len(a) == len(b) and all(x[:-1] == y[:-1] and math.isclose(x[-1], y[-1], abs_tol=2e-5) for x, y in zip(a, b, strict=True))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    made = lm.score(docs).collect()
    assert near(sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in made), base(rows))
    for out in (True, False):
        some = [r for r in made if r.held_out == out]
        assert sum(r.score for r in some) > sum(r.base_score for r in some)
    joined = {r.doc_id: r for r in lm.score(docs, broadcast_words=0).collect()}
    assert all(math.isclose(joined[r.doc_id].score, r.score, rel_tol=1e-5) and math.isclose(joined[r.doc_id].base_score, r.base_score, rel_tol=1e-9) for r in made)


ODD = [(1, None), (2, ""), (None, "a B b"), (3, "a\x00b é\tÉ"), (3, "a\x00b é\tÉ"), (4, "w " * 30_000), (5, "a b c"), (9, "unseen words " * 3), (16, "never met")]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_odd_rows(spark, limit):
    df = spark.createDataFrame([(*r, 1.0) for r in ODD], DOCS + ", score double")
    assert near(got(df, broadcast_words=limit), base(ODD))
    assert lm.score(df.limit(0), broadcast_words=limit).collect() == []


def test_only_held_out_rows(spark):
    i = next(k for k in range(100) if held(k))
    assert near(got(spark.createDataFrame([(i, "a b")], DOCS)), base([(i, "a b")]))


def corpus(n=12):
    words = [f"w{k}" for k in range(900)]
    return [(i, " ".join(words[(i * 131 + j * j * 7) % 900] for j in range(250))) for i in range(n)]


def test_probabilities_sum_to_one(spark):
    """All known tokens and, in each slot outside the top, the room for one unseen."""
    scorer, counts = lm.fit(spark.createDataFrame(corpus(), DOCS))
    known = counts.collect()
    key = np.array([r.key for r in known], np.int64).view(np.uint64)
    kind, slot, outside = scorer.words.places(key, np.array([r.tail for r in known]))
    assert 0 < outside.sum() < len(known) and len(known) > lm.TOP
    n = np.array([r.n for r in known])
    for one, two in ((lm.START, lm.START), (key[3], lm.START), (key[200], key[-1])):
        context = lambda size: (np.full(size, x, np.uint64) for x in (one, two))  # noqa: E731, B023
        rows = scorer.weights.rows(*context(len(key)), kind)
        at = np.arange(len(key))
        p = np.exp(scorer.weights.classes(rows)[at, kind].astype(float) + scorer.weights.slots(rows, kind)[at, slot])
        p[outside] *= (n[outside] + 1) / 10 ** scorer.log_rest[kind[outside] - lm.TOP // lm.SLOTS, slot[outside]]
        low = np.arange(lm.TOP // lm.SLOTS, lm.CLASSES)
        rows = scorer.weights.rows(*context(len(low)), low)
        unseen = np.exp(scorer.weights.classes(rows)[np.arange(len(low)), low][:, None].astype(float) + scorer.weights.slots(rows, low)) / 10**scorer.log_rest
        first = int(np.ceil(min(len(known), lm.TOP) / lm.SLOTS))
        assert first * lm.SLOTS == lm.TOP and abs(p.sum() + unseen.sum() - 1) < 1e-3


def hashes(text):
    h, tail, _ = lm.tokens(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
    return [int(x) for x in h], tail.tolist()


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


class Plain:
    """The model token by token, straight from its definition."""

    def __init__(self, rows, scorer):
        self.w, self.words = scorer.weights, scorer.words
        self.count = Counter(h for i, t in rows if not held(i) for h in hashes(t)[0])
        self.tail = {h: c for _, t in rows for h, c in zip(*hashes(t))}
        self.place = {h: tuple(int(x[0]) for x in self.words.places(np.array([h], np.uint64), np.array([c]))) for h, c in self.tail.items()}
        self.rest = Counter()
        for h, n in self.count.items():
            if self.place[h][2]:
                self.rest[self.place[h][:2]] += n + 1

    def parts(self, text):
        """(rows, class, slot, class probabilities, slot probabilities, share) of every token."""
        h = hashes(text)[0]
        for k, token in enumerate(h):
            one, two = (h[k - j] if k >= j else int(lm.START) for j in (1, 2))
            kind, slot, outside = self.place[token]
            rows = {n: int(x[0]) for n, x in self.w.rows(np.array([one], np.uint64), np.array([two], np.uint64), np.array([kind])).items()}
            tables = self.w.tables
            p = softmax([float(self.w.bias[c] + sum(tables[n][rows[n], c] for n in ("one", "two", "both"))) for c in range(lm.CLASSES)])
            q = softmax([float(self.w.slot_bias[kind, c] + tables["slot"][rows["slot"], c]) for c in range(lm.SLOTS)])
            yield rows, kind, slot, p, q, (self.count[token] + 1) / (self.rest[kind, slot] + 1) if outside else 1.0

    def score(self, text):
        return sum(math.log10(p[kind] * q[slot] * share) for _, kind, slot, p, q, share in self.parts(text))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_scores_against_brute_force(spark, limit):
    rows = [*corpus(), *ODD[:4]]
    df = spark.createDataFrame(rows, DOCS)
    plain = Plain(rows, lm.fit(df)[0])
    made = sorted((repr(r.doc_id), r.score) for r in lm.score(df, broadcast_words=limit).collect())
    assert all(a == b and math.isclose(x, y, rel_tol=1e-4) for (a, x), (b, y) in zip(made, sorted((repr(i), plain.score(t)) for i, t in rows), strict=True))


def test_a_round_of_training_against_brute_force(spark):
    rows = [(i, t) for i, t in corpus(6) if not held(i)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    scorer, _ = lm.fit(df)
    for x in scorer.weights.tables.values():
        x[:] = 0
    plain = Plain(rows, scorer)
    seen, expected = Counter(), Counter()
    for _, text in rows:
        for at, kind, slot, p, q, _ in plain.parts(text):
            for name, row in at.items():
                target, share = (slot, q) if name == "slot" else (kind, p)
                seen[name, row, target] += 1
                for c, x in enumerate(share):
                    expected[name, row, c] += x
    lm.train(df, scorer.words, scorer.weights, rounds=1)
    for (name, row, c), x in expected.items():
        want = lm.STEP[name] * math.log((seen[name, row, c] + lm.PRIOR) / (x + lm.PRIOR))
        assert math.isclose(scorer.weights.tables[name][row, c], want, abs_tol=0.02)
    assert sum((x != 0).any(1).sum() for x in scorer.weights.tables.values()) == len({k[:2] for k in expected})


def test_rows_follow_whole_tokens():
    """Any token, however rare, has rows of its own hash, before another and in its own slot."""
    w = lm.Weights(lm.LEAST_ROWS)
    h = tk.hash_words([f"rare{k}".encode() for k in range(2000)])
    rows = w.rows(h, np.roll(h, 1), np.zeros(2000, np.int64))
    spread = lm.LEAST_ROWS * (1 - math.exp(-2000 / lm.LEAST_ROWS))  # distinct rows of a good hash
    assert all(abs(len(np.unique(x)) - spread) < 40 for x in rows.values())
    _, slot, outside = lm.Words(h[:0]).places(h, np.zeros(2000, np.int64))
    assert outside.all() and len(np.unique(slot)) == lm.SLOTS


def test_tokens_end_every_document():
    h, _, at = lm.tokens(np.frombuffer(b"a bc", np.uint8), np.array([0, 0, 2, 4, 4]))
    assert np.diff(at).tolist() == [1, 2, 2, 1] and h[at[1:] - 1].tolist() == [int(lm.END)] * 4
    assert h[1] == tk.hash_words([b"a"])[0]
