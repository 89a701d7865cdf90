import random
import re

import numpy as np

from tamarack.llm import minmax
from tamarack.llm.components import components

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    own = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(repr((i, len(own[k]), least.get(find(k)), i == least.get(find(k)))) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted(repr(tuple(r)) for r in minmax.near_duplicates(df).collect())


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([tuple(r) for r in docs.collect()])


def test_chains_of_copies(spark):
    """Copies of copies: neighbours are linked, far ones aren't, so components need the rest pass."""
    draw = random.Random(5)
    rows, n = [], 0
    for family in range(6):
        words = [f"f{family}w{draw.randrange(60)}" for _ in range(80)]
        for _ in range(25):
            words = list(words)
            words[draw.randrange(80)] = f"new{n}"
            rows.append((n * 7 % 1009, " ".join(words)))
            n += 1
    draw.shuffle(rows)
    assert got(spark.createDataFrame(rows, DOCS).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d e f"), (None, text), (8, text + " x"), (9, text), (9, text), (None, "lone words here"), (10, "z " * 30_000), (11, "z " * 9), (12, "\x00 é")]
    assert got(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_empty_and_kept_columns(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(2, text, 5), (1, text + " x", 6), (3, "b", 7), (3, "b", 7), (4, None, 8)], DOCS + ", node int")
    assert sorted(tuple(r)[::2] for r in minmax.deduplicate(df).collect()) == [(1, 6), (3, 7), (4, 8)]
    clash = spark.createDataFrame([(1, text, 70, 3), (2, "other", 80, 4)], DOCS + ", _rid int, bands int")
    assert sorted(tuple(r) for r in minmax.deduplicate(clash).collect()) == [(1, text, 70, 3), (2, "other", 80, 4)]


def test_sets_with_one_name_are_told_apart(spark):
    rows = [(1, 10, 5, 1), (2, 10, 5, 1), (3, 10, 5, 2), (4, 11, 5, 3), (5, None, None, None)]
    df = spark.createDataFrame([(r, r, n, a, b, [r]) for r, a, n, b in rows], "_rid long, doc_id long, n long, node long, other long, bands array<long>")
    node = {r._rid: r.node for r in minmax._apart(df).collect()}
    assert node[1] == node[2] == 10 and node[4] == 11 and node[5] is None and node[3] not in (None, 10, 11)


def family(n):
    """Texts that share 200 words and have 35 of their own: similarity 0.715, in one bucket or another together."""
    draw = random.Random(9)
    shared = " ".join(f"w{draw.randrange(10**6)}" for _ in range(200))
    return [(k, shared + "".join(f" o{k}x{j}" for j in range(35))) for k in range(n)]


def test_a_family_just_under_the_threshold_makes_no_pairs(spark, monkeypatch):
    asked = []
    compare = minmax._compare
    monkeypatch.setattr(minmax, "_compare", lambda pairs, whole, name: asked.append((name, pairs.count())) or compare(pairs, whole, name))
    rows = minmax.near_duplicates(spark.createDataFrame(family(400), DOCS).repartition(4)).collect()
    assert all(r.kept for r in rows)
    assert dict(asked)["rest"] == 0 and all(n < 400 * 2 * len(minmax._BAND) for _, n in asked)


def test_linked_texts_among_a_family(spark):
    """What is linked is found where most shingles are common to many: the classes of size lose nothing."""
    draw = random.Random(10)
    rows = []
    for k, text in family(120):
        words = text.split()
        rows.append((k, text))
        if k % 4 == 0:
            cut = words[: len(words) - draw.randrange(2, 30)]
            rows.append((1000 + k, " ".join(cut + [f"n{k}"])))
    assert got(spark.createDataFrame(rows, DOCS).repartition(4)) == brute(rows)


def test_recall_near_the_threshold():
    """Pairs of similarity 0.75 to 0.76 share a band; with ideal functions 5e-6 of them don't."""
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(3000):
        n = int(rng.integers(60, 400))
        common = -(-6 * n // 7)  # 2n - common in the union: similarity 0.75 at common = 6n/7
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
        x, y = (minmax.bands(np.sort(z), np.array([0])) for z in (a, b))
        missed += not (x == y).any()
    assert missed <= 1


def test_signature_estimates_similarity():
    """Both ends together estimate the Jaccard similarity without bias."""
    rng = np.random.default_rng(3)
    same = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 130).astype(np.uint64) * np.uint64(2)
        a, b = np.sort(pool[:100]), np.sort(pool[30:130])
        short = [(x >> np.uint64(32)).astype(np.uint32) for x in (a, b)]
        for k in range(minmax.PERMUTATIONS):
            u, v = (x * minmax._A[k] + minmax._B[k] for x in short)
            same += [u.min() == v.min(), u.max() == v.max()]
    assert abs(np.mean(same) - 70 / 130) < 0.03


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 300)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 100 for k in range(100, 161)) and all(found[k] == 5 for k in range(200, 300)) and 7 not in found
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
