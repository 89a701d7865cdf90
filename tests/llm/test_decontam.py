import hashlib
import re

import pytest

from tamarack.llm import decontam, decontam_join

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, names = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def got(docs, items):
    return sorted(repr(tuple(r)) for r in decontam.contamination(docs, items).collect())


@pytest.fixture(params=["index", "join"])
def way(request, monkeypatch):
    if request.param == "join":
        monkeypatch.setattr(decontam, "INDEX_BYTES", -1)


def test_whole_tables(spark, sf, way):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert got(docs, items) == want and sum("True" in r for r in want) > 0


LETTERS = "a b c d e f g h i j k l m n"
CASES = [
    (1, "x. A-B, c d E f g h i J y"), (2, LETTERS), (3, "a b c d e f g h i"), (4, None), (5, ""), (6, "...!"), (7, "Zwei Wörter"), (7, "zwei, wörter zwei wörter"), (None, LETTERS * 2),
    (8, "the the the the the the the the the the the the"), (9, "zwei"), (10, "È é"), (11, "solo"), (12, "a b c d e f g h i j"), (13, "w " * 30_000 + LETTERS),
]


ODD_ITEMS = [(10, LETTERS), (9, LETTERS), (9, "zwei wörter"), (2, None), (3, "?!"), (4, "the " * 11), (None, "solo"), (5, "È é"), (10, LETTERS)]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_odd_rows_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_ITEM_BYTES", block)
    assert got(spark.createDataFrame(CASES, DOCS), spark.createDataFrame(ODD_ITEMS, ITEMS)) == brute(CASES, ODD_ITEMS)


@pytest.mark.parametrize("bits", [8, 27])
def test_odd_rows_by_join(spark, monkeypatch, bits):
    """Also with a bit table that lets nearly everything through."""
    monkeypatch.setattr(decontam, "INDEX_BYTES", -1)
    monkeypatch.setattr(decontam_join, "FILTER_BITS", bits)
    assert got(spark.createDataFrame(CASES, DOCS), spark.createDataFrame(ODD_ITEMS, ITEMS)) == brute(CASES, ODD_ITEMS)


def test_empty_tables_and_clashing_columns(spark, way):
    none = spark.createDataFrame([], ITEMS)
    assert got(spark.createDataFrame(CASES, DOCS), none) == brute(CASES, [])
    assert got(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], ITEMS)) == []
    docs = spark.createDataFrame([(1, "solo", 3, 5), (2, "duo", 4, 6)], DOCS + ", n_hit int, _rid int")
    assert [tuple(r) for r in decontam.clean(docs, spark.createDataFrame([(1, "solo")], ITEMS)).collect()] == [(2, "duo", 4, 6)]
