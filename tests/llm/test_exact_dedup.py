import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import exact_dedup

DOCS = "doc_id long, text string"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i or 0))
        kept = [i == top for i in ids]
        kept = [k and k not in kept[:at] for at, k in enumerate(kept)]
        out += [(i, top, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for i, k in zip(ids, kept, strict=True)]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in exact_dedup.exact_duplicates(df).collect())


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_rows(spark, parts):
    long = "abcdefgh" * 9000
    rows = [(1, None), (2, ""), (3, ""), (None, "x"), (None, "x"), (4, long), (9, long), (5, long + "y"), (6, "abcdefgh"), (6, "abcdefgh"), (7, "abcdefg"), (8, "é\x00"), (10, "é")]
    rows += [(100 + k, "hot " * 30) for k in range(300)] + [(500 + k, "hot " * 30 + str(k % 50)) for k in range(200)]
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    assert got(df) == brute(rows)


@pytest.mark.parametrize("share", [2, 5])
def test_hot_texts_are_reduced_in_rounds(spark, monkeypatch, share):
    """With small shares the hot texts take several rounds; long common prefixes are lengthened to their end."""
    monkeypatch.setattr(exact_dedup, "LEAST_SHARE", share)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    try:
        rows = [(k if k % 5 else None, "hot " * 400) for k in range(400)] + [(1000 + k, "hot " * 400 + str(k % 30)) for k in range(100)] + [(2000 + k, None if k % 2 else "") for k in range(90)]
        df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", _key int").repartition(8)
        assert got(df) == brute(rows)
        kept = exact_dedup.deduplicate(df).collect()
        assert sorted((r.doc_id, r.text or "") for r in kept) == sorted((i, t or "") for i, t in {(t or ""): (i, t) for i, t in sorted(rows, key=lambda r: r[0] or -1)}.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_rows_of_a_key_stay_together(monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 30)
    keys = [1] * 3 + [2] * 10 + [3, 4, 5] + [6] * 9
    for size in (1, 2, 3, 4, 100):
        tables = [t["k"].to_pylist() for t in exact_dedup._together((pa.RecordBatch.from_pydict({"k": keys[a : a + size]}) for a in range(0, len(keys), size)), "k")]
        assert [k for t in tables for k in t] == keys
        assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:], strict=False)) and len(tables) > (size < 100)


def test_empty_and_extra_columns(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7)], DOCS + ", keep_id int")
    assert {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(df).collect()} == {1: (2, False), 2: (2, True), 3: (3, True)}
    assert sorted(tuple(r) for r in exact_dedup.deduplicate(df).collect()) == [(2, "a", 6), (3, "b", 7)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00", max_size=30).map(str.encode)))
def test_radix_groups(texts):
    found = exact_dedup.radix_groups(texts)
    assert sorted(i for g in found for i in g) == list(range(len(texts)))
    assert len(found) == len(set(texts)) and all(len({texts[i] for i in g}) == 1 for g in found)
