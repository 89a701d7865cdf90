import os

import pytest

from tamarack.llm import store


def test_tables_go_with_their_scope(spark):
    with store.in_scope("a scope"):
        t = store.write_table(spark.range(5).toDF("x"), "t")
    path = t.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert t.count() == 5 and os.path.exists(path)
    store.drop_scope("a scope")
    assert not os.path.exists(path)


@pytest.mark.parametrize("rows", [[(1, "a"), (2, "b")], [(1, "a"), (1, "b")], [(None, "a"), (2, "b")], []])
def test_row_keys_are_unique_and_stay(spark, rows):
    t = store.with_row_key(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    one, two = (sorted((r.text, r._rid) for r in t.collect()) for _ in range(2))
    assert one == two and len({k for _, k in one}) == len(rows)


def test_broadcast_only_under_its_limit(spark):
    small, large = (store.broadcast_if_small(spark.range(9), 9, w, limit=100) for w in (8, 80))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(small) and not hinted(large)
