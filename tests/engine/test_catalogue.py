"""Registered queries over whole tables, held against plain Python."""

from collections import Counter, defaultdict
from threading import Timer

import pytest

from tamarack.plans import catalogue


def test_int_double_join_takes_the_whole_table(spark, sf):
    quantity = Counter(r[0] for r in catalogue.table(spark, sf, "lineitem").select("l_quantity").collect())
    parts = defaultdict(list)
    for key, size in catalogue.table(spark, sf, "part").select("p_partkey", "p_size").collect():
        parts[float(size)].append(key)
    want = sorted((q, n * len(parts[q]), n * sum(parts[q])) for q, n in quantity.items() if parts[q])
    made = sorted(map(tuple, catalogue.QUERIES["join_int_double_keys"](spark, sf).collect()))
    assert made == want and sum(n for _, n, _ in made) > sum(quantity.values())


def _int_double_join(spark, folder, lines, parts):
    lines.write.parquet(f"{folder}/lineitem.parquet")
    parts.write.parquet(f"{folder}/part.parquet")
    return sorted(map(tuple, catalogue.QUERIES["join_int_double_keys"](spark, str(folder)).collect()), key=repr)


def test_int_double_join_ends_where_pairs_are_a_million_millions(spark, tmp_path):
    stop = Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        lines = spark.range(1_000_000).selectExpr("CAST(id % 2 AS DOUBLE) AS l_quantity")
        parts = spark.range(1_000_000).selectExpr("id AS p_partkey", "CAST(id % 2 AS INT) AS p_size")
        half = 500_000
        assert _int_double_join(spark, tmp_path, lines, parts) == [(0.0, half**2, half**2 * (half - 1)), (1.0, half**2, half**3)]
    finally:
        stop.cancel()


@pytest.mark.parametrize("size", ["int", "long"])
def test_int_double_join_on_odd_keys(spark, tmp_path, size):
    lines = [0.0, -0.0, 2.5, 2.0, 2.0, -3.0, None, None, float("nan"), float("inf"), 2.0**53, 9.0]
    parts = [(1, 0), (2, 2), (None, 2), (-7, 2), (None, -3), (4, None), (None, 9), (3, 9), (8, 7)] + ([(5, 2**53), (6, 2**53 + 1)] if size == "long" else [])
    want = defaultdict(lambda: [0, None])
    for q in lines:
        for key, z in parts:
            if q is not None and z is not None and q == float(z):
                got = want[q + 0.0]
                got[0], got[1] = got[0] + 1, got[1] if key is None else (got[1] or 0) + key
    made = _int_double_join(spark, tmp_path, spark.createDataFrame([(q,) for q in lines], "l_quantity double"), spark.createDataFrame(parts, f"p_partkey long, p_size {size}"))
    assert made == sorted(((q, *v) for q, v in want.items()), key=repr)


@pytest.mark.parametrize(("name", "up"), [("order_nulls", True), ("order_nulls_desc", False)])
def test_whole_table_is_sorted_with_its_nulls(spark, sf, name, up):
    rows = [(None if r[1] == 3 else r[1], *r) for r in catalogue.table(spark, sf, "lineitem").select(*catalogue.KEYS).collect()]
    want = sorted(rows, key=lambda r: ((r[0] or 0) if up else -(r[0] or 0), *r[1:]))
    made = list(map(tuple, catalogue.QUERIES[name](spark, sf).collect()))
    assert made == want
    assert {r[0] is None for r in made} == {True, False} and (made[0][0] is None) == up and (made[-1][0] is None) != up


def test_predicates_on_values_keep_a_share_of_the_table(spark, sf):
    rows = [tuple(r) for r in catalogue.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_discount", "l_returnflag").collect()]
    made = {name: sorted(map(tuple, catalogue.QUERIES[name](spark, sf).collect())) for name in ("sql_bool", "sql_null", "lake_filter")}
    assert made["sql_bool"] == sorted((k, not (q > 10 and t < 0.05), False) for k, q, t, _, f in rows if q < 5 or (f == "A" and q >= 49))
    assert made["sql_null"] == [(sum(d < 0.05 for *_, d, _ in rows),)]
    assert made["lake_filter"] == sorted((k, q * 2) for k, q, _, _, f in rows if f == "R" and q < 30)
    assert min(len(made["sql_bool"]), made["sql_null"][0][0], len(made["lake_filter"])) > len(rows) // 20
