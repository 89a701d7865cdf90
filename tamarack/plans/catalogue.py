"""The registered queries for the engine's own operators, with the SQL that checks them.

``q_`` and operator names use the DataFrame operators; ``sql_`` names go through the dialect.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import expressions as ex
from tamarack.functions import vectors
from tamarack.operators import relational as ops
from tamarack.plans.session import Session
from tamarack.sources.files import Folder
from tamarack.sources.lake import LakeTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _simple(name: str, build: Callable[[DataFrame], DataFrame], oracle: str, source: str = "lineitem") -> None:
    """A query over one table."""
    QUERIES[name] = lambda spark, sf_dir: build(table(spark, sf_dir, source))
    ORACLES[name] = oracle


KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
C = F.col

# ---------------------------------------------------------------- scan, projection, expressions

_simple("q_flagship", lambda t: ops.aggregate(ops.filter_rows(t, C("l_quantity") > 10), [C("l_returnflag")], [F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"), F.avg("l_quantity").alias("avg_qty")]),
        "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sum_qty, avg(l_quantity) AS avg_qty FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
_simple("scan_star", lambda t: ops.scan(t), "SELECT * FROM nation", "nation")
_simple("scan_pruned_columns", lambda t: ops.scan(t, columns=["l_orderkey", "l_quantity"]), "SELECT l_orderkey, l_quantity FROM lineitem")
_simple("scan_timestamps", lambda t: ops.scan(t, columns=["o_orderkey", "o_orderdate"]), "SELECT o_orderkey, o_orderdate FROM orders", "orders")
_simple("filter_prune_all", lambda t: ops.scan(t, columns=KEYS, where=C("l_orderkey") < 0), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey < 0")
_simple("project_arith", lambda t: ops.project(t, *map(C, KEYS), (C("l_partkey") + C("l_suppkey")).alias("a"), (C("l_partkey") - C("l_suppkey")).alias("s"), (C("l_linenumber") * 3).alias("m"), (F.lit(0) - C("l_quantity")).alias("u")),
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS s, l_linenumber * 3 AS m, -l_quantity AS u FROM lineitem")
_simple("project_div", lambda t: ops.project(t, C("l_orderkey"), ex.divide(C("l_partkey"), C("l_linenumber")).alias("d")), "SELECT l_orderkey, CAST(l_partkey AS DOUBLE) / l_linenumber AS d FROM lineitem")
_simple("project_div_zero", lambda t: ops.project(t, C("l_orderkey"), ex.divide(C("l_quantity"), C("l_discount")).alias("d")), "SELECT l_orderkey, CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_quantity / l_discount END AS d FROM lineitem")
_simple("project_const", lambda t: ops.project(t, C("n_nationkey"), F.lit(7).alias("i"), F.lit(1.5).alias("d"), F.lit("x y").alias("s"), F.lit(True).alias("b"), F.lit(None).cast("int").alias("z")),
        "SELECT n_nationkey, 7 AS i, 1.5::DOUBLE AS d, 'x y' AS s, true AS b, NULL::INTEGER AS z FROM nation", "nation")
for _name, _op in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _simple(f"cmp_{_name}", lambda t, op=_op: ops.project(ops.filter_rows(t, ex.compare(op, C("l_quantity"), F.lit(25.0))), *map(C, KEYS), C("l_quantity")), f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity {_op} 25")
    _simple(f"cmp_nan_{_name}", lambda t, op=_op: ops.aggregate(ops.filter_rows(t, ex.compare(op, ex.divide(C("l_quantity"), C("l_discount")), F.lit(500.0), nan=True)), [], [F.count(F.lit(1)).alias("n")]),
            f"SELECT count(*) AS n FROM lineitem WHERE {'l_discount = 0 OR' if _op in ('<>', '>', '>=') else 'l_discount <> 0 AND'} (l_discount <> 0 AND l_quantity / l_discount {_op} 500)")
_simple("cmp_varchar", lambda t: ops.project(ops.filter_rows(t, C("c_mktsegment") >= "HOUSEHOLD"), C("c_custkey"), C("c_mktsegment")), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'HOUSEHOLD'", "customer")
_simple("filter_and", lambda t: ops.project(ops.filter_rows(t, (C("l_quantity") > 45) & (C("l_returnflag") == "R")), *map(C, KEYS)), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
_simple("filter_or", lambda t: ops.project(ops.filter_rows(t, (C("l_quantity") > 49) | (C("l_tax") == 0)), *map(C, KEYS)), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 49 OR l_tax = 0")
_simple("filter_nested_paren", lambda t: ops.project(ops.filter_rows(t, (C("l_quantity") > 40) & ((C("l_returnflag") == "A") | (C("l_linestatus") == "F"))), *map(C, KEYS)),
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40 AND (l_returnflag = 'A' OR l_linestatus = 'F')")


def _holed(t: DataFrame) -> DataFrame:
    """A column with NULLs; the tables have none."""
    return t.withColumn("h", F.when(C("l_linenumber") != 3, C("l_linenumber")))


_HOLED = "(SELECT *, CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS h FROM lineitem)"
_simple("bool_null_as_false", lambda t: ops.project(_holed(t), *map(C, KEYS), ex.and_(C("h") > 2, C("l_quantity") > 10).alias("a"), ex.or_(C("h") > 2, C("l_quantity") > 10).alias("o")),
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(h > 2, false) AND l_quantity > 10 AS a, coalesce(h > 2, false) OR l_quantity > 10 AS o FROM {_HOLED}")
_simple("filter_null_never_matches", lambda t: ops.aggregate(ops.filter_rows(_holed(t), (C("h") > 0) | (C("h") <= 0)), [], [F.count(F.lit(1)).alias("n")]), f"SELECT count(*) AS n FROM {_HOLED} WHERE h > 0 OR h <= 0")

# ---------------------------------------------------------------- aggregates

_simple("agg_count_star", lambda t: ops.aggregate(t, [], [F.count(F.lit(1)).alias("n")]), "SELECT count(*) AS n FROM lineitem")
_simple("agg_count_col_nulls", lambda t: ops.aggregate(_holed(t), [], [F.count("h").alias("n"), F.count(F.lit(1)).alias("whole")]), f"SELECT count(h) AS n, count(*) AS whole FROM {_HOLED}")
_simple("agg_sum_int", lambda t: ops.aggregate(t, [], [F.sum("l_linenumber").alias("s"), F.sum("l_partkey").alias("b")]), "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(l_partkey) AS BIGINT) AS b FROM lineitem")
_simple("agg_sum_double", lambda t: ops.aggregate(t, [], [F.round(F.sum("l_extendedprice"), 2).alias("s")]), "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem")
_simple("agg_avg", lambda t: ops.aggregate(t, [C("l_linestatus")], [F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg("l_linenumber"), 6).alias("l")]), "SELECT l_linestatus, round(avg(l_quantity), 6) AS q, round(avg(l_linenumber), 6) AS l FROM lineitem GROUP BY 1")
_simple("agg_min_max_num", lambda t: ops.aggregate(t, [C("l_returnflag")], [F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")]), "SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
_simple("agg_min_max_varchar", lambda t: ops.aggregate(t, [], [F.min("c_name").alias("lo"), F.max("c_name").alias("hi")]), "SELECT min(c_name) AS lo, max(c_name) AS hi FROM customer", "customer")
_simple("agg_empty_global", lambda t: ops.aggregate(ops.filter_rows(t, C("l_orderkey") < 0), [], [F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"), F.min("l_returnflag").alias("m")]), "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_returnflag) AS m FROM lineitem WHERE l_orderkey < 0")
_simple("agg_empty_grouped", lambda t: ops.aggregate(ops.filter_rows(t, C("l_orderkey") < 0), [C("l_returnflag")], [F.count(F.lit(1)).alias("n")]), "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey < 0 GROUP BY 1")
_simple("group_single", lambda t: ops.aggregate(t, [C("event_type")], [F.count(F.lit(1)).alias("n")]), "SELECT event_type, count(*) AS n FROM events GROUP BY 1", "events")
_simple("group_multi", lambda t: ops.aggregate(t, [C("l_returnflag"), C("l_linestatus")], [F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")]), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2")
_simple("group_null_key", lambda t: ops.aggregate(_holed(t), [C("h")], [F.count(F.lit(1)).alias("n")]), f"SELECT h, count(*) AS n FROM {_HOLED} GROUP BY 1")
_simple("group_expr", lambda t: ops.aggregate(t, [(C("l_linenumber") * 2).alias("k")], [F.count(F.lit(1)).alias("n")]), "SELECT l_linenumber * 2 AS k, count(*) AS n FROM lineitem GROUP BY 1")
_simple("agg_post_arith", lambda t: ops.project(ops.aggregate(t, [C("l_returnflag")], [F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n")]), C("l_returnflag"), F.round(ex.divide(C("s"), C("n")), 6).alias("mean"), (C("n") + 1).alias("more")),
        "SELECT l_returnflag, round(sum(l_quantity) / count(*), 6) AS mean, count(*) + 1 AS more FROM lineitem GROUP BY 1")

# ---------------------------------------------------------------- joins


def _pair(spark: SparkSession, sf_dir: str, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, left), table(spark, sf_dir, right)


@register("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _pair(spark, sf_dir, "orders", "customer")
    return ops.project(ops.join_inner(o, c, C("o_custkey") == C("c_custkey")), C("o_orderkey"), C("c_name"))


@register("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND c_acctbal > 0")
def join_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _pair(spark, sf_dir, "orders", "customer")
    joined = ops.join_inner(o, c, C("o_custkey") == C("c_custkey"))
    return ops.project(ops.filter_rows(joined, (C("o_totalprice") > 100000) & (C("c_acctbal") > 0)), C("o_orderkey"), C("c_name"))


@register("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _pair(spark, sf_dir, "orders", "customer")
    return ops.aggregate(ops.join_inner(o, c, C("o_custkey") == C("c_custkey")), [C("c_mktsegment")], [F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s")])


@register("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _pair(spark, sf_dir, "customer", "supplier")
    return ops.project(ops.join_inner(c, s, (C("c_custkey") == C("s_suppkey")) & (C("c_nationkey") == C("s_nationkey"))), C("c_custkey"), C("s_suppkey"))


@register("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _pair(spark, sf_dir, "customer", "supplier")
    return ops.project(ops.join_inner(c, s, C("c_nationkey") == C("s_nationkey")), C("c_custkey"), C("s_suppkey"))


@register("SELECT c_custkey, n_name FROM (SELECT *, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS k FROM customer) JOIN (SELECT *, CASE WHEN n_nationkey <> 4 THEN n_nationkey END AS m FROM nation) ON k = m")
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _pair(spark, sf_dir, "customer", "nation")
    c, n = c.withColumn("k", F.when(C("c_nationkey") != 3, C("c_nationkey"))), n.withColumn("m", F.when(C("n_nationkey") != 4, C("n_nationkey")))
    return ops.project(ops.join_inner(c, n, C("k") == C("m")), C("c_custkey"), C("n_name"))


@register("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey < 0")
def join_empty_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _pair(spark, sf_dir, "orders", "customer")
    return ops.project(ops.join_inner(o, ops.filter_rows(c, C("c_custkey") < 0), C("o_custkey") == C("c_custkey")), C("o_orderkey"), C("c_name"))


@register("SELECT l_quantity, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS s FROM lineitem JOIN part ON l_quantity = p_size GROUP BY 1")
def join_int_double_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both whole tables are counted by key before they meet: a line's pairs differ only in the part, so a key's counts
    and sums multiply to those of all its pairs, whose number is the product of the tables' sizes.  Several sizes may
    equal one quantity, so the products are summed once more."""
    t, p = _pair(spark, sf_dir, "lineitem", "part")
    t = ops.aggregate(t, [C("l_quantity")], [F.count(F.lit(1)).alias("lines")])
    p = ops.aggregate(p, [C("p_size")], [F.count(F.lit(1)).alias("parts"), F.sum("p_partkey").alias("keys")])
    joined = ops.join_inner(t, p, C("l_quantity") == C("p_size"))
    return ops.aggregate(joined, [C("l_quantity")], [F.sum(C("lines") * C("parts")).alias("n"), F.sum(C("lines") * C("keys")).alias("s")])


@register("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey + 1 = n_nationkey * 1")
def join_expression_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _pair(spark, sf_dir, "customer", "nation")
    return ops.project(ops.join_inner(c, n, C("c_nationkey") + 1 == C("n_nationkey") * 1), C("c_custkey"), C("n_nationkey"))


@register("SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _pair(spark, sf_dir, "nation", "region")
    return ops.join_inner(n, r, C("n_regionkey") == C("r_regionkey"))


# ---------------------------------------------------------------- order, limit, top-k

_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_ALL = [(k, True) for k in KEYS]
_simple("order_multi", lambda t: ops.project(ops.order_by(t, ("n_regionkey", False), ("n_name", True)), C("n_regionkey"), C("n_name")), "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2", "nation")
_simple("order_nulls", lambda t: ops.project(ops.order_by(_holed(t), ("h", True), *_ALL), C("h"), *map(C, KEYS)), f"SELECT h, {_ROW} FROM {_HOLED} ORDER BY h NULLS FIRST, {_ROW}")
_simple("order_nulls_desc", lambda t: ops.project(ops.order_by(_holed(t), ("h", False), *_ALL), C("h"), *map(C, KEYS)), f"SELECT h, {_ROW} FROM {_HOLED} ORDER BY h DESC NULLS LAST, {_ROW}")
_simple("topk", lambda t: ops.project(ops.top_k(t, 10, ("l_extendedprice", False), *_ALL), C("l_extendedprice"), *map(C, KEYS)), f"SELECT l_extendedprice, {_ROW} FROM lineitem ORDER BY l_extendedprice DESC, {_ROW} LIMIT 10")
_simple("topk_group", lambda t: ops.top_k(ops.aggregate(t, [C("l_partkey")], [F.count(F.lit(1)).alias("n")]), 7, ("n", False), ("l_partkey", True)), "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 7")
_simple("limit_count", lambda t: ops.aggregate(ops.limit(t, 1234), [], [F.count(F.lit(1)).alias("n")]), "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 1234)")
_simple("limit_zero", lambda t: ops.limit(t, 0), "SELECT * FROM nation LIMIT 0", "nation")
_simple("limit_beyond", lambda t: ops.limit(ops.order_by(t, ("n_nationkey", True)), 2**40), "SELECT * FROM nation ORDER BY n_nationkey", "nation")

# ---------------------------------------------------------------- vectors


def _x() -> Column:
    return C("embedding").cast("array<double>")


def _query() -> list[float]:
    """A query vector that isn't of length one, so the three distances rank differently."""
    return [((k * 7) % 11 - 5) / 4 for k in range(DIM)]


_V = "[" + ", ".join(f"{v}::DOUBLE" for v in _query()) + "]::DOUBLE[]"
_E = "[e::DOUBLE * (1 + vec_id % 3) FOR e IN embedding]"
_SQL = {"l2_distance": "list_distance", "cosine_distance": "list_cosine_distance", "negative_inner_product": "list_negative_inner_product"}


def _scaled() -> Column:
    return F.transform(_x(), lambda e: e * (1 + C("vec_id") % 3))


for _name, _f in (("l2", "l2_distance"), ("cosine", "cosine_distance"), ("nip", "negative_inner_product")):
    _d = f"round({_SQL[_f]}({_E}, {_V}), 6)"
    _simple(f"vec_{_name}", lambda t, f=_f: ops.project(t, C("vec_id"), F.round(vectors.DISTANCES[f](_scaled(), vectors.literal(_query())), 6).alias("d")), f"SELECT vec_id, {_d} AS d FROM embeddings", "embeddings")
    _simple(f"vec_topk_{_name}", lambda t, f=_f: ops.top_k(ops.project(t, C("vec_id"), F.round(vectors.DISTANCES[f](_scaled(), vectors.literal(_query())), 6).alias("d")), 10, ("d", True), ("vec_id", True)),
            f"SELECT vec_id, {_d} AS d FROM embeddings ORDER BY d, vec_id LIMIT 10", "embeddings")
_simple("vec_null", lambda t: ops.project(t, C("vec_id"), F.round(vectors.cosine_distance(F.when(C("vec_id") % 5 != 0, _x()), vectors.literal(_query())), 6).alias("d")),
        f"SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN round(list_cosine_distance([e::DOUBLE FOR e IN embedding], {_V}), 6) END AS d FROM embeddings", "embeddings")
_simple("vec_group_min_distance", lambda t: ops.aggregate(t, [C("label")], [F.round(F.min(vectors.l2_distance(_x(), vectors.literal(_query()))), 6).alias("d")]),
        f"SELECT label, round(min(list_distance([e::DOUBLE FOR e IN embedding], {_V})), 6) AS d FROM embeddings GROUP BY 1", "embeddings")
_simple("vec_compare", lambda t: ops.aggregate(ops.filter_rows(t, _x() < vectors.literal([0.0] * DIM)), [], [F.count(F.lit(1)).alias("n"), F.min(_x()).alias("lo")]),
        f"SELECT count(*) AS n, min([e::DOUBLE FOR e IN embedding]) AS lo FROM embeddings WHERE [e::DOUBLE FOR e IN embedding] < {[0.0] * DIM}::DOUBLE[]", "embeddings")

# ---------------------------------------------------------------- the same through the dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    for name in TABLES:
        s.register_parquet(name, f"{sf_dir}/{name}.parquet")
    s.register_parquet("embeddings", f"{sf_dir}/embeddings.parquet", {"embedding": DIM})
    return s


@register("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.embedding = b.embedding")
def sql_vec_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.register("twins", table(spark, sf_dir, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("copy")), {"copy": DIM})
    return s.query("SELECT vec_id AS a, id AS b FROM embeddings JOIN twins ON embedding = copy")


@register("SELECT count(*) AS n FROM lineitem WHERE l_discount <> 0")
def sql_stored_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN in a stored column is unequal to itself."""
    s = session(spark, sf_dir)
    s.register("shares", s.query("SELECT l_quantity / l_discount AS d FROM lineitem"))
    return s.query("SELECT count(*) AS n FROM shares WHERE d = d")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir).query(text)
    ORACLES[name] = oracle or text


_DIALECT_V = "[" + ", ".join(map(str, _query())) + "]"
_sql("sql_flagship", "SELECT l_returnflag AS f, count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
_sql("sql_star", "SELECT * FROM nation", 'SELECT n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey" FROM nation')
_sql("sql_arith", "SELECT l_orderkey AS k, l_partkey + l_suppkey * 2 - 1 AS a, -l_quantity AS u, (l_linenumber + 1) * 2 AS p FROM lineitem WHERE l_linenumber <= 2")
_sql("sql_div_zero", "SELECT l_orderkey AS k, l_quantity / l_discount AS d FROM lineitem WHERE l_quantity / l_discount > 400 AND l_tax < 0.02",
     "SELECT l_orderkey AS k, CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_quantity / l_discount END AS d FROM lineitem WHERE (l_discount = 0 OR l_quantity / CASE WHEN l_discount <> 0 THEN l_discount END > 400) AND l_tax < 0.02")
_sql("sql_bool", "SELECT l_orderkey AS k, (l_quantity > 10 AND l_tax < 0.05) = false AS b, l_returnflag = 3 AS never FROM lineitem WHERE l_quantity < 5 OR l_returnflag = 'A' AND l_quantity >= 49.0",
     "SELECT l_orderkey AS k, NOT (l_quantity > 10 AND l_tax < 0.05) AS b, false AS never FROM lineitem WHERE l_quantity < 5 OR l_returnflag = 'A' AND l_quantity >= 49")
_sql("sql_null", "SELECT count(*) AS n FROM lineitem WHERE l_tax = null OR l_discount < 0.05")
_sql("sql_group", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_linenumber) AS q, sum(l_partkey) / count(*) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY q DESC, f",
     "SELECT l_returnflag AS f, l_linestatus AS s, CAST(sum(l_linenumber) AS BIGINT) AS q, CAST(sum(l_partkey) AS DOUBLE) / count(*) AS m FROM lineitem GROUP BY 1, 2")
_sql("sql_group_expr", "SELECT l_linenumber * 2 AS k, max(l_shipdate) AS hi, min(l_returnflag) AS lo FROM lineitem GROUP BY k")
_sql("sql_join", "SELECT c_mktsegment AS m, count(*) AS n, max(o_totalprice) AS t FROM orders JOIN customer ON customer.c_custkey = orders.o_custkey WHERE c_acctbal > 0 GROUP BY c_mktsegment ORDER BY 2 DESC LIMIT 4",
     "SELECT c_mktsegment AS m, count(*) AS n, max(o_totalprice) AS t FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 2 DESC LIMIT 4")
_sql("sql_join_star", "SELECT * FROM nation INNER JOIN region ON n_regionkey = r_regionkey",
     'SELECT n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey", r_regionkey AS "region.r_regionkey", r_name AS "region.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey')
_sql("sql_topk", f"SELECT l_extendedprice AS p, {_ROW} FROM lineitem ORDER BY p DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10",
     f'SELECT l_extendedprice AS p, {", ".join(f"""{k} AS "lineitem.{k}" """ for k in KEYS)} FROM lineitem ORDER BY p DESC, {_ROW} LIMIT 10')
for _name, _f in (("l2", "array_distance"), ("cosine", "array_cosine_distance"), ("nip", "array_negative_inner_product")):
    _plain = {"array_distance": "l2_distance", "array_cosine_distance": "cosine_distance"}.get(_f, "negative_inner_product")
    _text = f"SELECT vec_id AS id, {_f}(embedding, {_DIALECT_V}) AS d, label AS l FROM embeddings ORDER BY d, id LIMIT 20"
    # the dialect has no rounding; the last bits of a sum depend on its order
    QUERIES[f"sql_vec_topk_{_name}"] = lambda spark, sf_dir, text=_text: session(spark, sf_dir).query(text).withColumn("d", F.round("d", 6))
    _d = f"{_SQL[_plain]}([e::DOUBLE FOR e IN embedding], {_V})"
    ORACLES[f"sql_vec_topk_{_name}"] = f"SELECT vec_id AS id, round({_d}, 6) AS d, label AS l FROM embeddings ORDER BY {_d}, id LIMIT 20"
_sql("sql_vec_group_key", "SELECT embedding AS e, count(*) AS n, max(vec_id) AS hi FROM embeddings GROUP BY embedding", "SELECT [x::DOUBLE FOR x IN embedding] AS e, count(*) AS n, max(vec_id) AS hi FROM embeddings GROUP BY embedding")
_sql("sql_vec_group", f"SELECT label AS l, count(*) AS n FROM embeddings WHERE l2_distance(embedding, {_DIALECT_V}) <= 7.7 GROUP BY label", f"SELECT label AS l, count(*) AS n FROM embeddings WHERE list_distance([e::DOUBLE FOR e IN embedding], {_V}) <= 7.7 GROUP BY 1")


@register("SELECT * FROM (VALUES (1, 2.5::DOUBLE, 'a', true), (2, NULL, 'b c', false), (-3, 4::DOUBLE, NULL, NULL)) AS t(\"t.a\", \"t.b\", \"t.c\", \"t.d\")")
def sql_create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.query("CREATE TABLE t (a INTEGER, b DOUBLE, c VARCHAR, d BOOLEAN)")
    s.query("INSERT INTO t VALUES (1, 2.5, 'a', true), (2, null, 'b c', false)")
    s.query("insert into T values (-3, 4, null, null)")
    return s.query("SELECT * FROM t")


# ---------------------------------------------------------------- lake tables

_LAKE = {"l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_quantity": "DOUBLE", "l_returnflag": "VARCHAR"}


_FLAGS = ("N", "A", "R")
_FOLDERS: list[tuple[SparkSession, str]] = []


def _lake(spark: SparkSession, sf_dir: str) -> LakeTable:
    """lineitem in a commit for each flag, in a new folder that goes when the driver ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    t = LakeTable.create(spark, f"{root}/lake-{uuid.uuid4().hex}", _LAKE)
    _FOLDERS.append((spark, t.path))
    rows = ops.scan(lineitem(spark, sf_dir), columns=list(_LAKE))
    for flag in _FLAGS:
        t.append(rows.filter(C("l_returnflag") == flag))
    return t


@atexit.register
def _remove_folders() -> None:
    for spark, path in _FOLDERS:
        with contextlib.suppress(Exception):  # the session may be gone already; nothing is lost but disk space
            Folder(spark, path).delete("")


@register("SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem")
def lake_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lake(spark, sf_dir).scan()


@register("SELECT l_orderkey, l_quantity * 2 AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 30")
def lake_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lake(spark, sf_dir).scan(["l_orderkey", "l_quantity * 2 AS q"], "l_returnflag = 'R' AND l_quantity < 30")


@register("SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag IN ('N', 'A')")
def lake_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lake(spark, sf_dir)
    t.compact()
    return t.scan_version(2)


@register("SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem")
def lake_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lake(spark, sf_dir)
    t.compact()
    t.vacuum()
    return t.scan()


@register("SELECT * FROM (VALUES (0, false, false), (1, true, false), (2, true, false), (3, true, false), (4, true, true)) AS t(version, adds, removes)")
def lake_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lake(spark, sf_dir)
    t.compact()
    rows = [(v, any("add" in a for a in actions), any("remove" in a for a in actions)) for v, actions in t.history()]
    return spark.createDataFrame(rows, "version int, adds boolean, removes boolean")
