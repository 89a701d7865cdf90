"""The dialect from end to end, on a harbour's ships, calls and berths."""

import io
import math
import random

import pytest

from tamarack import cli
from tamarack.errors import BinderError, CatalogError, ExecutionError, ParserError
from tamarack.operators import relational
from tamarack.plans.render import show_table, show_value
from tamarack.plans.session import Session
from tamarack.types import vector

HARBOUR = """
CREATE TABLE ship (imo BIGINT, name VARCHAR, flag VARCHAR, tons DOUBLE, crew INTEGER, laid_up BOOLEAN)
CREATE TABLE visit (visit_id INTEGER, imo BIGINT, berth VARCHAR, hours DOUBLE, cargo INTEGER)
CREATE TABLE berth (code VARCHAR, depth DOUBLE, imo BIGINT)
INSERT INTO ship VALUES (9001, 'Alma', 'NO', 5200.5, 18, false), (9002, 'Bris', 'NO', 730, 6, false), (9003, 'Corva', 'PT', 5200.5, null, true), (9004, 'Dune', null, null, 22, null), (9005, 'Eos', 'GR', 91000, 25, false)
INSERT INTO visit VALUES (1, 9001, 'B2', 10.5, 40), (2, 9001, 'B3', 4, 0), (3, 9002, 'B2', 0, 12), (4, 9005, 'B9', 72, 900), (5, 9099, 'B2', 3, 7), (6, null, 'B3', null, 5), (7, 9002, 'B2', 0, 0)
INSERT INTO berth VALUES ('B2', 9.5, 9001), ('B3', 7, 9002), ('B3', 7.25, 9002)
"""


@pytest.fixture
def s(spark):
    return Session(spark)


@pytest.fixture
def h(s):
    for statement in HARBOUR.strip().splitlines():
        assert [tuple(r) for r in s.fetch(statement)] == [("OK",)]
    return s


def ask(s, sql):
    return [tuple(r) for r in s.fetch(sql)]


def kinds(s, sql):
    return [f.dataType.simpleString() for f in s.query(sql).schema]


# ---------------------------------------------------------------- scan, filter, projection

SHIPS = [("Alma", "NO", 5200.5, 18), ("Bris", "NO", 730.0, 6), ("Corva", "PT", 5200.5, None), ("Dune", None, None, 22), ("Eos", "GR", 91000.0, 25)]


@pytest.mark.parametrize(("where", "names"), [
    ("tons > 5200.5", "Eos"), ("tons >= 5200.5", "Alma Corva Eos"), ("crew < 18", "Bris"), ("18 <= crew", "Alma Dune Eos"), ("flag <> 'NO'", "Corva Eos"), ("name = 'Dune' OR flag = 'GR'", "Dune Eos"),
    ("laid_up = false AND crew > 6", "Alma Eos"), ("laid_up", "Corva"), ("crew = crew", "Alma Bris Dune Eos"), ("name > 'Bz' AND (crew < 23 OR tons > 90000)", "Dune Eos"), ("tons / crew < 150", "Bris"),
    ("crew * 2 - 1 = 35", "Alma"), ("imo - 9000 > crew / 6", "Bris Dune Eos"), ("crew = null", ""), ("crew <> null OR name = 'Eos'", "Eos"), ("-crew < -22", "Eos"), ("tons = 730", "Bris"),
])
def test_where(h, where, names):
    assert [n for (n,) in ask(h, f"SELECT name FROM ship WHERE {where} ORDER BY name")] == names.split()


def test_projection_names_and_types(h):
    df = h.query("SELECT crew + imo, tons / 2 AS half, -crew, Ship.NAME, crew * 0.5, 'dock' AS place, null FROM ship WHERE imo = 9002")
    assert df.columns[:6] == ["(crew + imo)", "half", "(0 - crew)", "ship.name", "(crew * 0.5)", "place"]
    assert [tuple(r) for r in df.collect()] == [(9008, 365.0, -6, "Bris", 3.0, "dock", None)]
    assert [f.dataType.simpleString() for f in df.schema][:5] == ["bigint", "double", "int", "string", "double"]


def test_division_by_zero_is_nan(h):
    got = ask(h, "SELECT visit_id, cargo / hours AS rate FROM visit ORDER BY visit_id")
    assert [("none" if v is None else "nan" if math.isnan(v) else round(v, 3)) for _, v in got] == [3.81, 0.0, "nan", 12.5, 2.333, "none", "nan"]


@pytest.mark.parametrize(("test", "n"), [
    ("rate = rate", 4), ("rate <> rate", 2), ("rate < 4", 3), ("rate <= 12.5", 4), ("rate > 4", 3), ("rate >= 12.5", 3), ("4 > rate", 5), ("4 < rate", 1), ("4 >= rate", 5), ("4 <= rate", 1), ("3 = rate", 0), ("3 <> rate", 6),
    ("rate < other", 0), ("rate <= other", 4), ("rate > other", 2), ("other >= rate", 6), ("rate + 1 = other + 1", 4), ("(rate < other) = false", 6),
])
def test_nan_in_a_stored_column(h, test, n):
    """What a result stores is compared as the expression itself would be."""
    h.register("rates", h.query("SELECT cargo / hours AS rate, cargo / hours AS other FROM visit"))
    assert ask(h, f"SELECT count(*) FROM rates WHERE {test}") == [(n,)]
    assert ask(h, f"SELECT count(*) FROM rates WHERE ({test}) = true") == [(n,)]


def test_nan_keys_join_nothing(h):
    for t in ("one", "two"):
        h.register(t, h.query("SELECT visit_id AS id, cargo / hours AS rate FROM visit"))
    assert sorted(ask(h, "SELECT one.id, two.id FROM one JOIN two ON one.rate = two.rate")) == [(k, k) for k in (1, 2, 4, 5)]


def test_null_counts_as_false_inside_and_or(h):
    got = ask(h, "SELECT name, (crew > 10 AND laid_up = false) AS a, (crew > 20 OR laid_up) AS o, crew > 10 AS c FROM ship ORDER BY name")
    assert got == [("Alma", True, False, True), ("Bris", False, False, False), ("Corva", False, True, None), ("Dune", False, True, True), ("Eos", True, True, True)]


@pytest.mark.parametrize("bad", ["crew < name", "name + 1", "flag * 2", "-name", "laid_up > 2", "crew AND laid_up", "laid_up OR 1", "crew", "name", "laid_up + 1 > 0"])
def test_types_are_strict(h, bad):
    with pytest.raises(BinderError):
        h.query(f"SELECT imo FROM ship WHERE {bad}")


def test_equality_across_types_never_holds(h):
    assert ask(h, "SELECT crew = name, crew <> name FROM ship WHERE name <> 'Corva' LIMIT 1") == [(False, True)]
    assert ask(h, "SELECT crew = name, crew <> name FROM ship WHERE name = 'Corva'") == [(None, None)]


# ---------------------------------------------------------------- aggregates


def test_aggregates_of_a_table(h):
    sql = "SELECT count(*), count(crew), sum(crew), avg(crew), min(tons), max(name), sum(imo), sum(tons) FROM ship"
    assert ask(h, sql) == [(5, 4, 71, 17.75, 730.0, "Eos", 45015, 102131.0)]
    assert kinds(h, sql) == ["bigint", "bigint", "bigint", "double", "double", "string", "bigint", "double"]
    assert ask(h, "SELECT count(*), sum(crew), avg(tons), min(name) FROM ship WHERE crew > 1000") == [(0, None, None, None)]


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT flag, count(*) FROM ship GROUP BY flag ORDER BY flag", [(None, 1), ("GR", 1), ("NO", 2), ("PT", 1)]),
    ("SELECT berth AS b, sum(cargo) * 10 AS c FROM visit GROUP BY b ORDER BY c DESC LIMIT 2", [("B9", 9000), ("B2", 590)]),
    ("SELECT cargo / 10 > 1 AS big, count(*) AS n FROM visit GROUP BY cargo / 10 > 1 ORDER BY n", [(True, 3), (False, 4)]),
    ("SELECT imo - 9000, max(hours) - min(hours) FROM visit GROUP BY 1 ORDER BY 1 DESC LIMIT 2", [(99, 0.0), (5, 0.0)]),
    ("SELECT berth FROM visit GROUP BY berth ORDER BY berth", [("B2",), ("B3",), ("B9",)]),
    ("SELECT berth, imo, count(*) AS n FROM visit GROUP BY berth, imo ORDER BY n DESC, berth, imo LIMIT 2", [("B2", 9002, 2), ("B2", 9001, 1)]),
    ("SELECT sum(cargo) / count(*) + 1 AS mean FROM visit WHERE berth = 'B2' GROUP BY berth", [(15.75,)]),
    ("SELECT flag, count(*) FROM ship WHERE crew > 1000 GROUP BY flag", []),
])
def test_groups(h, sql, want):
    assert ask(h, sql) == want


@pytest.mark.parametrize("bad", [
    "SELECT flag, max(crew) FROM ship", "SELECT crew FROM ship GROUP BY flag", "SELECT * FROM ship GROUP BY imo", "SELECT sum(flag) FROM ship", "SELECT avg(laid_up) FROM ship", "SELECT max(*) FROM ship", "SELECT min(crew, imo) FROM ship",
    "SELECT count(max(crew)) FROM ship", "SELECT flag FROM ship WHERE max(crew) > 3", "SELECT count(*) FROM ship GROUP BY avg(crew)", "SELECT knots(crew) FROM ship", "SELECT keel FROM ship", "SELECT visit.crew FROM ship",
    "SELECT name FROM ship ORDER BY crew", "SELECT name FROM ship ORDER BY 2", "SELECT name FROM ship WHERE tons", "SELECT flag, crew + 1 FROM ship GROUP BY flag", "SELECT cosine_distance(crew, crew) FROM ship", "SELECT name FROM ship GROUP BY 4",
])
def test_what_the_binder_refuses(h, bad):
    with pytest.raises((BinderError, ParserError)):
        h.query(bad)


# ---------------------------------------------------------------- joins


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT visit_id, name FROM visit JOIN ship ON visit.imo = ship.imo ORDER BY visit_id", [(1, "Alma"), (2, "Alma"), (3, "Bris"), (4, "Eos"), (7, "Bris")]),
    ("SELECT visit_id, depth FROM visit INNER JOIN berth ON code = berth ORDER BY 1, 2", [(1, 9.5), (2, 7.0), (2, 7.25), (3, 9.5), (5, 9.5), (6, 7.0), (6, 7.25), (7, 9.5)]),
    ("SELECT visit_id FROM visit JOIN berth ON berth = code AND berth.imo = visit.imo", [(1,)]),
    ("SELECT flag, sum(cargo) AS c FROM ship JOIN visit ON ship.imo = visit.imo WHERE hours < 50 AND crew > 5 GROUP BY flag", [("NO", 52)]),
    ("SELECT visit_id FROM visit JOIN ship ON visit_id + 9000 = ship.imo AND cargo * 1 = crew * 0", [(2,)]),
    ("SELECT visit_id, code FROM visit JOIN berth ON hours = depth * 0 + 4", [(2, "B2"), (2, "B3"), (2, "B3")]),
    ("SELECT visit_id FROM visit JOIN ship ON cargo = name", []),
])
def test_joins(h, sql, want):
    assert sorted(ask(h, sql)) == want


def test_star_of_a_join_keeps_both_sides_names(h):
    assert h.query("SELECT * FROM berth JOIN ship ON berth.imo = ship.imo").columns[:5] == ["berth.code", "berth.depth", "berth.imo", "ship.imo", "ship.name"]
    assert ask(h, "SELECT * FROM berth JOIN ship ON berth.imo = ship.imo WHERE depth > 8")[0][:5] == ("B2", 9.5, 9001, 9001, "Alma")


def test_many_to_many(s):
    for t, n in (("tug", 17), ("rope", 230)):
        s.query(f"CREATE TABLE {t} (colour INTEGER)")
        s.append(t, [(k % 2,) for k in range(n)])
    assert ask(s, "SELECT count(*) FROM tug JOIN rope ON tug.colour = rope.colour") == [(9 * 115 + 8 * 115,)]


@pytest.mark.parametrize("on", ["visit.imo < ship.imo", "visit.imo = 9001", "visit.imo = cargo", "visit.imo = ship.imo OR laid_up", "visit.imo + crew = ship.imo", "laid_up"])
def test_join_conditions_are_equalities_between_sides(h, on):
    with pytest.raises(BinderError):
        h.query(f"SELECT * FROM visit JOIN ship ON {on}")


@pytest.mark.parametrize(("sql", "error"), [
    ("SELECT imo FROM visit JOIN ship ON visit.imo = ship.imo", BinderError), ("SELECT * FROM ship JOIN ship ON ship.imo = ship.imo", BinderError),
    ("SELECT * FROM raft", CatalogError), ("SELECT * FROM ship JOIN raft ON ship.imo = raft.imo", CatalogError), ("INSERT INTO raft VALUES (1)", CatalogError),
])
def test_names_that_mean_nothing_or_two_things(h, sql, error):
    with pytest.raises(error):
        h.query(sql)


# ---------------------------------------------------------------- order and limit


@pytest.mark.parametrize(("order", "names"), [
    ("ORDER BY crew", "Corva Bris Alma Dune Eos"), ("ORDER BY crew DESC LIMIT 2", "Eos Dune"), ("ORDER BY tons DESC, name DESC", "Eos Corva Alma Bris Dune"),
    ("ORDER BY 3, 1 LIMIT 3", "Dune Eos Alma"), ("ORDER BY flag DESC, crew DESC LIMIT 99999999999", "Corva Alma Bris Eos Dune"), ("ORDER BY name LIMIT 0", ""),
])
def test_order(h, order, names):
    assert [r[0] for r in ask(h, f"SELECT name, crew, flag, tons FROM ship {order}")] == names.split()


def test_order_is_global(s):
    s.query("CREATE TABLE logbook (knot INTEGER, day BIGINT)")
    draw = random.Random(4)
    book = [(draw.randrange(50), day) for day in range(5003)]
    s.append("logbook", s.spark.createDataFrame(book, "a int, b long").repartition(9))
    assert ask(s, "SELECT knot, day FROM logbook ORDER BY knot DESC, day") == sorted(book, key=lambda r: (-r[0], r[1]))
    top = "SELECT day, knot FROM logbook ORDER BY knot, day DESC LIMIT 11"
    assert ask(s, top) == [(d, k) for k, d in sorted(book, key=lambda r: (r[0], -r[1]))[:11]]
    assert "TakeOrderedAndProject" in s.query(top)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [26, 70, 100, 101, 5000])
def test_limits_beyond_sparks_own(spark, monkeypatch, n):
    monkeypatch.setattr(relational, "MOST_ROWS", 25)
    df = relational.order_by(spark.range(0, 100, 1, 7).selectExpr("(id * 37) % 101 AS k"), ("k", True))
    want = [r.k for r in df.collect()]
    assert [r.k for r in relational.limit(df, n).collect()] == want[:n]


# ---------------------------------------------------------------- vectors

BUOYS = "INSERT INTO buoy VALUES ('n', [0, 4]), ('ne', [3, 4]), ('e', [2, 0]), ('sw', [-1, -1]), ('lost', null)"


@pytest.fixture
def buoys(s):
    s.query("CREATE TABLE buoy (name VARCHAR, at VECTOR(2))")
    s.query(BUOYS)
    return s


@pytest.mark.parametrize(("function", "point", "order"), [
    ("l2_distance", "[2, 1]", "e ne n sw"), ("array_distance", "[-2, 0]", "sw e n ne"), ("cosine_distance", "[0, 9]", "n ne e sw"), ("array_cosine_distance", "[-1, -1.5]", "sw e n ne"),
    ("negative_inner_product", "[1, 0.5]", "ne n e sw"), ("array_negative_inner_product", "[-3, 1]", "n sw ne e"),
])
def test_nearest_buoys(buoys, function, point, order):
    got = ask(buoys, f"SELECT name, {function}(at, {point}) AS d FROM buoy WHERE name <> 'lost' ORDER BY d, name")
    place = {"n": (0, 4), "ne": (3, 4), "e": (2, 0), "sw": (-1, -1)}
    x, y = map(float, point.strip("[]").split(","))
    plain = {
        "l2": lambda a, b: math.hypot(a - x, b - y), "co": lambda a, b: 1 - (a * x + b * y) / math.hypot(a, b) / math.hypot(x, y), "ne": lambda a, b: -(a * x + b * y),
    }[{"distance": "l2", "cosine_distance": "co", "negative_inner_product": "ne"}.get(function.removeprefix("array_"), function[:2])]
    want = sorted((round(plain(*p), 9), n) for n, p in place.items())
    assert [(round(d, 9), n) for n, d in got] == want
    assert order.split()[0] == got[0][0]


def test_null_and_zero_vectors(buoys):
    assert ask(buoys, "SELECT l2_distance(at, [1, 1]), cosine_distance(at, [1, 1]) FROM buoy WHERE name = 'lost'") == [(None, None)]
    with pytest.raises(ExecutionError):
        buoys.fetch("SELECT cosine_distance(at, [0, 0]) FROM buoy")
    assert ask(buoys, "SELECT max(l2_distance(at, [0, 0])), count(at) FROM buoy") == [(5.0, 4)]


@pytest.mark.parametrize("call", ["l2_distance(at, [1, 2, 3])", "cosine_distance(at)", "l2_distance(at, 4)", "negative_inner_product(at, null)", "l2_distance(name, at)", "at + at"])
def test_vector_calls_are_checked(buoys, call):
    with pytest.raises(BinderError):
        buoys.query(f"SELECT {call} FROM buoy")


def test_vectors_are_compared_grouped_and_joined(buoys):
    buoys.query("INSERT INTO buoy VALUES ('twin', [2, 0])")
    df = buoys.query("SELECT max(at) AS hi, min(at) AS lo FROM buoy WHERE at >= [-1, 0]")
    assert [tuple(r) for r in df.collect()] == [([3.0, 4.0], [0.0, 4.0])] and df.schema["hi"].metadata == {"vector_dim": 2}
    assert ask(buoys, "SELECT at, count(*) AS n FROM buoy GROUP BY at ORDER BY n DESC, at LIMIT 2") == [([2.0, 0.0], 2), (None, 1)]
    buoys.register("mark", df)
    assert buoys.table("mark").columns == [("hi", vector(2)), ("lo", vector(2))]
    assert ask(buoys, "SELECT name FROM buoy JOIN mark ON at = hi") == [("ne",)]


# ---------------------------------------------------------------- catalog, inserts, appends, shell

GOOD = (7, 2**40, 2, "rope", True, [1, 2.5])


def _crates(s):
    s.query("CREATE TABLE crate (n INTEGER, code BIGINT, kg DOUBLE, what VARCHAR, ok BOOLEAN, size VECTOR(2))")


@pytest.mark.parametrize("bad", ["(2.5, 1, 1, 'a', true, [1, 2])", "(9999999999, 1, 1, 'a', true, [1, 2])", "(1, 0.5, 1, 'a', true, [1, 2])", "(1, 1, 'a', 'a', true, [1, 2])", "(1, 1, 1, 7, true, [1, 2])", "(1, 1, 1, 'a', 0, [1, 2])", "(1, 1, 1, 'a', true, [1, 2, 3])", "(1, 1)"])
def test_an_insert_fits_or_stores_nothing(s, bad):
    _crates(s)
    s.query("INSERT INTO crate VALUES (1, 2, 3, 'x', true, [4, 5]), (-1, 3000000000, -0.5, '', false, [0, -1]), (null, null, null, null, null, null)")
    with pytest.raises(BinderError):
        s.query(f"INSERT INTO crate VALUES (5, 5, 5, 'fine', false, [5, 5]), {bad}")
    assert ask(s, "SELECT count(*), sum(n), max(code), sum(kg) FROM crate") == [(3, 0, 3000000000, 2.5)]


@pytest.mark.parametrize(("column", "value"), [(0, "oops"), (0, 1.0), (0, True), (0, 2**31), (1, 2**63), (1, "8"), (2, "2.5"), (2, False), (3, 5), (3, b"x"), (4, 1), (4, "true"), (5, [1]), (5, ["a", "b"]), (5, 3)])
def test_an_append_fits_or_stores_nothing(s, column, value):
    _crates(s)
    s.append("crate", [GOOD, (None,) * 6, (-(2**31), -(2**63), 0.5, "", False, (0, -1))])
    row = [*GOOD]
    row[column] = value
    with pytest.raises(BinderError):
        s.append("crate", [GOOD, tuple(row)])
    assert ask(s, "SELECT count(*), min(n), max(code), sum(kg) FROM crate") == [(3, -(2**31), 2**40, 2.5)]


def test_appended_frames_have_the_tables_types(s, spark):
    s.query("CREATE TABLE Shed (Bay INTEGER, Area VECTOR(2))")
    s.append("shed", spark.sql("SELECT CAST(id AS INT) AS x, array(1D, 2D) AS y FROM range(3)"))
    assert sorted(ask(s, "SELECT bay FROM shed")) == [(0,), (1,), (2,)] and s.tables() == ["shed"] and s.exists("SHED")
    for df in (spark.sql("SELECT 1L AS x, array(1D, 2D) AS y"), spark.sql("SELECT 1 AS x"), s.query("SELECT bay, [1, 2, 3] AS v FROM shed")):
        with pytest.raises(BinderError):
            s.append("shed", df)
    with pytest.raises(BinderError):
        s.append("shed", [(1,)])


@pytest.mark.parametrize(("sql", "error"), [("CREATE TABLE ship (x INTEGER)", CatalogError), ("CREATE TABLE SHIP (x INTEGER)", CatalogError), ("CREATE TABLE oar (x INTEGER, X DOUBLE)", BinderError)])
def test_tables_and_columns_have_one_name(h, sql, error):
    with pytest.raises(error):
        h.query(sql)


def test_parquet_is_opened_when_named(s, sf):
    s.register_parquet("absent", "/nowhere/at/all.parquet")
    s.register_parquet("Nation", f"{sf}/nation.parquet")
    assert s.tables() == ["absent", "nation"] and ask(s, "SELECT count(*) FROM nation") == [(25,)]
    with pytest.raises(CatalogError):
        s.register_parquet("NATION", f"{sf}/nation.parquet")


def test_plans_reach_the_scan(s, sf):
    for t in ("supplier", "nation"):
        s.register_parquet(t, f"{sf}/{t}.parquet")
    plan = s.query("SELECT n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 100 AND n_regionkey <= 3 OR s_acctbal > 500 AND n_regionkey <= 1 GROUP BY n_name")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<s_nationkey:int,s_acctbal:double>" in plan and "GreaterThan(s_acctbal,100.0)" in plan and "LessThanOrEqual(n_regionkey" in plan
    flipped = s.query("SELECT s_suppkey FROM supplier WHERE 250 < s_acctbal")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(s_acctbal,250.0)" in flipped


def test_values_on_the_screen():
    assert list(map(show_value, (None, 12.0, 0.125, False, [2.0, -0.5], "tar", -3, math.nan))) == ["NULL", "12.0", "0.125", "false", "[2.0, -0.5]", "tar", "-3", "nan"]
    assert show_table(["mast"], [(1,), (2,)]).splitlines()[-1] == "(2 rows)"


def test_shell(s):
    out = io.StringIO()
    lines = ["CREATE TABLE keg (litres INTEGER);", "INSERT INTO keg VALUES (30),", "  (12);", "SELECT max(litres) AS most FROM keg; rest", "SELECT gallons FROM keg;", "DROP keg;", ".tables", ".threads many", ".quit", "SELECT 5 FROM keg;", ""]
    cli.run(s, io.StringIO("\n".join(lines)), out)
    said = out.getvalue()
    assert all(x in said for x in ("| 30   |", "BinderError", "ParserError", "\nkeg\n", "commands:")) and "| 5" not in said
