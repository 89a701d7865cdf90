import pytest

from tamarack.errors import ParserError
from tamarack.plans.parser import parse
from tamarack.plans.syntax import Binary, Call, ColumnRef, Constant, CreateTable, Insert, Item, Order, Select, Star
from tamarack.types import BIGINT, BOOLEAN, DOUBLE, INTEGER, VARCHAR, vector


def one(expr):
    return parse(f"SELECT {expr} FROM t").items[0].expr


def num(v):
    return Constant(v, INTEGER)


A, B, COL_C = ColumnRef("a"), ColumnRef("b"), ColumnRef("c")


def test_select_lists():
    assert parse("SELECT * FROM quay") == Select((Item(Star()),), "quay")
    assert parse("SELECT a AS x, t.c, b y FROM t").items == (Item(A, "x"), Item(ColumnRef("c", "t")), Item(B, "y"))


@pytest.mark.parametrize("sign", ["=", "<>", "<", "<=", ">", ">="])
def test_comparisons(sign):
    assert parse(f"SELECT a FROM t WHERE b {sign}a").where == Binary(sign, B, A)
    assert parse("SELECT a FROM t WHERE 4!=c").where == Binary("<>", num(4), COL_C)


@pytest.mark.parametrize(("text", "same"), [
    ("a * b - c / 4", "(a * b) - (c / 4)"), ("a / b / c", "(a / b) / c"), ("a - b + c - 2", "((a - b) + c) - 2"), ("6 < a * b + c", "6 < ((a * b) + c)"), ("a < 2 and b > 3 or c <> 4", "((a < 2) and (b > 3)) or (c <> 4)"),
    ("a < 2 or b > 3 and c <> 4 or a = b", "((a < 2) or ((b > 3) and (c <> 4))) or (a = b)"), ("-a * b", "(-a) * b"), ("- -7", "0 - (0 - 7)"), ("a - -b", "a - (0 - b)"), ("((c))", "c"),
])
def test_precedence(text, same):
    assert one(text) == one(same) and (text == "((c))") == (one(text) == COL_C)


def test_parentheses_change_the_tree():
    assert one("a * (b - c)") == Binary("*", A, Binary("-", B, COL_C)) != one("a * b - c")
    assert one("a = 9 and (b = 8 or c = 7)").right.op == "or"


def test_literals():
    assert one("-12") == Binary("-", num(0), num(12))
    assert [one(x) for x in ("0.25", "'salt water'", "false", "NULL")] == [Constant(0.25, DOUBLE), Constant("salt water", VARCHAR), Constant(False, BOOLEAN), Constant(None, INTEGER)]
    assert [one(x).type for x in ("2147483647", "2147483648")] == [INTEGER, BIGINT]
    assert one("[-0.5, 8]") == Constant((-0.5, 8.0), vector(2))


def test_calls():
    assert one("depth()") == Call("depth", ()) and one("COUNT(*)").args == (Star(),) and one("f(b, g(2), a)") == Call("f", (B, Call("g", (num(2),)), A))


def test_clauses():
    s = parse("SELECT c, max(a) FROM t GROUP BY c, b ORDER BY 2 DESC, c, b ASC LIMIT 12")
    assert s.groups == (COL_C, B) and s.limit == 12 and s.orders == (Order(num(2), False), Order(COL_C), Order(B))
    s = parse("select a from t join u on t.a = u.b and u.c = b where c < 3")
    assert s.join == ("u", Binary("and", Binary("=", ColumnRef("a", "t"), ColumnRef("b", "u")), Binary("=", ColumnRef("c", "u"), B))) and s.where == Binary("<", COL_C, num(3))
    assert parse("SELECT a FROM Wharf").table == "Wharf"


def test_create_and_insert():
    kinds = parse("create table hold (deck text, weight REAL, no BIGINT, shut bool, spot Vector(5), row int)")
    assert kinds == CreateTable("hold", (("deck", VARCHAR), ("weight", DOUBLE), ("no", BIGINT), ("shut", BOOLEAN), ("spot", vector(5)), ("row", INTEGER)))
    assert parse("INSERT INTO hold VALUES (null, -4), ('aft', 2.5)") == Insert("hold", ((Constant(None, INTEGER), num(-4)), (Constant("aft", VARCHAR), Constant(2.5, DOUBLE))))


@pytest.mark.parametrize("sql", [
    "SELCT 1 FROM t", "SELECT FROM", "SELECT 1", "SELECT a FROM t WHERE", "SELECT a FROM t LIMIT x", "SELECT a FROM t LIMIT 1.5", "SELECT a < b < c FROM t", "SELECT a FROM t;", "SELECT a FROM t x y",
    "CREATE TABLE x (a BLOB)", "CREATE TABLE x (a VECTOR(0))", "CREATE TABLE x ()", "INSERT INTO t VALUES (a)", "SELECT [] FROM t", "SELECT 'it''s' 'x' FROM t", "SELECT select FROM t", "", "SELECT a FROM a.b", 'SELECT "a" FROM t',
    "SELECT a FROM t OFFSET 3", "SELECT 99999999999999999999 FROM t",
])
def test_syntax_errors(sql):
    with pytest.raises(ParserError):
        parse(sql)


def test_errors_name_their_place():
    with pytest.raises(ParserError) as e:
        parse("SELECT a\nFROM t WHERE")
    assert (e.value.line, e.value.column) == (2, 13)
