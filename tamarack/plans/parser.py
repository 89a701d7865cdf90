"""Text to syntax trees: one statement, by recursive descent.

From loosest to tightest: OR, AND, one comparison, + and -, * and /, unary minus.  Keywords have any
case, strings no escapes, and nothing may follow the statement.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from tamarack.errors import BinderError, ParserError
from tamarack.plans.syntax import Binary, Call, ColumnRef, Constant, CreateTable, Expr, Insert, Item, Order, Select, Star, Statement
from tamarack.types import BIGINT, BOOLEAN, DOUBLE, INTEGER, SPELLINGS, VARCHAR, SqlType, vector

#: Words that can't name a table or column.
KEYWORDS = frozenset("select from where group by order limit as and or inner join on asc desc create table insert into values true false null".split())
_TOKEN = re.compile(r"\s*(?:(?P<number>[0-9]+(?:\.[0-9]+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<string>'[^']*')|(?P<sign><=|>=|<>|!=|[=<>+\-*/(),.\[\]])|(?P<end>$))")


class Token(NamedTuple):
    kind: str
    text: str
    at: int


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while True:
        m = _TOKEN.match(sql, at)
        if not m:
            at += len(sql[at:]) - len(sql[at:].lstrip())
            raise _error(sql, at, f"unexpected {sql[at]!r}")
        out.append(Token(m.lastgroup or "end", m[m.lastgroup], m.start(m.lastgroup)))
        if out[-1].kind == "end":
            return out
        at = m.end()


def _error(sql: str, at: int, message: str) -> ParserError:
    before = sql[:at]
    return ParserError(message, before.count("\n") + 1, at - (before.rfind("\n") + 1) + 1)


class Parser:
    def __init__(self, sql: str) -> None:
        self.sql, self.tokens, self.k = sql, tokenize(sql), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def fail(self, wanted: str) -> ParserError:
        return _error(self.sql, self.now.at, f"expected {wanted}, found {self.now.text or 'the end'!r}")

    def next_is(self, *words: str) -> bool:
        """Whether these keywords or signs come next."""
        ahead = self.tokens[self.k : self.k + len(words)]
        return len(ahead) == len(words) and all(t.kind in ("word", "sign") and t.text.lower() == w for t, w in zip(ahead, words, strict=True))

    def take(self, *words: str) -> bool:
        if found := self.next_is(*words):
            self.k += len(words)
        return found

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(" ".join(words).upper())

    def name(self) -> str:
        if self.now.kind != "word" or self.now.text.lower() in KEYWORDS:
            raise self.fail("a name")
        self.k += 1
        return self.tokens[self.k - 1].text

    def some(self, part: Callable) -> tuple:
        out = [part()]
        while self.take(","):
            out.append(part())
        return tuple(out)

    def statement(self) -> Statement:
        if self.take("select"):
            out: Statement = self.select()
        elif self.take("create", "table"):
            name = self.name()
            self.need("(")
            out = CreateTable(name, self.some(lambda: (self.name(), self.type())))
            self.need(")")
        elif self.take("insert", "into"):
            name = self.name()
            self.need("values")
            out = Insert(name, self.some(self.row))
        else:
            raise self.fail("SELECT, CREATE TABLE or INSERT INTO")
        if self.now.kind != "end":
            raise self.fail("the end")
        return out

    def select(self) -> Select:
        items = self.some(self.item)
        self.need("from")
        table, join = self.name(), None
        if self.next_is("join") or self.next_is("inner"):
            self.take("inner")
            self.need("join")
            other = self.name()
            self.need("on")
            join = (other, self.expression())
        where = self.expression() if self.take("where") else None
        groups = self.some(self.expression) if self.take("group", "by") else ()
        orders = self.some(self.order) if self.take("order", "by") else ()
        limit = None
        if self.take("limit"):
            if self.now.kind != "number" or "." in self.now.text:
                raise self.fail("a whole number")
            limit = int(self.now.text)
            self.k += 1
        return Select(items, table, join, where, groups, orders, limit)

    def item(self) -> Item:
        if self.take("*"):
            return Item(Star())
        expr = self.expression()
        if self.take("as"):
            return Item(expr, self.name())
        return Item(expr, self.name() if self.now.kind == "word" and self.now.text.lower() not in KEYWORDS else None)

    def order(self) -> Order:
        expr = self.expression()
        return Order(expr, not self.take("desc") if not self.take("asc") else True)

    def type(self) -> SqlType:
        word = self.now
        if word.kind == "word" and word.text.lower() == "vector":
            self.k += 1
            self.need("(")
            if self.now.kind != "number" or "." in self.now.text:
                raise self.fail("a dimension")
            try:
                out = vector(int(self.now.text))
            except BinderError as e:
                raise _error(self.sql, self.now.at, str(e)) from None
            self.k += 1
            self.need(")")
            return out
        if word.kind != "word" or word.text.lower() not in SPELLINGS:
            raise self.fail("a type")
        self.k += 1
        return SPELLINGS[word.text.lower()]

    def row(self) -> tuple[Constant, ...]:
        self.need("(")
        out = self.some(self.literal)
        self.need(")")
        return out

    def literal(self) -> Constant:
        minus = self.next_is("-") and self.tokens[self.k + 1].kind == "number"
        self.k += minus
        found = self.constant()
        if found is None:
            raise self.fail("a literal")
        return Constant(-found.value, found.type) if minus else found

    def expression(self) -> Expr:
        return self.chain(("or",), lambda: self.chain(("and",), self.comparison))

    def chain(self, ops: tuple[str, ...], part: Callable[[], Expr]) -> Expr:
        left = part()
        while (op := next((o for o in ops if self.take(o)), None)) is not None:
            left = Binary(op, left, part())
        return left

    def comparison(self) -> Expr:
        left = self.sum()
        for sign in ("<=", ">=", "<>", "!=", "=", "<", ">"):
            if self.take(sign):
                return Binary("<>" if sign == "!=" else sign, left, self.sum())
        return left

    def sum(self) -> Expr:
        return self.chain(("+", "-"), lambda: self.chain(("*", "/"), self.unary))

    def unary(self) -> Expr:
        if self.take("-"):
            return Binary("-", Constant(0, INTEGER), self.unary())
        return self.primary()

    def constant(self) -> Constant | None:
        t = self.now
        if t.kind == "number":
            self.k += 1
            if "." in t.text:
                return Constant(float(t.text), DOUBLE)
            value = int(t.text)
            if value >= 2**63:
                raise _error(self.sql, t.at, "number out of range")
            return Constant(value, INTEGER if value < 2**31 else BIGINT)
        if t.kind == "string":
            self.k += 1
            return Constant(t.text[1:-1], VARCHAR)
        for word, value, kind in (("true", True, BOOLEAN), ("false", False, BOOLEAN), ("null", None, INTEGER)):
            if self.take(word):
                return Constant(value, kind)
        if self.take("["):
            values = self.some(self.element)
            self.need("]")
            return Constant(values, vector(len(values)))
        return None

    def element(self) -> float:
        minus = self.take("-")
        if self.now.kind != "number":
            raise self.fail("a number")
        self.k += 1
        value = float(self.tokens[self.k - 1].text)
        return -value if minus else value

    def primary(self) -> Expr:
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        if (found := self.constant()) is not None:
            return found
        name = self.name()
        if self.take("("):
            args: tuple[Expr, ...] = ()
            if self.take("*"):
                args = (Star(),)
            elif not self.next_is(")"):
                args = self.some(self.expression)
            self.need(")")
            return Call(name, args)
        return ColumnRef(self.name(), name) if self.take(".") else ColumnRef(name)


def parse(sql: str) -> Statement:
    return Parser(sql).statement()
