"""The filter language, compiled to one Column.

    expr := and ('||' and)*      and := unary ('&&' unary)*
    unary := '(' expr ')' | field ':' value | field ':' [a, b] | field ':' [lo..hi] | field ':' (> >= < <=) number
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfire.functions.coerce import number, string, to_number

_TOKEN = re.compile(
    r'[ \t\n]+|(?P<op>&&|\|\||\.\.|>=|<=|[()\[\],:<>])|"(?P<quoted>[^"]*)"|(?P<open>")|(?P<bare>(?:(?!&&|\|\||\.\.)[^ \t\n()\[\],:<>"])+)'
)


class FilterError(ValueError):
    """A filter can't be read."""


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, value) of each token; kind is the operator itself or ``val``."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected character {text[at]!r} in filter")
        at = m.end()
        if m["open"]:
            raise FilterError("unterminated quote in filter")
        if m["op"]:
            out.append((m["op"], m["op"]))
        elif m["quoted"] is not None or m["bare"]:
            out.append(("val", m["quoted"] if m["quoted"] is not None else m["bare"]))
    return out


class _Reader:
    def __init__(self, text: str, types: Mapping[str, str]):
        self.tokens, self.at, self.types = lex(text), 0, types

    def peek(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self, kind: str, what: str) -> str:
        if self.peek() != kind:
            raise FilterError(f"expected {what} in filter")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def chain(self, op: str, inner):
        node = inner()
        while self.peek() == op:
            self.at += 1
            node = ("or" if op == "||" else "and", node, inner())
        return node

    def expr(self):
        return self.chain("||", lambda: self.chain("&&", self.unary))

    def unary(self):
        if self.peek() == "(":
            self.at += 1
            node = self.expr()
            self.take(")", "')'")
            return node
        name = self.take("val", "a field name")
        if name not in self.types:
            raise FilterError(f"unknown filter field {name!r}")
        self.take(":", "':'")
        return self.matcher(name, self.types[name])

    def num(self, name: str, text: str) -> float:
        value = to_number(text)
        if math.isnan(value):
            raise FilterError(f"{text!r} is no number, as field {name!r} needs")
        return value

    def matcher(self, name: str, kind: str):
        numeric = kind == "number"
        if self.peek() == "[":
            self.at += 1
            first = self.take("val", "a value")
            if self.peek() == "..":
                self.at += 1
                second = self.take("val", "a value")
                self.take("]", "']'")
                if not numeric:
                    raise FilterError(f"a range needs a number field, {name!r} is none")
                return ("range", name, self.num(name, first), self.num(name, second))
            values = [first]
            while self.peek() == ",":
                self.at += 1
                values.append(self.take("val", "a value"))
            self.take("]", "']'")
            return ("in", name, kind, [self.num(name, v) if numeric else v for v in values])
        if (op := self.peek()) in (">", ">=", "<", "<="):
            self.at += 1
            if not numeric:
                raise FilterError(f"a comparison needs a number field, {name!r} is none")
            return ("cmp", name, op, self.num(name, self.take("val", "a value")))
        value = self.take("val", "a value")
        return ("in", name, kind, [self.num(name, value) if numeric else value])


def parse(text: str, types: Mapping[str, str]):
    """The syntax tree as nested tuples; FilterError where there is none."""
    r = _Reader(text, types)
    node = r.expr()
    if r.peek() is not None:
        raise FilterError("the filter goes on after its end")
    return node


def _operand(df: DataFrame, name: str):
    """(column to compare, converter of literals, guard).  A column whose type
    fits is left bare, so the comparison reaches the Parquet reader."""
    kind = df.schema[name].dataType if name in df.columns else None
    bare = F.col(f"`{name}`")
    if isinstance(kind, T.DoubleType):
        return bare, float, ~F.isnan(bare)
    if isinstance(kind, T.IntegralType):
        return bare, lambda v: int(v) if v == v // 1 and abs(v) < 2**31 else float(v), None
    return number(df, name), float, None


def column(df: DataFrame, node) -> Column:
    """The predicate of a syntax tree; a missing value satisfies nothing."""
    if node[0] in ("and", "or"):
        left, right = column(df, node[1]), column(df, node[2])
        return left & right if node[0] == "and" else left | right
    if node[0] == "in" and node[2] == "string":
        return string(df, node[1]).isin(node[3]) if len(node[3]) > 1 else string(df, node[1]) == node[3][0]
    col, lit, guard = _operand(df, node[1])
    if node[0] == "in":
        out = col.isin([lit(v) for v in node[3]]) if len(node[3]) > 1 else col == lit(node[3][0])
    elif node[0] == "range":
        out = col.between(lit(node[2]), lit(node[3]))
    else:
        v = lit(node[3])
        out = {">": col > v, ">=": col >= v, "<": col < v, "<=": col <= v}[node[2]]
    return out if guard is None else out & guard


def compile_filter(df: DataFrame, text: str, types: Mapping[str, str]) -> Column:
    """``text`` as a predicate over ``df``."""
    return column(df, parse(text, types))
