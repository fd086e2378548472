"""Rank formulas: {column}, numbers, + and *, parentheses, coalesce(expr, number), {vector_score}; compiled to a Column.

NULL goes through + and *; booleans count as 0 and 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemo.errors import RankPolicyInvalid

_TOKEN = re.compile(r"\s*(?:(?P<col>\{\s*\w+\s*\})|(?P<num>-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<name>coalesce)\b|(?P<op>[+*(),]))", re.I)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise RankPolicyInvalid(f"cannot read the formula at {text[at:]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup).strip("{} ") if m.lastgroup == "col" else m.group(m.lastgroup).lower()))
        at = m.end()
    return out


class Formula:
    def __init__(self, text: str):
        self.text, self._left = text, _tokens(text)
        self.columns: list[str] = []
        self._tree = self._sum()
        if self._left:
            raise RankPolicyInvalid(f"unexpected {self._left[0][1]!r} in the formula")

    def _take(self, value: str | None = None):
        if not self._left or (value is not None and self._left[0][1] != value):
            raise RankPolicyInvalid(f"expected {value or 'a value'} in {self.text!r}")
        return self._left.pop(0)

    def _next(self, value: str) -> bool:
        return bool(self._left) and self._left[0] == ("op", value)

    def _sum(self):
        out = self._product()
        while self._next("+"):
            self._take()
            out = ("+", out, self._product())
        return out

    def _product(self):
        out = self._value()
        while self._next("*"):
            self._take()
            out = ("*", out, self._value())
        return out

    def _value(self):
        kind, text = self._take()
        if kind == "num":
            return ("num", float(text))
        if kind == "col":
            if text not in self.columns:
                self.columns.append(text)
            return ("col", text)
        if kind == "name":
            self._take("(")
            inner = self._sum()
            self._take(",")
            kind, number = self._take()
            if kind != "num":
                raise RankPolicyInvalid("coalesce takes an expression and a number")
            self._take(")")
            return ("coalesce", inner, float(number))
        if text == "(":
            inner = self._sum()
            self._take(")")
            return inner
        raise RankPolicyInvalid(f"unexpected {text!r} in the formula")

    def column(self, resolve) -> Column:
        """The formula over resolve(name) -> Column."""

        def build(t) -> Column:
            if t[0] == "num":
                return F.lit(t[1])
            if t[0] == "col":
                return resolve(t[1]).cast("double")
            if t[0] == "coalesce":
                return F.coalesce(build(t[1]), F.lit(t[2]))
            return build(t[1]) + build(t[2]) if t[0] == "+" else build(t[1]) * build(t[2])

        return build(self._tree)
