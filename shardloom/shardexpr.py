"""Shard expressions: a small arithmetic language over key columns.

`$0`, `$1`, … (or `$value` for `$0`) are the key columns; `+ - * / %`, unary
minus, parentheses, `parseInt`, `Math.floor/abs/ceil/trunc` and number literals.
`/` divides as doubles, `%` keeps the dividend's sign, the result is truncated.
One syntax tree gives a Python function (for pruning on the driver) and a Spark
SQL expression (for writing and for the layout identity).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|(\$\w+)|([A-Za-z_][\w.]*)|([-+*/%(),]))")
_FUNCTIONS = {"parseint": "trunc", "math.trunc": "trunc", "math.floor": "floor", "math.ceil": "ceil", "math.abs": "abs"}


class ShardExpressionError(ValueError):
    """The text is outside the supported language; register a Python function instead."""


class _Parser:
    def __init__(self, text: str):
        body = re.sub(r"^\s*return\b", "", text.strip().rstrip(";"))
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(body):
            if not body[at:].strip():
                break
            m = _TOKEN.match(body, at)
            if not m:
                raise ShardExpressionError(f"unsupported shard expression: {text!r}")
            kind = ("num", "var", "name", "op")[m.lastindex - 1]
            self.items.append((kind, m[m.lastindex]))
            at = m.end()
        self.at, self.text = 0, text

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.items) or (want and self.peek() != want):
            raise ShardExpressionError(f"unsupported shard expression: {self.text!r}")
        self.at += 1
        return self.items[self.at - 1]

    def sum(self):
        left = self.product()
        while self.peek() in ("+", "-"):
            left = (self.take()[1], left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.peek() in ("*", "/", "%"):
            left = (self.take()[1], left, self.unary())
        return left

    def unary(self):
        if self.peek() == "-":
            self.take()
            return ("neg", self.unary())
        if self.peek() == "+":
            self.take()
            return self.unary()
        kind, value = self.take()
        if kind == "num":
            return ("lit", float(value) if "." in value else int(value))
        if kind == "var":
            name = value[1:]
            if name != "value" and not name.isdigit():
                raise ShardExpressionError(f"unknown variable {value} in {self.text!r}")
            return ("var", 0 if name == "value" else int(name))
        if kind == "name" and value.lower() in _FUNCTIONS:
            self.take("(")
            inner = self.sum()
            if self.peek() == ",":  # parseInt(x, 10)
                self.take()
                self.take()
            self.take(")")
            return (_FUNCTIONS[value.lower()], inner)
        if value == "(":
            inner = self.sum()
            self.take(")")
            return inner
        raise ShardExpressionError(f"unsupported shard expression: {self.text!r}")


def _number(x: Any) -> int | float:
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (int, float)):
        return x
    try:
        text = str(x).strip()
        return int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text)
    except ValueError:
        raise ShardExpressionError(f"not a number: {x!r}") from None


@dataclass(frozen=True)
class ShardExpression:
    text: str
    tree: tuple

    @classmethod
    def parse(cls, text: str) -> ShardExpression:
        p = _Parser(text)
        tree = p.sum()
        if p.peek() is not None:
            raise ShardExpressionError(f"unsupported shard expression: {text!r}")
        return cls(text, tree)

    @property
    def variables(self) -> set[int]:
        def walk(t):
            return {t[1]} if t[0] == "var" else set() if t[0] == "lit" else set().union(*(walk(x) for x in t[1:]))

        return walk(self.tree)

    def evaluate(self, *values: Any) -> int | None:
        """None where the result is no number (a zero divisor)."""

        def go(t):
            op = t[0]
            if op == "lit":
                return t[1]
            if op == "var":
                return _number(values[t[1]])
            x = go(t[1])
            if x is None:
                return None
            if op in ("neg", "trunc", "floor", "ceil", "abs"):
                return {"neg": lambda v: -v, "trunc": math.trunc, "floor": math.floor, "ceil": math.ceil, "abs": abs}[op](x)
            y = go(t[2])
            if y is None or (op in "/%" and y == 0):
                return None
            if op == "/":
                return x / y
            if op == "%":
                return int(math.copysign(abs(x) % abs(y), x)) if isinstance(x, int) and isinstance(y, int) else math.fmod(x, y)
            return x + y if op == "+" else x - y if op == "-" else x * y

        got = go(self.tree)
        return None if got is None else math.trunc(got)

    def sql(self, *columns: str) -> str:
        def go(t):
            op = t[0]
            if op == "lit":
                return f"{t[1]}D" if isinstance(t[1], float) else f"CAST({t[1]} AS BIGINT)"
            if op == "var":
                return f"`{columns[t[1]]}`"
            x = go(t[1])
            if op in ("neg", "abs", "floor", "ceil"):
                return f"(-{x})" if op == "neg" else f"{op}({x})"
            if op == "trunc":
                return f"CAST({x} AS BIGINT)"
            y = go(t[2])
            if op == "/":
                return f"try_divide(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))"
            return f"try_mod({x}, {y})" if op == "%" else f"({x} {op} {y})"

        return f"CAST({go(self.tree)} AS BIGINT)"
