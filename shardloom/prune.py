"""Shard pruning: from a predicate to the shards that may hold matching rows.

The answer is ALL (None) or a finite set; it always contains every shard that
holds a matching row. Unknown leaves stay unknown under negation, which is
pushed to the leaves first.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import Any

from .catalog import LogicalTable, Shard

#: Key tuples evaluated at most for one conjunction; beyond, all shards stay.
MAX_ENUM = 10_000


@dataclass(frozen=True)
class Cmp:
    column: str
    op: str  # = <> < <= > >=
    value: Any


@dataclass(frozen=True)
class In:
    column: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Const:
    value: bool


class _Unknown:
    def __repr__(self) -> str:
        return "UNKNOWN"


UNKNOWN = _Unknown()
_FLIP = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def between(column: str, low: Any, high: Any) -> And:
    return And((Cmp(column, ">=", low), Cmp(column, "<=", high)))


def push_not(p: Any, negate: bool = False) -> Any:
    if isinstance(p, Not):
        return push_not(p.part, not negate)
    if isinstance(p, (And, Or)):
        kind = (Or if isinstance(p, And) else And) if negate else type(p)
        return kind(tuple(push_not(x, negate) for x in p.parts))
    if not negate or p is UNKNOWN:
        return p
    if isinstance(p, Cmp):
        return Cmp(p.column, _FLIP[p.op], p.value)
    if isinstance(p, In):
        return In(p.column, p.values, not p.negated)
    return Const(not p.value)


class _Domain:
    """What a conjunction says about one column."""

    def __init__(self) -> None:
        self.values: set | None = None
        self.without: set = set()
        self.low: tuple[Any, bool] | None = None  # bound, closed
        self.high: tuple[Any, bool] | None = None

    def admits(self, v: Any) -> bool:
        try:
            return v not in self.without and (self.low is None or v > self.low[0] or (self.low[1] and v == self.low[0])) and (self.high is None or v < self.high[0] or (self.high[1] and v == self.high[0]))
        except TypeError:
            return True

    def only(self, values) -> None:
        self.values = set(values) if self.values is None else self.values & set(values)

    def bound(self, op: str, v: Any) -> None:
        try:
            if op[0] == ">" and (self.low is None or v > self.low[0] or (v == self.low[0] and op == ">")):
                self.low = (v, op == ">=")
            elif op[0] == "<" and (self.high is None or v < self.high[0] or (v == self.high[0] and op == "<")):
                self.high = (v, op == "<=")
        except TypeError:
            pass

    def finite(self) -> set | None:
        """The values the column can take; None if they can't be listed."""
        if self.values is not None:
            return {v for v in self.values if self.admits(v)}
        if self.low is None or self.high is None:
            return None
        (a, ca), (b, cb) = self.low, self.high
        if isinstance(a, str) or isinstance(b, str):
            return None
        # keys are whole numbers only if the bounds are; otherwise values between them exist
        if not (isinstance(a, int) and isinstance(b, int)):
            return None
        first, last = a + (not ca), b - (not cb)
        if last - first >= MAX_ENUM:
            return None
        return {v for v in range(first, last + 1) if self.admits(v)}

    def empty(self) -> bool:
        if self.values is not None:
            return not any(self.admits(v) for v in self.values)
        if self.low is None or self.high is None:
            return False
        try:
            return self.low[0] > self.high[0] or (self.low[0] == self.high[0] and not (self.low[1] and self.high[1]))
        except TypeError:
            return False


def _key(v: Any) -> Any:
    """Numbers alike whatever their type; a numeric text is no number here."""
    return int(v) if isinstance(v, float) and v.is_integer() else v


def _conjunction(leaves: list[Any], table: LogicalTable, integral: set[str]) -> set[Shard] | None:
    domains: dict[str, _Domain] = {}
    for leaf in leaves:
        if isinstance(leaf, Const):
            if not leaf.value:
                return set()
        elif isinstance(leaf, Cmp):
            if leaf.value is None:
                return set()  # a comparison with NULL is never true
            d = domains.setdefault(leaf.column.lower(), _Domain())
            v = _key(leaf.value)
            if leaf.op == "=":
                d.only([v])
            elif leaf.op == "<>":
                d.without.add(v)
            else:
                d.bound(leaf.op, v)
        elif isinstance(leaf, In):
            d = domains.setdefault(leaf.column.lower(), _Domain())
            if leaf.negated:
                if any(v is None for v in leaf.values):
                    return set()
                d.without |= {_key(v) for v in leaf.values}
            else:
                d.only([_key(v) for v in leaf.values if v is not None])
    if any(d.empty() for d in domains.values()):
        return set()
    for vshard in table.vshards:
        keys = [c.lower() for c in vshard.columns]
        lists = []
        for c in keys:
            d = domains.get(c)
            # an interval lists its values only for a whole-number column
            got = None if d is None or (d.values is None and c not in integral) else d.finite()
            if got is None:
                break
            lists.append(sorted(got, key=repr))
        else:
            n = 1
            for own in lists:
                n *= len(own)
            if n > MAX_ENUM:
                continue
            out = set()
            try:
                for values in itertools.product(*lists):
                    shard = table.locate(vshard, {c: values[keys.index(c.lower())] for c in vshard.columns})
                    if shard is not None:
                        out.add(shard)
            except ValueError:  # a key the expression cannot take, such as a text
                continue
            return out
    return None


def prune(predicate: Any, table: LogicalTable, integral: set[str] | None = None) -> set[Shard] | None:
    """Shards that may hold rows for which `predicate` is true; None is all of them.

    `integral`: key columns known to hold whole numbers (all, if not given).
    """
    whole = table.shard_keys() if integral is None else {c.lower() for c in integral}

    def conjuncts(p: Any) -> list[Any]:
        return [x for q in p.parts for x in conjuncts(q)] if isinstance(p, And) else [p]

    def go(p: Any) -> set[Shard] | None:
        if isinstance(p, Or):
            out: set[Shard] = set()
            for q in p.parts:
                got = go(q)
                if got is None:
                    return None
                out |= got
            return out
        parts = conjuncts(p)
        simple = [q for q in parts if isinstance(q, (Cmp, In, Const))]
        ors = [q for q in parts if isinstance(q, Or)]
        sets = [s for q in ors if (s := go(q)) is not None]
        # an OR of equalities of one column narrows that column
        simple += [In(c, v) for q in ors if (c := _values_of(q)[0]) for v in [_values_of(q)[1]]]
        first = _conjunction(simple, table, whole)
        sets += [first] if first is not None else []
        return set.intersection(*sets) if sets else None

    return go(push_not(predicate))


def _values_of(p: Or) -> tuple[str | None, tuple]:
    """Column and values of an OR that only lists values of one column."""
    columns, values = set(), []
    for q in p.parts:
        if isinstance(q, Cmp) and q.op == "=":
            columns.add(q.column.lower())
            values.append(q.value)
        elif isinstance(q, In) and not q.negated:
            columns.add(q.column.lower())
            values += q.values
        else:
            return None, ()
    return (columns.pop(), tuple(values)) if len(columns) == 1 else (None, ())


def render(shards: set[Shard] | None) -> str:
    """`*`, `[]` or `[0:1,2;1:4]`."""
    if shards is None:
        return "*"
    by: dict[int, list[int]] = {}
    for d, t in sorted(shards):
        by.setdefault(d, []).append(t)
    return "[" + ";".join(f"{d}:{','.join(map(str, t))}" for d, t in by.items()) + "]"


def shard_filter(shards: set[Shard]) -> str:
    """SQL that keeps the partitions of `shards`."""
    by: dict[int, list[int]] = {}
    for d, t in sorted(shards):
        by.setdefault(d, []).append(t)
    return " OR ".join(f"(__db = {d} AND __tb IN ({', '.join(map(str, t))}))" for d, t in by.items()) or "FALSE"
