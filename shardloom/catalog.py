"""The sharding catalog: logical tables, their topology and shard rules."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from .shardexpr import ShardExpression

Shard = tuple[int, int]


@dataclass(frozen=True)
class NamePattern:
    """`name_${0000..0031}`: a range of names of equal width, or a constant name."""

    prefix: str
    width: int
    begin: int
    end: int
    suffix: str = ""

    @classmethod
    def parse(cls, text: str) -> NamePattern:
        m = re.fullmatch(r"(.*?)\$\{(\d+)\.\.\.?(\d+)\}(.*)", text)
        if not m:
            return cls(text, 0, -1, -1)
        if len(m[2]) != len(m[3]) or int(m[2]) > int(m[3]):
            raise ValueError(f"bad name pattern: {text}")
        return cls(m[1], len(m[2]), int(m[2]), int(m[3]), m[4])

    @property
    def count(self) -> int:
        return max(1, self.end - self.begin + 1)

    def render(self, index: int) -> str:
        return self.prefix if self.begin < 0 else f"{self.prefix}{index:0{self.width}d}{self.suffix}"


@dataclass(frozen=True)
class Topology:
    db_pattern: NamePattern
    tb_pattern: NamePattern
    grid: dict[int, tuple[int, ...]]

    @classmethod
    def of(cls, db_pattern: str, tb_pattern: str) -> Topology:
        """Tables are numbered through all databases, equally many in each."""
        db, tb = NamePattern.parse(db_pattern), NamePattern.parse(tb_pattern)
        if tb.count % db.count:
            raise ValueError(f"{tb.count} tables do not spread over {db.count} databases")
        per, first = tb.count // db.count, max(tb.begin, 0)
        grid = {max(db.begin, 0) + i: tuple(first + per * i + j for j in range(per)) for i in range(db.count)}
        return cls(db, tb, grid)

    def shards(self) -> list[Shard]:
        return [(d, t) for d, tables in sorted(self.grid.items()) for t in sorted(tables)]

    def exists(self, shard: Shard) -> bool:
        return shard[1] in self.grid.get(shard[0], ())

    def render(self, shard: Shard) -> tuple[str, str]:
        return self.db_pattern.render(shard[0]), self.tb_pattern.render(shard[1])

    def smallest(self) -> Shard:
        return self.shards()[0]


@dataclass(frozen=True)
class Rule:
    """Key columns, in the order of `$0, $1, …`, and an expression or a Python function of them."""

    columns: tuple[str, ...]
    expr: ShardExpression | Callable[..., int]
    step: int = 0

    @property
    def text(self) -> str:
        return self.expr.text if isinstance(self.expr, ShardExpression) else f"python:{self.expr.__name__}"

    def evaluate(self, values: dict[str, Any]) -> int | None:
        own = [values[c] for c in self.columns]
        return self.expr.evaluate(*own) if isinstance(self.expr, ShardExpression) else self.expr(*own)

    def sql(self) -> str | None:
        return self.expr.sql(*self.columns) if isinstance(self.expr, ShardExpression) else None


@dataclass(frozen=True)
class VShard:
    """One way to find a row's shard: a rule for the database and one for the table; None is the only one there is."""

    db: Rule | None
    tb: Rule | None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*(self.db.columns if self.db else ()), *(self.tb.columns if self.tb else ())]))


@dataclass
class LogicalTable:
    name: str
    topology: Topology
    vshards: list[VShard]
    allow_full_scan: bool = False
    sequence: str | None = None
    auto_increment: str | None = None
    primary_key: tuple[str, ...] = ()
    path: str | None = None
    schema: Any = None  # StructType or DDL text
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)

    def shard_keys(self) -> set[str]:
        return {c.lower() for v in self.vshards for c in v.columns}

    def locate(self, vshard: VShard, values: dict[str, Any]) -> Shard | None:
        """The shard of one key tuple; None if it is outside the topology."""
        db = vshard.db.evaluate(values) if vshard.db else next(iter(self.topology.grid))
        tb = vshard.tb.evaluate(values) if vshard.tb else (self.topology.grid.get(db) or (None,))[0]
        return (db, tb) if db is not None and tb is not None and self.topology.exists((db, tb)) else None

    def layout_sql(self) -> tuple[str, str] | None:
        """Spark SQL of (__db, __tb) by the first rule; None if it is a Python function."""
        v = self.vshards[0]
        db = v.db.sql() if v.db else str(next(iter(self.topology.grid)))
        tb = v.tb.sql() if v.tb else str(next(iter(self.topology.grid.values()))[0])
        return None if db is None or tb is None else (db, tb)

    def describe(self) -> dict[str, Any]:
        rules = lambda kind: [{"columns": [{"name": c} for c in r.columns], "expr": r.text, "step": r.step} for v in self.vshards if (r := getattr(v, kind))]
        return {"name": self.name, "sequence_type": self.sequence or "", "db_rules": rules("db"), "tbl_rules": rules("tb"), "attributes": {"allow_full_scan": str(self.allow_full_scan).lower(), **self.attributes}}


class Catalog:
    """Logical databases and their tables, nodes and users."""

    def __init__(self) -> None:
        self.databases: dict[str, dict[str, LogicalTable]] = {}
        self.nodes: list[dict[str, Any]] = []
        self.users: list[str] = []

    def add(self, database: str, table: LogicalTable) -> LogicalTable:
        self.databases.setdefault(database, {})[table.name.lower()] = table
        return table

    def find(self, database: str, name: str) -> LogicalTable | None:
        return self.databases.get(database, {}).get(name.lower())

    def tables(self, database: str) -> list[LogicalTable]:
        return [t for _, t in sorted(self.databases.get(database, {}).items())]

    @classmethod
    def load(cls, config: dict[str, Any] | str) -> Catalog:
        """From a mapping (or JSON text, or YAML text if PyYAML is there) with `tables`, `nodes`, `users`."""
        if isinstance(config, str):
            try:
                config = json.loads(config)
            except ValueError:
                import yaml

                config = yaml.safe_load(config)
        out = cls()
        for t in config.get("tables", []):
            database, _, name = t["name"].partition(".")
            top = t["topology"]
            out.add(database, make_table(name, top["db_pattern"], top["tbl_pattern"], t.get("db_rules", []), t.get("tbl_rules", []), str(t.get("attributes", {}).get("allow_full_scan", "false")).lower() == "true", (t.get("sequence") or {}).get("type"), t.get("attributes", {})))
        out.nodes = list(config.get("nodes", []))
        out.users = [u["username"] for u in config.get("users", [])]
        return out


def _rule(spec: dict[str, Any], default_step: int) -> Rule:
    columns = spec.get("columns") or [{"name": spec["column"]}]
    expr = spec["expr"]
    return Rule(tuple(c["name"] if isinstance(c, dict) else c for c in columns), expr if callable(expr) else ShardExpression.parse(expr), spec.get("step") or default_step)


def make_table(name: str, db_pattern: str, tbl_pattern: str, db_rules: Iterable[dict], tbl_rules: Iterable[dict], allow_full_scan: bool = False, sequence: str | None = None, attributes: dict | None = None, **more: Any) -> LogicalTable:
    """The i-th database rule goes with the i-th table rule; the default step is the larger count."""
    top = Topology.of(db_pattern, tbl_pattern)
    step = max(top.db_pattern.count, top.tb_pattern.count)
    dbs, tbs = [_rule(r, step) for r in db_rules], [_rule(r, step) for r in tbl_rules]
    shards = [VShard(dbs[i] if i < len(dbs) else None, tbs[i] if i < len(tbs) else None) for i in range(max(len(dbs), len(tbs)))]
    extra = {k: str(v) for k, v in (attributes or {}).items() if k != "allow_full_scan"}
    return LogicalTable(name, top, shards, allow_full_scan, sequence, attributes=extra, **more)
