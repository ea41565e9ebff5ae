"""The engine: MySQL-flavoured statements over logical tables.

A query's text is normalised, every logical table in it is replaced by a view of
the partitions that pruning leaves, and Spark does the rest. A WHERE span prunes
a table only by comparisons of that table's own key columns, which no row with
NULL in them satisfies, so pruning is sound below outer joins too.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import dialect as D
from .. import prune as P
from ..catalog import Catalog, LogicalTable, Shard
from ..sequence import Sequences
from ..sources import ensure_functions, read_table

_count = itertools.count()


class FullScanDenied(PermissionError):
    """The query reaches all shards of a table that does not allow it."""


@dataclass
class Prepared:
    engine: Engine
    text: str

    def execute(self, *params: Any) -> DataFrame:
        return self.engine.sql(self.text, list(params))


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, database: str, pruning: bool = True):
        ensure_functions(spark)
        self.spark, self.catalog, self.database, self.pruning = spark, catalog, database, pruning
        self.sequences = Sequences()
        self.variables: dict[str, Any] = {"autocommit": "1", "sql_mode": "", "version": "8.0.0"}
        self.pending: list | None = None
        self.last_shards: dict[str, set[Shard] | None] = {}

    # ------------------------------------------------------------ text entry

    def sql(self, text: str, params: list[Any] | None = None) -> DataFrame:
        """Run one statement; of several, separated by `;`, the last one's result is returned."""
        statements = D.split_statements(text)
        if len(statements) != 1:
            out = [self.sql(s, params) for s in statements]
            if not out:
                raise ValueError("empty statement")
            return out[-1]
        tokens = D.tokenize(statements[0])
        pos = D.code(tokens)
        head = tokens[pos[0]].up
        if head in ("SELECT", "WITH", "("):
            return self.select(tokens, params)
        from .. import ddl, dml, show

        if head in ("INSERT", "UPDATE", "DELETE", "REPLACE"):
            return dml.run(self, tokens, params)
        if head in ("SHOW", "DESCRIBE", "DESC", "EXPLAIN", "USE", "SET", "KILL", "ANALYZE", "CHECK", "OPTIMIZE", "REPAIR"):
            return show.run(self, tokens, params)
        if head in ("CREATE", "ALTER", "DROP", "TRUNCATE", "RENAME"):
            return ddl.run(self, tokens)
        if head in ("BEGIN", "START"):
            self.pending = []
            return self.rows([], "affected long, last_insert_id long")
        if head in ("COMMIT", "ROLLBACK"):
            waiting, self.pending = self.pending or [], None
            for action in waiting if head == "COMMIT" else []:
                action()
            return self.rows([], "affected long, last_insert_id long")
        return self.spark.sql(statements[0])

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def table(self, name: str) -> LogicalTable:
        database, _, short = name.rpartition(".")
        got = self.catalog.find(database or self.database, short)
        if got is None:
            raise LookupError(f"no logical table {name}")
        return got

    # ------------------------------------------------------------ queries

    def select(self, tokens: list[D.Token], params: list[Any] | None = None) -> DataFrame:
        sequence = self._sequence_call(tokens)
        if sequence is not None:
            return sequence
        hints = D.hints_of(tokens)
        names = self._names([t for t in tokens if t.kind not in ("hint", "comment")])
        tokens = D.normalize(self._system_variables(self._bind_limits(tokens, params)))
        text, views = self._route(tokens, params, hints)
        if hints.trace is not None:
            self.spark.sparkContext.setJobDescription(f"trace {hints.trace}")
        try:
            out = self.spark.sql(text, args=self._unused(tokens, params)) if params else self.spark.sql(text)
        finally:
            for view in views:  # the query has been resolved and needs their names no more
                self.spark.catalog.dropTempView(view)
        return out.toDF(*names) if names and len(names) == len(out.columns) else out

    def _unused(self, tokens: list[D.Token], params: list[Any]) -> list[Any]:
        """Parameters not already put into the text."""
        return [p for p in params if not isinstance(p, _Taken)]

    def _bind_limits(self, tokens: list[D.Token], params: list[Any] | None) -> list[D.Token]:
        """LIMIT and OFFSET take their parameters as text, so that `LIMIT ?, ?` may be reordered."""
        if not params:
            return tokens
        out, nth, after = [], 0, None
        for t in tokens:
            if t.kind not in ("space", "comment", "hint"):
                if t.text == "?":
                    if after:
                        value = params[nth]
                        params[nth] = _Taken()
                        t = D.Token("number", str(int(value)))
                    nth += 1
                elif t.up in ("LIMIT", "OFFSET"):
                    after = True
                elif t.text != "," and t.kind != "number":
                    after = False
            out.append(t)
        return out

    def _system_variables(self, tokens: list[D.Token]) -> list[D.Token]:
        out = []
        for t in tokens:
            if t.kind == "word" and t.text.startswith("@"):
                name = t.text.lstrip("@").lower()
                value = self.variables.get(name)
                t = D.Token("string", "NULL" if value is None else f"'{value}'")
            out.append(t)
        return out

    def _sequence_call(self, tokens: list[D.Token]) -> DataFrame | None:
        m = re.fullmatch(r"\s*SELECT\s+(\w+)\.(nextval|currval)\s*", D.text_of(tokens), re.I)
        if not m:
            return None
        value = self.sequences.next_value(m[1]) if m[2].lower() == "nextval" else self.sequences.current_value(m[1])
        return self.rows([(value,)], "v long").toDF(f"{m[1]}.{m[2]}")

    def _names(self, tokens: list[D.Token]) -> list[str] | None:
        """Names of the result's columns: an item's alias, or its text as written. None if there is a star."""
        pos = D.code(tokens)
        k = 0
        if tokens[pos[0]].up != "SELECT":
            return None
        if tokens[pos[1]].up in ("DISTINCT", "ALL"):
            k = 1
        items, own, depth = [], [], 0
        for p in range(pos[k] + 1, len(tokens)):
            t = tokens[p]
            depth += {"(": 1, ")": -1}.get(t.text, 0)
            if depth == 0 and (t.text == "," or (t.kind == "word" and t.up in ("FROM", "LIMIT", "ORDER", "UNION", "WHERE"))):
                items.append(own)
                own = []
                if t.text != ",":
                    break
            else:
                own.append(t)
        else:
            items.append(own)
        names = []
        for item in items:
            means = [t for t in item if t.kind not in ("space", "comment")]
            if not means or means[-1].text == "*":
                return None
            if len(means) > 1 and means[-1].kind in ("word", "quoted", "string") and (means[-2].up == "AS" or (means[-2].kind in ("word", "quoted", "number", "string") and means[-1].up != "END") or means[-2].text == ")"):
                last = means[-1]
                names.append(last.text[1:-1] if last.kind == "string" else last.name)
            elif len(means) == 3 and means[1].text == ".":
                names.append(means[2].name)
            else:
                names.append(D.text_of(item).strip().strip("`"))
        return names

    def _route(self, tokens: list[D.Token], params: list[Any] | None, hints: D.Hints) -> tuple[str, list[str]]:
        """Text with each logical table replaced by a view of its pruned partitions."""
        toks, views = list(tokens), []
        self.last_shards = {}
        uses = []
        for block in D.blocks(toks):
            joined = len(block.tables) > 1
            for use in block.tables:
                if (use.database or self.database).lower() == "information_schema":
                    uses.append((use, None, None))
                    continue
                table = self.catalog.find(use.database or self.database, use.name)
                if table is not None and table.path:
                    uses.append((use, table, self._shards(toks, block, use, table, params, hints, joined)))
        for use, table, shards in sorted(uses, key=lambda x: -x[0].at):
            if table is None:
                view = f"sl_information_{next(_count)}"
                self._information(use.name).createOrReplaceTempView(view)
                views.append(view)
                toks[use.first : use.at + 1] = [D.Token("word", view if use.has_alias else f"{view} AS `{use.alias}`")]
                continue
            self.last_shards[use.alias] = shards
            if shards is None and not (table.allow_full_scan or hints.fullscan or hints.direct or hints.route):
                raise FullScanDenied(f"the full-scan query is not allowed: {table.name}")
            view = f"sl_{table.name.lower()}_{next(_count)}"
            df = read_table(self.spark, table, shards if self.pruning else None)
            df.drop("__db", "__tb").createOrReplaceTempView(view)
            views.append(view)
            new = [D.Token("word", view)] if use.has_alias else [D.Token("word", f"{view} AS `{use.alias}`")]
            toks[use.first : use.at + 1] = new
        return D.text_of(toks), views

    def _information(self, name: str) -> DataFrame:
        """The catalog's schemata, tables and columns."""
        tables = [(d, t) for d in sorted(self.catalog.databases) for t in self.catalog.tables(d) if t.path]
        if name.lower() == "schemata":
            return self.rows([("def", d) for d in sorted(self.catalog.databases)], "CATALOG_NAME string, SCHEMA_NAME string")
        if name.lower() == "tables":
            return self.rows([("def", d, t.name, "BASE TABLE", "Parquet") for d, t in tables], "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string, ENGINE string")
        if name.lower() == "columns":
            rows = [("def", d, t.name, f.name, i, f.dataType.simpleString(), "PRI" if f.name in t.primary_key else "") for d, t in tables for i, f in enumerate(read_table(self.spark, t, set()).drop("__db", "__tb").schema, 1)]
            return self.rows(rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, DATA_TYPE string, COLUMN_KEY string")
        raise LookupError(f"no table information_schema.{name}")

    def _shards(self, toks, block, use, table: LogicalTable, params, hints: D.Hints, joined: bool) -> set[Shard] | None:
        if hints.direct:
            return {table.topology.smallest()}
        if hints.route:
            wanted = {s for s in table.topology.shards() if ".".join(table.topology.render(s)) in hints.route}
            if wanted:
                return wanted
        if block.where is None:
            return None
        return P.prune(self.predicate(toks[block.where[0] : block.where[1]], table, use.alias, joined, self._params_before(toks, block.where[0], params)), table, self._integral(table))

    def _params_before(self, toks: list[D.Token], at: int, params: list[Any] | None) -> list[Any]:
        used = sum(t.text == "?" for t in toks[:at])
        return [p for p in params or [] if not isinstance(p, _Taken)][used:]

    def _integral(self, table: LogicalTable) -> set[str]:
        df = read_table(self.spark, table, set())
        return {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "tinyint", "smallint", "int", "bigint")}

    def predicate(self, where: list[D.Token], table: LogicalTable, alias: str, joined: bool, params: list[Any] | None = None) -> Any:
        """The WHERE span as a predicate of `table`; unqualified names count only if the table stands alone."""
        values = iter(params or [])
        bound = []
        for t in where:
            if t.text == "?":
                v = next(values, None)
                t = D.Token("word", "NULL") if v is None else D.Token("number", repr(v)) if isinstance(v, (int, float)) and v >= 0 else D.Token("string", "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'")
                if isinstance(v, (int, float)) and v < 0:
                    bound.append(D.Token("op", "-"))
                    t = D.Token("number", repr(-v))
            bound.append(t)
        keys = table.shard_keys()
        belongs = lambda q, c: c.lower() in keys and (q.lower() == alias.lower() if q else not joined)
        return D.PredicateReader(bound, belongs, self._constant).read()

    def _constant(self, text: str) -> Any:
        """Constant text evaluated by Spark; LookupError if it is none."""
        from decimal import Decimal

        try:
            value = self.spark.sql(f"SELECT {re.sub(r'(?i)\bdiv\b', 'div', text)} AS v").first()[0]
        except Exception as e:  # any analysis error means it is no constant
            raise LookupError(text) from e
        if isinstance(value, Decimal):
            return int(value) if value == value.to_integral_value() else float(value)
        if value is not None and not isinstance(value, (int, float, str, bool)):
            raise LookupError(text)
        return value


class _Taken:
    """Marks a parameter that went into the text."""
