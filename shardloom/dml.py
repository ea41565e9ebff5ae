"""INSERT, REPLACE, UPDATE and DELETE on a table's partitioned Parquet.

Only the partitions that pruning leaves are rewritten: the new rows go to a
staging folder first, then each touched partition is swapped by rename; the old
ones are kept aside until all are swapped, and a writer that finds some left by
one that died puts back those that are missing. Inside
BEGIN … COMMIT the statements wait until COMMIT. Each statement returns one row
(affected, last_insert_id).
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dialect as D
from . import prune as P
from .catalog import LogicalTable, Shard
from .sources import read_table, with_shards
from .sources.layout import PARTS, ShardKeyError


def run(engine, tokens: list[D.Token], params: list[Any] | None = None) -> DataFrame:
    tokens = D.normalize(_bind(tokens, params))
    pos = D.code(tokens)
    head = tokens[pos[0]].up
    action = {"INSERT": _insert, "REPLACE": _insert, "UPDATE": _update, "DELETE": _delete}[head](engine, tokens, pos)
    if engine.pending is not None:
        engine.pending.append(action)
        return engine.rows([(0, 0)], "affected long, last_insert_id long")
    affected, last = action()
    return engine.rows([(affected, last)], "affected long, last_insert_id long")


def _bind(tokens: list[D.Token], params: list[Any] | None) -> list[D.Token]:
    values = iter(params or [])
    return [D.Token("word", literal(next(values))) if t.text == "?" else t for t in tokens]


def literal(v: Any) -> str:
    if v is None:
        return "NULL"
    return repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _split(tokens: list[D.Token]) -> list[str]:
    out, own, depth = [], [], 0
    for t in tokens:
        depth += {"(": 1, ")": -1}.get(t.text, 0)
        if t.text == "," and depth == 0:
            out.append(D.text_of(own).strip())
            own = []
        else:
            own.append(t)
    return [*out, D.text_of(own).strip()]


def _find(tokens: list[D.Token], pos: list[int], *words: str) -> int | None:
    """Index in `pos` of a run of words outside parentheses."""
    depth = 0
    for k, p in enumerate(pos):
        depth += {"(": 1, ")": -1}.get(tokens[p].text, 0)
        if depth == 0 and [tokens[q].up for q in pos[k : k + len(words)]] == list(words):
            return k
    return None


def _fs(engine, path: str):
    jvm = engine.spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(engine.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def replace_partitions(engine, table: LogicalTable, rows: DataFrame, shards: set[Shard] | None) -> None:
    """Put `rows` (with __db, __tb) in place of the partitions `shards` (all if None)."""
    base, tag = table.path.rstrip("/"), uuid.uuid4().hex
    stage, aside = f"{base}.stage-{tag}", f"{base}.old-{tag}"
    rows.hint("rebalance", *[F.col(p) for p in PARTS]).write.partitionBy(*PARTS).parquet(stage)
    recover(engine, table)
    fs, path = _fs(engine, base)
    for d, t in table.topology.shards() if shards is None else sorted(shards):
        part = f"__db={d}/__tb={t}"
        old, new, kept = path(f"{base}/{part}"), path(f"{stage}/{part}"), path(f"{aside}/{part}")
        if fs.exists(old):
            fs.mkdirs(kept.getParent())
            fs.rename(old, kept)
        if fs.exists(new):
            fs.mkdirs(old.getParent())
            fs.rename(new, old)
    fs.mkdirs(path(f"{aside}/done"))
    fs.delete(path(aside), True)
    fs.delete(path(stage), True)
    engine.spark.catalog.refreshByPath(table.path)


def recover(engine, table: LogicalTable) -> None:
    """Undo a swap that was not finished. A table has one writer at a time."""
    base = table.path.rstrip("/")
    fs, path = _fs(engine, base)
    here = path(base)
    for left in fs.globStatus(path(f"{base}.old-*")) or []:
        aside = left.getPath()
        if not fs.exists(path(f"{aside}/done")):
            for part in fs.globStatus(path(f"{aside}/__db=*/__tb=*")) or []:
                kept = part.getPath()
                old = path(f"{base}/{kept.getParent().getName()}/{kept.getName()}")
                fs.delete(old, True)
                fs.mkdirs(old.getParent())
                fs.rename(kept, old)
        fs.delete(aside, True)
        engine.spark.catalog.refreshByPath(str(here))


def append(engine, table: LogicalTable, rows: DataFrame) -> None:
    rows.write.mode("append").partitionBy(*PARTS).parquet(table.path)
    engine.spark.catalog.refreshByPath(table.path)


def _typed(engine, table: LogicalTable, frame: DataFrame, *more) -> DataFrame:
    """All columns of the table in order and type; missing ones are NULL."""
    schema = read_table(engine.spark, table, set()).drop(*PARTS).schema
    have = {c.lower(): c for c in frame.columns}
    unknown = set(have) - {f.name.lower() for f in schema} - {"__row"}
    if unknown:
        raise LookupError(f"unknown columns {sorted(unknown)}")
    return frame.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], *more)


def _insert(engine, tokens: list[D.Token], pos: list[int]):
    replace = tokens[pos[0]].up == "REPLACE"
    k = 1
    ignore = False
    while tokens[pos[k]].up in ("INTO", "IGNORE", "LOW_PRIORITY", "DELAYED", "HIGH_PRIORITY"):
        ignore |= tokens[pos[k]].up == "IGNORE"
        k += 1
    name = tokens[pos[k]].name
    k += 1
    while tokens[pos[k]].text == ".":
        name += "." + tokens[pos[k + 1]].name
        k += 2
    table = engine.table(name)
    dup = _find(tokens, pos, "ON", "DUPLICATE", "KEY", "UPDATE")
    sets: dict[str, str] = {}
    if dup is not None:
        sets = dict(_assignment(x) for x in _split(tokens[pos[dup + 3] + 1 :]))
        _reject_keys(table, sets)
        tokens, pos = tokens[: pos[dup]], pos[:dup]
    schema = read_table(engine.spark, table, set()).drop(*PARTS).schema
    columns = [f.name for f in schema]
    if tokens[pos[k]].text == "(" and tokens[pos[k + 1]].up != "SELECT":
        end = D._close(tokens, pos[k])
        columns = [c.strip("` ") for c in _split(tokens[pos[k] + 1 : end])]
        k = next(i for i, p in enumerate(pos) if p > end)
    up = tokens[pos[k]].up
    if up in ("VALUES", "VALUE"):
        text = "SELECT * FROM VALUES " + D.text_of(tokens[pos[k] + 1 :]) + " AS t(" + ", ".join(f"`{c}`" for c in columns) + ")"
    elif up == "SET":
        pairs = [_assignment(x) for x in _split(tokens[pos[k] + 1 :])]
        text = "SELECT " + ", ".join(f"{v} AS `{c}`" for c, v in pairs)
        columns = [c for c, _ in pairs]
    else:
        text = None
    query = tokens[pos[k] :] if text is None else None
    given = {c.lower() for c in columns}
    missing = [c for v in table.vshards[:1] for c in v.columns if c.lower() not in given]
    if missing:
        raise ShardKeyError(f"no shard key found: {missing}")

    def incoming() -> DataFrame:
        return engine.spark.sql(text) if text else engine.select(list(query)).toDF(*columns)

    def action() -> tuple[int, int]:
        # stored once: counted, looked through for shards and written from there
        held = f"{table.path.rstrip('/')}.in-{uuid.uuid4().hex}"
        row = F.monotonically_increasing_id()
        incoming().withColumns({"__part": F.shiftright(row, 33), "__row": row}).write.parquet(held)
        try:
            return write(engine.spark.read.parquet(held))
        finally:
            fs, path = _fs(engine, held)
            fs.delete(path(held), True)

    def write(frame: DataFrame) -> tuple[int, int]:
        sizes = sorted((r[0], r[1]) for r in frame.groupBy("__part").count().collect())  # a row for each partition written
        n, last = sum(c for _, c in sizes), 0
        if not n:
            return 0, last
        auto = table.auto_increment
        if auto and auto.lower() not in given:
            make, last = engine.sequences.get(table.sequence or table.name).reserve(n)
            before, start = [], 0
            for part, c in sizes:
                before += [F.lit(part), F.lit(start)]
                start += c
            nth = F.create_map(*before)[F.col("__part")] + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
            frame = frame.withColumn(auto, make(nth.cast("long")))
        placed = with_shards(_typed(engine, table, frame.drop("__part"), F.col("__row")), table)
        if not table.primary_key:
            append(engine, table, placed.drop("__row"))
            return n, last
        shards = {(r[0], r[1]) for r in placed.select(*PARTS).distinct().collect()}  # at most one a shard
        old = read_table(engine.spark, table, shards)
        key = list(table.primary_key)
        by_key = Window.partitionBy(*key).orderBy("__row")
        turns = placed.withColumn("__turn", F.row_number().over(by_key))
        most = turns.agg(F.max("__turn")).first()[0]
        known = placed.select(*key).distinct().join(old.select(*key), key, "left_semi").count()
        if not (replace or sets or ignore):
            if known or most > 1:
                raise DuplicateKeyError(f"duplicate entry for key PRIMARY of {table.name}")
            append(engine, table, placed.drop("__row"))
            return n, last
        distinct = placed.select(*key).distinct().count() if most > 1 else n
        inserted = distinct - known
        first = turns.where("__turn = 1").drop("__row", "__turn")
        if ignore and not sets:
            append(engine, table, first.join(old.select(*key), key, "left_anti").select(*old.columns))
            return inserted, last
        if replace:
            final = turns.withColumn("__last", F.max("__turn").over(Window.partitionBy(*key))).where("__turn = __last").drop("__row", "__turn", "__last")
            merged = old.join(final.select(*key), key, "left_anti").unionByName(final)
        else:
            merged = old
            for turn in range(1, most + 1):  # a key given several times is updated by each in order
                merged = _upsert(merged, turns.where(F.col("__turn") == turn).drop("__row", "__turn"), key, sets)
        replace_partitions(engine, table, merged, shards)
        return inserted + 2 * (n - inserted), last

    action.incoming = lambda: with_shards(_typed(engine, table, incoming()), table) if not (table.auto_increment and table.auto_increment.lower() not in given) else None
    action.table = table
    return action


class DuplicateKeyError(ValueError):
    """An INSERT without IGNORE or ON DUPLICATE KEY gives a primary key that is there already."""


def _upsert(old: DataFrame, new: DataFrame, key: list[str], sets: dict[str, str]) -> DataFrame:
    """`old` with its rows of the keys of `new` changed by `sets`, and the rows of other keys added."""
    incoming = new.select(*[F.col(c).alias(f"_new_{c}") for c in new.columns])
    touched = old.join(incoming, F.expr(" AND ".join(f"`{c}` <=> `_new_{c}`" for c in key)), "left")
    hit = F.col(f"_new_{key[0]}").isNotNull()
    fix = lambda v: _values_function(v, new.columns)
    touched = touched.select(*[(F.when(hit, F.expr(fix(sets[c.lower()]))).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c.lower() in sets else F.col(c)) for c in old.columns])
    return touched.unionByName(new.join(old.select(*key), key, "left_anti"))


def explain(engine, tokens: list[D.Token], params: list[Any] | None = None) -> DataFrame:
    """The table and shards a write would touch; nothing is written."""
    tokens = D.normalize(_bind(tokens, params))
    pos = D.code(tokens)
    head = tokens[pos[0]].up
    action = {"INSERT": _insert, "REPLACE": _insert, "UPDATE": _update, "DELETE": _delete}[head](engine, tokens, pos)
    if head in ("INSERT", "REPLACE"):
        placed = action.incoming()
        shards = None if placed is None else {(r[0], r[1]) for r in placed.select(*PARTS).distinct().collect()}
    else:
        shards = action.shards
    return engine.rows([(action.table.name, P.render(shards), len(shards) if shards is not None else None, head)], "table_name string, shards string, n_shards int, plan string")


def _values_function(text: str, columns: list[str]) -> str:
    """VALUES(c) is the row that was to be inserted."""
    import re

    return re.sub(r"(?i)\bvalues\s*\(\s*`?(\w+)`?\s*\)", lambda m: f"`_new_{next((c for c in columns if c.lower() == m[1].lower()), m[1])}`", text)


def _assignment(text: str) -> tuple[str, str]:
    left, _, right = text.partition("=")
    return left.strip().strip("`").rpartition(".")[2].strip("`").lower(), right.strip()


def _reject_keys(table: LogicalTable, sets: dict[str, str]) -> None:
    if set(sets) & table.shard_keys():
        raise ShardKeyError("a shard key cannot be updated")


def _target(engine, tokens: list[D.Token], where: list[D.Token] | None, table: LogicalTable, alias: str) -> set[Shard] | None:
    hints = D.hints_of(tokens)
    shards = None if where is None else P.prune(engine.predicate(where, table, alias, False), table, engine._integral(table))
    if shards is None and not (table.allow_full_scan or hints.fullscan):
        from .plans import FullScanDenied

        raise FullScanDenied(f"the full-scan query is not allowed: {table.name}")
    return shards


def _tail(tokens: list[D.Token], pos: list[int]) -> tuple[list[D.Token] | None, str]:
    """WHERE span, and the text of ORDER BY / LIMIT."""
    where, order, limit = _find(tokens, pos, "WHERE"), _find(tokens, pos, "ORDER", "BY"), _find(tokens, pos, "LIMIT")
    tail = min([x for x in (order, limit) if x is not None], default=None)
    end = pos[tail] if tail is not None else len(tokens)
    return (tokens[pos[where] + 1 : end] if where is not None else None), (D.text_of(tokens[end:]) if tail is not None else "")


def _matched(rows: DataFrame, where: list[D.Token] | None, tail: str) -> DataFrame:
    """`rows` with _hit: those WHERE (and ORDER BY … LIMIT) choose."""
    cond = f"coalesce(({D.text_of(where)}), false)" if where is not None else "true"
    if not tail:
        return rows.withColumn("_hit", F.expr(cond))
    rows = rows.withColumn("_rid", F.monotonically_increasing_id())
    rows.createOrReplaceTempView("sl_touched")
    picked = rows.sparkSession.sql(f"SELECT _rid AS _picked FROM sl_touched WHERE {cond} {tail}")
    return rows.join(picked, rows["_rid"] == picked["_picked"], "left").withColumn("_hit", F.col("_picked").isNotNull()).drop("_rid", "_picked")


def _update(engine, tokens: list[D.Token], pos: list[int]):
    at = _find(tokens, pos, "SET")
    names = [tokens[p].name for p in pos[1:at] if tokens[p].up not in ("IGNORE", "LOW_PRIORITY", "AS", ".")]
    table = engine.table(names[0])
    where, tail = _tail(tokens, pos)
    stops = [x for x in (_find(tokens, pos, "WHERE"), _find(tokens, pos, "ORDER", "BY"), _find(tokens, pos, "LIMIT")) if x is not None]
    sets = dict(_assignment(x) for x in _split(tokens[pos[at] + 1 : pos[min(stops)] if stops else len(tokens)]))
    _reject_keys(table, sets)
    shards = _target(engine, tokens, where, table, names[-1])

    def action() -> tuple[int, int]:
        if shards is not None and not shards:
            return 0, 0
        rows = _matched(read_table(engine.spark, table, shards).alias(names[-1]), where, tail)
        n = rows.where("_hit").count()
        if n:
            new = rows.select(*[F.when(F.col("_hit"), F.expr(sets[c.lower()]).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c.lower() in sets else F.col(c) for c in rows.columns if c != "_hit"])
            replace_partitions(engine, table, new, shards)
        return n, 0

    action.shards, action.table = shards, table
    return action


def _delete(engine, tokens: list[D.Token], pos: list[int]):
    at = _find(tokens, pos, "FROM")
    stop = next((x for x in (_find(tokens, pos, "WHERE"), _find(tokens, pos, "ORDER", "BY"), _find(tokens, pos, "LIMIT")) if x is not None), len(pos))
    names = [tokens[p].name for p in pos[at + 1 : stop] if tokens[p].up not in ("AS", ".")]
    if any(tokens[p].text == "," for p in pos[at + 1 : stop]):
        raise ValueError("DELETE takes one table")
    table = engine.table(names[0])
    where, tail = _tail(tokens, pos)
    shards = _target(engine, tokens, where, table, names[-1])

    def action() -> tuple[int, int]:
        if shards is not None and not shards:
            return 0, 0
        rows = _matched(read_table(engine.spark, table, shards).alias(names[-1]), where, tail)
        n = rows.where("_hit").count()
        if n:
            replace_partitions(engine, table, rows.where("NOT _hit").drop("_hit"), shards)
        return n, 0

    action.shards, action.table = shards, table
    return action
