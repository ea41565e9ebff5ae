"""CREATE, ALTER, DROP, TRUNCATE, RENAME: changes of the catalog and of storage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from . import dialect as D
from .catalog import Rule, VShard, make_table
from .dml import _fs, replace_partitions
from .shardexpr import ShardExpression
from .sources import read_table, storage_root
from .sources.layout import PARTS

_TYPES = {"tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "integer": "int", "bigint": "bigint", "float": "float", "double": "double", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "blob": "binary", "bit": "binary", "bool": "boolean", "boolean": "boolean"}
_DONE = ("affected long, last_insert_id long",)


def spark_type(text: str) -> str:
    m = re.match(r"\s*(\w+)\s*(\(([^)]*)\))?(.*)", text, re.S)
    name, size, rest = m[1].lower(), m[3], m[4].lower()
    if name in ("decimal", "numeric"):
        return f"decimal({size or '10,0'})"
    if "unsigned" in rest and name in ("int", "integer", "bigint"):
        return "decimal(20,0)" if name == "bigint" else "bigint"
    return _TYPES.get(name, "string")


def run(engine, tokens: list[D.Token]) -> DataFrame:
    text = re.sub(r"\s+", " ", D.text_of([t for t in tokens if t.kind not in ("comment", "hint")])).strip().replace("`", "")
    for pattern, action in (
        (r"CREATE TABLE (?:IF NOT EXISTS )?([\w.]+) ?(\(.*)$", _create),
        (r"ALTER TABLE ([\w.]+) (.*)$", _alter),
        (r"DROP TABLE (IF EXISTS )?(.*)$", _drop),
        (r"TRUNCATE (?:TABLE )?([\w.]+)$", _truncate),
        (r"CREATE (?:UNIQUE )?INDEX (\w+) ON ([\w.]+) ?\(([^)]*)\).*$", _create_index),
        (r"DROP INDEX (\w+) ON ([\w.]+)$", _drop_index),
        (r"RENAME TABLE (.*)$", _renames),
        (r"CREATE SEQUENCE (\w+)(?: TYPE (\w+))?$", lambda e, n, k: e.sequences.create(n, (k or "snowflake").lower())),
        (r"DROP TRIGGER .*$", lambda e: None),
    ):
        m = re.match(pattern, text, re.I | re.S)
        if m:
            action(engine, *m.groups())
            return engine.rows([(0, 0)], _DONE[0])
    return engine.spark.sql(text)


def _items(text: str) -> list[str]:
    out, own, depth = [], "", 0
    for ch in text:
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            out.append(own.strip())
            own = ""
        else:
            own += ch
    return [*out, own.strip()]


def _create(engine, name: str, definition: str) -> None:
    """`DBPARTITION BY HASH(k) DBPARTITIONS n TBPARTITION BY HASH(k) TBPARTITIONS m` makes shard rules
    `$0 % (n m) / m` and `$0 % (n m)`, as does `PARTITION BY HASH(k) PARTITIONS n SUBPARTITION BY HASH(k) SUBPARTITIONS m`."""
    database, _, short = name.rpartition(".")
    tokens = D.tokenize(definition)
    end = D._close(tokens, 0)
    body, rest = D.text_of(tokens[1:end]), D.text_of(tokens[end + 1 :])
    columns, primary, auto, indexes = [], (), None, {}
    for item in _items(body):
        up = item.upper()
        names = lambda s: tuple(c.strip() for c in re.search(r"\(([^)]*)\)", s)[1].split(","))
        if up.startswith("PRIMARY KEY"):
            primary = names(item)
        elif re.match(r"(UNIQUE )?(KEY|INDEX)\b|UNIQUE\b", up):
            words = item.split("(")[0].split()
            indexes[words[-1]] = names(item)
        elif up.startswith(("CONSTRAINT", "FOREIGN")):
            continue
        else:
            column, _, kind = item.partition(" ")
            columns.append(f"`{column}` {spark_type(kind)}")
            if "AUTO_INCREMENT" in up:
                auto = column
            if "PRIMARY KEY" in up:
                primary = (column,)
    m = re.search(r"PARTITION BY HASH ?\(([^)]*)\) (?:DB)?PARTITIONS (\d+)(?: (?:SUBPARTITION|TBPARTITION) BY HASH ?\(([^)]*)\) (?:SUBPARTITIONS|TBPARTITIONS) (\d+))?", rest, re.I)
    if m:
        n, k = int(m[2]), int(m[4] or 1)
        total = n * k
        key = [{"name": m[1].strip()}]
        db_rules, tb_rules = [{"columns": key, "expr": f"$0 % {total} / {k}"}], [{"columns": key, "expr": f"$0 % {total}"}]
        patterns = (f"{database or engine.database}_${{0000..{n - 1:04d}}}", f"{short}_${{0000..{total - 1:04d}}}")
    else:
        db_rules, tb_rules, patterns = [], [], (database or engine.database, short)
    table = make_table(short, *patterns, db_rules, tb_rules, allow_full_scan=True, primary_key=primary, auto_increment=auto, indexes=indexes, schema=", ".join(columns))
    if not table.vshards:  # unsharded: every row is in the one shard there is
        first = (columns[0].split("`")[1],)
        table.vshards = [VShard(*[Rule(first, ShardExpression.parse(f"{n}")) for n in table.topology.smallest()])]
    table.path = f"{storage_root(engine.spark)}/{database or engine.database}/{short}"
    fs, path = _fs(engine, table.path)
    fs.mkdirs(path(table.path))
    if auto and short.lower() not in engine.sequences.made:
        engine.sequences.create(short, "snowflake")
    engine.catalog.add(database or engine.database, table)


def _alter(engine, name: str, change: str) -> None:
    table = engine.table(name)
    m = re.match(r"ADD (?:COLUMN )?(\w+) (.*)$", change, re.I | re.S)
    d = re.match(r"DROP (?:COLUMN )?(\w+)$", change, re.I)
    i = re.match(r"ADD (?:UNIQUE )?(?:INDEX|KEY) (\w+) ?\(([^)]*)\)$", change, re.I)
    r = re.match(r"RENAME COLUMN (\w+) TO (\w+)$", change, re.I)
    c = re.match(r"CHANGE (?:COLUMN )?(\w+) (\w+) (.*)$", change, re.I | re.S)
    o = re.match(r"MODIFY (?:COLUMN )?(\w+) (.*)$", change, re.I | re.S)
    if r or c or o:
        old, new, kind = (r[1], r[2], None) if r else (c[1], c[2], c[3]) if c else (o[1], o[1], o[2])
        _change(engine, table, old, new, kind)
    elif i:
        table.indexes[i[1]] = tuple(c.strip() for c in i[2].split(","))
    elif m:
        default = re.search(r"DEFAULT ('(?:[^']*)'|[\w.+-]+)", m[2], re.I)
        schema = read_table(engine.spark, table, set()).drop(*PARTS).schema
        if default and default[1].upper() != "NULL":
            from pyspark.sql import functions as F

            rows = read_table(engine.spark, table)
            new = rows.select(*schema.names, F.expr(default[1]).cast(spark_type(m[2])).alias(m[1]), *PARTS)
            replace_partitions(engine, table, new, None)
        table.schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"`{m[1]}` {spark_type(m[2])}"])
    elif d:
        if d[1].lower() in table.shard_keys():
            raise ValueError("a shard key cannot be dropped")
        schema = read_table(engine.spark, table, set()).drop(*PARTS).schema
        table.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name.lower() != d[1].lower())
    else:
        raise ValueError(f"unsupported ALTER TABLE: {change}")


def _change(engine, table, old: str, new: str, kind: str | None) -> None:
    """Another name or type for a column: its values are cast once, and the table's files written anew."""
    from pyspark.sql import functions as F

    schema = read_table(engine.spark, table, set()).drop(*PARTS).schema
    found = next((f for f in schema if f.name.lower() == old.lower()), None)
    if found is None:
        raise LookupError(f"no column {old}")
    if old.lower() in table.shard_keys():
        raise ValueError("a shard key cannot be changed")
    if new.lower() != old.lower() and new.lower() in {f.name.lower() for f in schema}:
        raise ValueError(f"column {new} is there already")
    type_of = found.dataType.simpleString() if kind is None else spark_type(kind)
    rows = read_table(engine.spark, table)
    cast = [F.col(f.name).cast(type_of).alias(new) if f is found else F.col(f.name) for f in schema]
    replace_partitions(engine, table, rows.select(*cast, *PARTS), None)
    swap = lambda names: tuple(new if n.lower() == old.lower() else n for n in names)
    table.primary_key, table.indexes = swap(table.primary_key), {k: swap(v) for k, v in table.indexes.items()}
    table.auto_increment = new if (table.auto_increment or "").lower() == old.lower() else table.auto_increment
    table.schema = ", ".join(f"`{new if f is found else f.name}` {type_of if f is found else f.dataType.simpleString()}" for f in schema)


def _drop(engine, quiet: str | None, names: str) -> None:
    for name in (n.strip() for n in names.split(",")):
        database, _, short = name.rpartition(".")
        table = engine.catalog.find(database or engine.database, short)
        if table is None:
            if quiet:
                continue
            raise LookupError(f"no logical table {name}")
        if table.path:
            fs, path = _fs(engine, table.path)
            fs.delete(path(table.path), True)
        del engine.catalog.databases[database or engine.database][short.lower()]


def _truncate(engine, name: str) -> None:
    table = engine.table(name)
    schema = read_table(engine.spark, table, set()).drop(*PARTS).schema
    table.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    fs, path = _fs(engine, table.path)
    fs.delete(path(table.path), True)
    fs.mkdirs(path(table.path))
    engine.spark.catalog.refreshByPath(table.path)


def _create_index(engine, index: str, name: str, columns: str) -> None:
    engine.table(name).indexes[index] = tuple(c.strip() for c in columns.split(","))


def _drop_index(engine, index: str, name: str) -> None:
    del engine.table(name).indexes[index]


def _renames(engine, pairs: str) -> None:
    for pair in _items(pairs):
        m = re.fullmatch(r"([\w.]+) TO ([\w.]+)", pair, re.I)
        if not m:
            raise ValueError(f"unsupported RENAME TABLE: {pair}")
        _rename(engine, m[1], m[2])


def _rename(engine, old: str, new: str) -> None:
    table = engine.table(old)
    database, _, short = old.rpartition(".")
    own = engine.catalog.databases[database or engine.database]
    del own[short.lower()]
    table.name = new.rpartition(".")[2]
    own[table.name.lower()] = table
