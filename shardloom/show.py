"""SHOW, DESCRIBE, EXPLAIN, SET, USE and table maintenance statements."""

from __future__ import annotations

import fnmatch
import json
import re
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dialect as D
from . import prune as P
from .dml import _fs, literal, replace_partitions
from .dml import explain as explain_write
from .sources import read_table
from .sources.layout import PARTS, with_shards

_EMPTY = {
    "WARNINGS": "Level string, Code int, Message string",
    "MASTER STATUS": "File string, Position long, Binlog_Do_DB string, Binlog_Ignore_DB string, Executed_Gtid_Set string",
    "REPLICAS": "Server_Id int, Host string, Port int, Source_Id int, Replica_UUID string",
    "REPLICA STATUS": "Replica_IO_State string, Source_Host string, Source_Port int",
}


def run(engine, tokens: list[D.Token], params: list[Any] | None = None) -> DataFrame:
    values = iter(params or [])
    tokens = [D.Token("string", literal(next(values))) if t.text == "?" else t for t in tokens]
    text = re.sub(r"\s+", " ", D.text_of([t for t in tokens if t.kind not in ("comment", "hint")])).strip()
    plain = text.replace("`", "")
    write = re.match(r"EXPLAIN (?=(?:INSERT|REPLACE|UPDATE|DELETE)\b)", text, re.I)
    if write:
        return explain_write(engine, D.tokenize(text[write.end() :]))
    for pattern, action in _STATEMENTS:
        m = re.fullmatch(pattern, plain, re.I | re.S)
        if m:
            return action(engine, *m.groups())
    raise ValueError(f"unsupported statement: {text}")


def like(pattern: str, name: str) -> bool:
    """Local LIKE: % and _ match, all else is itself, cased."""
    return fnmatch.fnmatchcase(name, re.sub(r"([*?\[])", r"[\1]", pattern).replace("%", "*").replace("_", "?"))


def _filtered(names: list[str], pattern: str | None) -> list[str]:
    return [n for n in names if pattern is None or like(pattern, n)]


def _databases(engine, pattern):
    return engine.rows([(n,) for n in _filtered(sorted(engine.catalog.databases), pattern)], "Database string")


def _tables(engine, database, pattern):
    database = database or engine.database
    names = [t.name for t in engine.catalog.tables(database) if not t.name.startswith("__sl_")]
    return engine.rows([(n,) for n in _filtered(names, pattern)], "t string").toDF(f"Tables_in_{database}")


def _open_tables(engine, database, pattern):
    database = database or engine.database
    names = _filtered([t.name for t in engine.catalog.tables(database)], pattern)
    return engine.rows([(database, n, 0, 0) for n in names], "Database string, Table string, In_use int, Name_locked int")


def _schema(engine, name):
    table = engine.table(name)
    return table, read_table(engine.spark, table, set()).drop(*PARTS).schema


def _columns_like(engine, name, pattern):
    got = _columns(engine, name)
    return got if pattern is None else engine.rows([tuple(r) for r in got.collect() if like(pattern, r["Field"])], got.schema)  # a row a column


def _columns(engine, name, column=None):
    table, schema = _schema(engine, name)
    rows = [(f.name, f.dataType.simpleString(), "NO" if f.name.lower() in table.shard_keys() | {p.lower() for p in table.primary_key} else "YES", "PRI" if f.name in table.primary_key else "", None, "auto_increment" if f.name == table.auto_increment else "") for f in schema if column is None or f.name.lower() == column.lower()]
    return engine.rows(rows, "Field string, Type string, Null string, Key string, Default string, Extra string")


def _index(engine, name):
    table = engine.table(name)
    rows = [(table.name, 0, "PRIMARY", i + 1, c) for i, c in enumerate(table.primary_key)]
    rows += [(table.name, 1, k, i + 1, c) for k, cols in table.indexes.items() for i, c in enumerate(cols)]
    return engine.rows(rows, "Table string, Non_unique int, Key_name string, Seq_in_index int, Column_name string")


def _create_table(engine, name):
    table, schema = _schema(engine, name)
    lines = [f"  `{f.name}` {f.dataType.simpleString()}" for f in schema]
    lines += [f"  PRIMARY KEY ({', '.join(table.primary_key)})"] if table.primary_key else []
    lines += [f"  KEY `{k}` ({', '.join(c)})" for k, c in table.indexes.items()]
    return engine.rows([(table.name, f"CREATE TABLE `{table.name}` (\n" + ",\n".join(lines) + "\n)")], "t string, c string").toDF("Table", "Create Table")


def _create_sequence(engine, name):
    kind, made = engine.sequences.made.get(name.lower(), (None, None))
    if made is None:
        raise LookupError(f"no sequence {name}")
    return engine.rows([(kind, made.current)], "Type string, Current_value long")


def _table_status(engine, database, pattern):
    rows = []
    for t in engine.catalog.tables(database or engine.database):
        if t.path and (pattern is None or like(pattern, t.name)):
            fs, path = _fs(engine, t.path)
            n, size = read_table(engine.spark, t, identity=False).count(), fs.getContentSummary(path(t.path)).getLength()
            rows.append((t.name, "Parquet", n, size // n if n else 0, size))
    return engine.rows(rows, "Name string, Engine string, Rows long, Avg_row_length long, Data_length long")


def _variables(engine, pattern):
    rows = [(k, str(v)) for k, v in sorted(engine.variables.items()) if pattern is None or like(pattern, k)]
    return engine.rows(rows, "Variable_name string, Value string")


def _status(engine, pattern):
    up = [("Uptime", str(int(engine.spark.sparkContext.startTime // 1000))), ("Threads_connected", "1")]
    return engine.rows([r for r in up if pattern is None or like(pattern, r[0])], "Variable_name string, Value string")


def _processlist(engine):
    tracker = engine.spark.sparkContext.statusTracker()
    rows = [(i, engine.database, "Query", str(tracker.getJobInfo(i).status)) for i in tracker.getActiveJobsIds() if tracker.getJobInfo(i)]
    return engine.rows(rows, "Id int, db string, Command string, State string")


def _topology(engine, name):
    table = engine.table(name)
    rows = [(i, *table.topology.render(s)) for i, s in enumerate(table.topology.shards())]
    return engine.rows(rows, "id int, group_name string, table_name string")


def _sharding(engine, database):
    rows = []
    for t in engine.catalog.tables(database):
        d = t.describe()
        rows.append((d["name"], d["sequence_type"], json.dumps(d["db_rules"]), json.dumps(d["tbl_rules"]), json.dumps(d["attributes"])))
    return engine.rows(rows, "name string, sequence_type string, db_rules string, tbl_rules string, attributes string")


def _rules(kind):
    def show(engine, name):
        table = engine.table(name)
        rules = [r for v in table.vshards if (r := getattr(v, kind))]
        return engine.rows([(table.name, ",".join(r.columns), "python" if r.text.startswith("python:") else "scriptExpr", r.text, r.step) for r in rules], "t string, c string, y string, e string, s int").toDF("table_name", "column", "type", "expr", "step")

    return show


def _nodes(engine, _tenant):
    rows = [(n.get("name"), n.get("host"), n.get("port"), n.get("database"), str(n.get("weight", ""))) for n in engine.catalog.nodes]
    return engine.rows(rows, "node string, host string, port int, database string, weight string")


def _users(engine, _tenant):
    return engine.rows([(u,) for u in engine.catalog.users], "user_name string")


def _check(engine, table) -> tuple[str, str]:
    """Reads every value once; a row must lie in the shard that its keys name."""
    rows, sql = read_table(engine.spark, table, identity=False), table.layout_sql()
    if sql:
        there = F.coalesce(F.expr(f"{sql[1]} = __tb AND {sql[0]} = __db"), F.lit(False))
    else:
        rows = with_shards(rows.withColumnsRenamed({p: f"{p}_was" for p in PARTS}), table)
        there = (F.col("__db") == F.col("__db_was")) & (F.col("__tb") == F.col("__tb_was"))
    try:
        strays = rows.agg(F.count_if(~there).alias("n"), F.count(F.xxhash64(*[F.col(c) for c in rows.columns])).alias("read")).first()["n"]
    except (PySparkException, Py4JJavaError):  # a file that is gone or cannot be read
        return "error", "Corrupt"
    return ("error", f"{strays} rows outside their shard") if strays else ("status", "OK")


def _rewrite(engine, table, repair: bool) -> tuple[str, str]:
    """The table's files written anew, few and of a size; a repair also brings strayed rows home."""
    rows = read_table(engine.spark, table, identity=False)
    replace_partitions(engine, table, with_shards(rows.drop(*PARTS), table) if repair else rows, None)
    return "status", "OK"


def _maintenance(engine, op, names):
    rows = []
    for table in [engine.table(n.strip()) for n in names.split(",")]:
        kind, text = "status", "OK"
        if table.path and op.upper() == "CHECK":
            kind, text = _check(engine, table)
        elif table.path and op.upper() in ("OPTIMIZE", "REPAIR"):
            kind, text = _rewrite(engine, table, op.upper() == "REPAIR")
        rows.append((f"{engine.database}.{table.name}", op.lower(), kind, text))
    return engine.rows(rows, "Table string, Op string, Msg_type string, Msg_text string")


def _set(engine, text):
    before = dict(engine.variables)
    try:
        for part in re.split(r",(?=(?:[^']*'[^']*')*[^']*$)", text):
            name, _, value = part.partition("=")
            if not value:
                raise ValueError(f"bad assignment: {part}")
            key = re.sub(r"^(session|global|local)\s+", "", name.strip().lstrip("@").rstrip(":").strip(), flags=re.I).lower().removeprefix("session.").removeprefix("global.")
            engine.variables[key] = value.strip().strip("'\"")
            if key == "time_zone":
                engine.spark.conf.set("spark.sql.session.timeZone", engine.variables[key])
    except ValueError:
        engine.variables = before
        raise
    return engine.rows([(0, 0)], "affected long, last_insert_id long")


def _use(engine, name):
    if name not in engine.catalog.databases:
        raise LookupError(f"no database {name}")
    engine.database = name
    return engine.rows([(0, 0)], "affected long, last_insert_id long")


def _kill(engine, _kind, number):
    """Cancels the job that SHOW PROCESSLIST gives that id."""
    engine.spark.sparkContext._jsc.sc().cancelJob(int(number))
    return engine.rows([(0, 0)], "affected long, last_insert_id long")


def _explain(engine, text):
    """For each logical table used, the shards that are left; and Spark's plan."""
    df = engine.sql(text)
    plan = df._jdf.queryExecution().simpleString()
    rows = []
    for alias, shards in sorted(engine.last_shards.items()):
        rows.append((alias, P.render(shards), len(shards) if shards is not None else None, plan))
    return engine.rows(rows or [(None, None, None, plan)], "table_name string, shards string, n_shards int, plan string").orderBy("table_name")


_NAME, _LIKE = r"([\w.$]+)", r"(?: LIKE '((?:[^'])*)')?"
_STATEMENTS = [
    (rf"SHOW DATABASES{_LIKE}", _databases),
    (rf"SHOW TABLES(?: (?:FROM|IN) {_NAME})?{_LIKE}", _tables),
    (rf"SHOW OPEN TABLES(?: (?:FROM|IN) {_NAME})?{_LIKE}", _open_tables),
    (rf"SHOW (?:FULL )?(?:COLUMNS|FIELDS) (?:FROM|IN) {_NAME}{_LIKE}", _columns_like),
    (rf"SHOW (?:INDEX|INDEXES|KEYS) (?:FROM|IN) {_NAME}", _index),
    (rf"SHOW CREATE TABLE {_NAME}", _create_table),
    (rf"SHOW CREATE SEQUENCE {_NAME}", _create_sequence),
    (rf"SHOW TABLE STATUS(?: (?:FROM|IN) {_NAME})?{_LIKE}", _table_status),
    (rf"SHOW (?:GLOBAL |SESSION )?VARIABLES{_LIKE}", _variables),
    (rf"SHOW (?:GLOBAL |SESSION )?STATUS{_LIKE}", _status),
    (r"SHOW (?:FULL )?PROCESSLIST", _processlist),
    (r"SHOW COLLATION.*", lambda e: e.rows([("utf8mb4_bin", "utf8mb4"), ("utf8mb4_general_ci", "utf8mb4")], "Collation string, Charset string")),
    (r"SHOW (?:CHARACTER SET|CHARSET).*", lambda e: e.rows([("utf8mb4", "UTF-8 Unicode", "utf8mb4_bin", 4)], "c string, d string, e string, m int").toDF("Charset", "Description", "Default collation", "Maxlen")),
    *[(rf"SHOW {k}", lambda e, s=s: e.rows([], s)) for k, s in _EMPTY.items()],
    (rf"SHOW TOPOLOGY FROM {_NAME}", _topology),
    (rf"SHOW SHARDING TABLES? FROM {_NAME}", _sharding),
    (rf"SHOW DATABASE RULES? FROM {_NAME}", _rules("db")),
    (rf"SHOW TABLE RULES? FROM {_NAME}", _rules("tb")),
    (rf"SHOW NODES(?: FROM {_NAME})?", _nodes),
    (rf"SHOW USERS(?: FROM {_NAME})?", _users),
    (r"(ANALYZE|CHECK|OPTIMIZE|REPAIR) TABLE (.+)", _maintenance),
    (r"SET (.+)", _set),
    (rf"USE {_NAME}", _use),
    (r"KILL (?:(QUERY|CONNECTION) )?(\d+)", _kill),
    (r"EXPLAIN (?:EXTENDED |FORMATTED )?((?:SELECT|WITH).*)", _explain),
    (rf"(?:DESCRIBE|DESC|EXPLAIN) {_NAME}(?: (\w+))?", _columns),
]
