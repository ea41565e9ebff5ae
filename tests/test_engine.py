import glob

import pytest

from shardloom.catalog import Catalog, make_table
from shardloom.dialect import HintError
from shardloom.plans import Engine, FullScanDenied
from shardloom.prune import render
from shardloom.sources import write_table
from shardloom.sources.layout import ShardKeyError


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, Catalog(), "employees")
    rows = [(i, f"name{i}", 95.0 if i == 1 else 10.0, 1990 + i % 7) for i in range(1, 101)]
    t = make_table("student", "employees_${0000..0003}", "student_${0000..0031}", [{"column": "uid", "expr": "parseInt($0 % 32 / 8)"}], [{"column": "uid", "expr": "$0 % 32"}], allow_full_scan=True, primary_key=("uid",))
    write_table(spark.createDataFrame(rows, "uid long, name string, score double, birth_year int"), t, f"file://{tmp_path}/student")
    e.catalog.add("employees", t)
    return e


def count(e, sql, params=None):
    return e.sql(sql, params).count()


def test_counts_and_shards(engine):
    for where, n, shards in [
        ("uid=42 AND 1=2", 0, "[]"),
        ("uid=42", 1, "[1:10]"),
        ("uid IN (1,2,33)", 3, "[0:1,2]"),
        ("uid BETWEEN 1 AND 10", 10, "[0:1,2,3,4,5,6,7;1:8,9,10]"),
        ("42 = uid", 1, "[1:10]"),
        ("uid = PI() DIV 3", 1, "[0:1]"),
        ("NOT (uid <> 42) AND name LIKE 'name%'", 1, "[1:10]"),
        ("name = 'name7'", 1, "*"),
        ("uid IS NOT NULL", 100, "*"),
        ("NOT uid = 5", 99, "*"),
        ("uid = 5 OR name = 'name9'", 2, "*"),
        ("uid LIKE '7'", 1, "[0:7]"),
    ]:
        got = engine.sql(f"SELECT * FROM student WHERE {where}")
        assert (got.count(), render(engine.last_shards["student"])) == (n, shards), where


def test_parameters(engine):
    assert count(engine, "SELECT uid FROM student WHERE uid = ? AND score > ?", [42, 1]) == 1
    assert render(engine.last_shards["student"]) == "[1:10]"
    assert [r[0] for r in engine.prepare("SELECT uid FROM student WHERE uid < ? ORDER BY uid LIMIT ? OFFSET ?").execute(50, 2, 3).collect()] == [4, 5]


def test_aggregates_and_names(engine):
    got = engine.sql("SELECT count(*), count(*) DIV 3, max(score), min(score), sum(score), avg(score) FROM student")
    assert got.columns == ["count(*)", "count(*) DIV 3", "max(score)", "min(score)", "sum(score)", "avg(score)"]
    assert tuple(got.first()) == (100, 33, 95.0, 10.0, 1085.0, 10.85)
    got = engine.sql("SELECT uid, 2022-birth_year FROM student ORDER BY 2022-birth_year, uid LIMIT 1, 2")
    assert got.columns == ["uid", "2022-birth_year"] and [r[0] for r in got.collect()] == [13, 20]


def test_partition_pruning_reaches_the_scan(engine):
    for sql in ("SELECT * FROM student WHERE uid = 42", "SELECT * FROM student WHERE uid IN (42, 10)"):
        plan = engine.sql(sql)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "__tb" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_full_scan_guard(engine):
    engine.table("student").allow_full_scan = False
    with pytest.raises(FullScanDenied):
        engine.sql("SELECT * FROM student WHERE name = 'x'")
    assert count(engine, "SELECT /*A! fullscan() */ * FROM student") == 100
    assert count(engine, "SELECT * FROM student WHERE uid = 3") == 1
    with pytest.raises(FullScanDenied):
        engine.sql("DELETE FROM student WHERE name = 'x'")
    with pytest.raises(FullScanDenied):
        engine.sql("SELECT a.uid FROM student a JOIN student b ON a.uid = b.uid WHERE a.uid = 1")


def test_hints(engine):
    assert count(engine, "SELECT /*A! route(employees_0000.student_0001) */ * FROM student") == 4
    assert count(engine, "SELECT /*A! direct() */ * FROM student") == 3
    assert count(engine, "SELECT /*A! master(), trace(x) */ * FROM student WHERE uid = 1") == 1
    for bad in ("route(a.b), fullscan()", "master(), slave()", "route(ab)", "nosuch()"):
        with pytest.raises(HintError):
            engine.sql(f"SELECT /*A! {bad} */ * FROM student")


def test_outer_join_prunes_soundly(engine):
    sql = "SELECT a.uid, b.uid AS other FROM student a LEFT JOIN student b ON a.uid = b.uid + 1 WHERE a.uid IN (1, 2) AND b.uid = 1"
    assert [tuple(r) for r in engine.sql(sql).collect()] == [(2, 1)]


def test_zero_divisors(engine):
    assert engine.sql("SELECT 1 / 0, 5 % 0, 7 DIV (2 - 2), 1 / (count(*) - 100) FROM student").first()[:] == (None, None, None, None)


def test_strings_are_left_alone(engine):
    assert engine.sql("SELECT 'limit 1, 2 /*A! x() */ for update', \"a'b\", 'it''s'").first()[:] == ("limit 1, 2 /*A! x() */ for update", "a'b", "it's")


def test_dml(engine):
    assert engine.sql("UPDATE student SET score = 1 WHERE uid = 5").first()[0] == 1
    assert engine.sql("DELETE FROM student WHERE uid = 13 OR uid = 44").first()[0] == 2
    assert count(engine, "SELECT * FROM student") == 98
    assert engine.sql("INSERT INTO student (uid, name, score, birth_year) VALUES (9527, 'x', 100, 2000), (9528, 'y', NULL, 2001)").first()[0] == 2
    assert engine.sql("SELECT sum(score), count(score) FROM student WHERE uid >= 9527").first()[:] == (100.0, 1)
    assert engine.sql("UPDATE student SET score = 0 WHERE 1 = 2").first()[0] == 0
    assert engine.sql("DELETE FROM student WHERE uid BETWEEN 50 AND 60 ORDER BY uid LIMIT 3").first()[0] == 3
    assert sorted(r[0] for r in engine.sql("SELECT uid FROM student WHERE uid BETWEEN 50 AND 56").collect()) == [53, 54, 55, 56]
    engine.sql("INSERT IGNORE INTO student (uid, name) VALUES (1, 'again'), (7777, 'n')")
    assert [r[0] for r in engine.sql("SELECT name FROM student WHERE uid IN (1, 7777) ORDER BY uid").collect()] == ["name1", "n"]
    engine.sql("DELETE FROM student WHERE uid % 32 = 1")
    assert count(engine, "SELECT * FROM student WHERE uid % 32 = 1") == 0


def test_dml_rejections(engine):
    for bad in ("UPDATE student SET uid = 1 WHERE uid = 2", "INSERT INTO student (name) VALUES ('x')", "INSERT INTO student (uid, name) VALUES (1, 'x') ON DUPLICATE KEY UPDATE uid = 3"):
        with pytest.raises(ShardKeyError):
            engine.sql(bad)
    with pytest.raises(Exception, match="no shard"):
        engine.sql("INSERT INTO student (uid, name) VALUES (-1, 'x')")
    with pytest.raises(Exception, match="no shard"):
        engine.sql("INSERT INTO student (uid, name) VALUES (NULL, 'x')")


def test_transaction(engine):
    engine.sql("BEGIN")
    engine.sql("DELETE FROM student WHERE uid = 3")
    assert count(engine, "SELECT * FROM student WHERE uid = 3") == 1
    engine.sql("ROLLBACK")
    engine.sql("BEGIN; DELETE FROM student WHERE uid = 4; COMMIT")
    assert count(engine, "SELECT * FROM student WHERE uid IN (3, 4)") == 1


def test_ddl_and_sequences(engine):
    engine.sql("CREATE TABLE item (id BIGINT AUTO_INCREMENT PRIMARY KEY, uid BIGINT NOT NULL, price DECIMAL(6,2), note VARCHAR(20), KEY by_note (note)) DBPARTITION BY HASH(uid) DBPARTITIONS 2 TBPARTITION BY HASH(uid) TBPARTITIONS 2")
    assert [tuple(r) for r in engine.sql("SHOW TOPOLOGY FROM item").collect()] == [(0, "employees_0000", "item_0000"), (1, "employees_0000", "item_0001"), (2, "employees_0001", "item_0002"), (3, "employees_0001", "item_0003")]
    engine.sql("INSERT INTO item (uid, price, note) VALUES (1, 1.5, 'a'), (2, 2.5, 'b'), (3, 3.5, 'c')")
    ids = [r[0] for r in engine.sql("SELECT id FROM item").collect()]
    assert len(set(ids)) == 3
    engine.sql("ALTER TABLE item ADD COLUMN qty INT DEFAULT 7")
    assert {r[0] for r in engine.sql("SELECT qty FROM item").collect()} == {7}
    engine.sql("CREATE INDEX by_uid ON item (uid)")
    assert engine.sql("SHOW INDEX FROM item").count() == 3
    engine.sql("TRUNCATE TABLE item")
    assert count(engine, "SELECT * FROM item") == 0
    engine.sql("RENAME TABLE item TO thing")
    assert [r[0] for r in engine.sql("SHOW TABLES LIKE 'th%'").collect()] == ["thing"]
    engine.sql("DROP TABLE thing")
    assert [r[0] for r in engine.sql("SHOW TABLES").collect()] == ["student"]
    engine.sql("CREATE SEQUENCE s TYPE group")
    assert [engine.sql(f"SELECT s.{w}").first()[0] for w in ("nextval", "currval", "nextval")] == [1, 1, 2]
    assert engine.sql("SELECT s.nextval").columns == ["s.nextval"]
    with pytest.raises(LookupError):
        engine.sql("SELECT none.nextval")


def test_show(engine):
    for sql in ("SHOW DATABASES", "SHOW OPEN TABLES", "SHOW COLUMNS FROM student", "DESCRIBE student uid", "SHOW CREATE TABLE student", "SHOW TABLE STATUS", "SHOW VARIABLES LIKE 'auto%'", "SHOW COLLATION", "SHOW CHARACTER SET", "SHOW TABLE RULES FROM student", "SHOW DATABASE RULES FROM student", "SHOW SHARDING TABLE FROM employees", "CHECK TABLE student", "ANALYZE TABLE student"):
        assert engine.sql(sql).count() >= 1, sql
    for sql in ("SHOW WARNINGS", "SHOW MASTER STATUS", "SHOW REPLICAS", "SHOW NODES", "SHOW USERS", "SHOW PROCESSLIST"):
        engine.sql(sql).collect()
    assert engine.sql("EXPLAIN SELECT * FROM student WHERE uid = 42").first()["shards"] == "[1:10]"
    engine.sql("SET @@session.sql_mode = 'ANSI', autocommit = 0")
    assert engine.sql("SELECT @@sql_mode AS m").first()[0] == "ANSI"


def test_python_shard_function(spark, tmp_path):
    def place(name):
        return len(name) % 4

    e = Engine(spark, Catalog(), "d")
    t = make_table("p", "d", "p_${0..3}", [], [{"column": "name", "expr": place}], allow_full_scan=True)
    write_table(spark.createDataFrame([("a",), ("bb",), ("ccc",), ("dddd",)], "name string"), t, f"file://{tmp_path}/p")
    e.catalog.add("d", t)
    assert e.sql("SELECT * FROM p WHERE name IN ('bb', 'ccc')").count() == 2
    assert render(e.last_shards["p"]) == "[0:2,3]"


def test_keys_are_kept(engine):
    from shardloom.dml import DuplicateKeyError

    one = lambda sql: engine.sql(sql).first()[0]
    for bad in ("(5, 'x')", "(901, 'x'), (901, 'y')"):
        with pytest.raises(DuplicateKeyError):
            engine.sql(f"INSERT INTO student (uid, name) VALUES {bad}")
    assert count(engine, "SELECT * FROM student") == 100
    assert one("INSERT IGNORE INTO student (uid, name) VALUES (5, 'no'), (902, 'yes'), (902, 'no')") == 1
    assert one("REPLACE INTO student (uid, name) VALUES (5, 'first'), (5, 'last')") == 4
    assert one("SELECT name FROM student WHERE uid = 5") == "last"
    assert one("INSERT INTO student (uid, score) VALUES (903, 1), (903, 2), (903, 3) ON DUPLICATE KEY UPDATE score = score + VALUES(score) * 10") == 5
    assert one("SELECT score FROM student WHERE uid = 903") == 51.0


def test_a_swap_that_died_is_undone(engine):
    from shardloom.dml import _fs, recover

    table = engine.table("student")
    fs, path = _fs(engine, table.path)
    fs.mkdirs(path(f"{table.path}.old-x/__db=0"))
    fs.rename(path(f"{table.path}/__db=0/__tb=5"), path(f"{table.path}.old-x/__db=0/__tb=5"))
    engine.spark.catalog.refreshByPath(table.path)
    assert count(engine, "SELECT * FROM student WHERE uid IN (5, 37)") == 0
    recover(engine, table)
    assert count(engine, "SELECT * FROM student WHERE uid IN (5, 37)") == 2
    assert not fs.exists(path(f"{table.path}.old-x"))


def test_more_statements(engine):
    assert engine.sql("EXPLAIN INSERT INTO student (uid, name) VALUES (1, 'a'), (33, 'b')").first()["shards"] == "[0:1]"
    assert engine.sql("EXPLAIN DELETE FROM student WHERE uid = 42").first()["n_shards"] == 1
    engine.sql("ALTER TABLE student CHANGE name title VARCHAR(20)")
    assert [r[0] for r in engine.sql("SHOW COLUMNS FROM student LIKE 't%'").collect()] == ["title"]
    engine.sql("ALTER TABLE student RENAME COLUMN title TO name")
    engine.sql("RENAME TABLE student TO pupil, pupil TO learner")
    assert count(engine, "SELECT * FROM learner WHERE uid = 42") == 1
    assert [r[0] for r in engine.sql("SELECT GROUP_CONCAT(uid ORDER BY uid DESC SEPARATOR '/') AS g FROM learner WHERE uid IN (1, 2, 33)").collect()] == ["33/2/1"]
    assert [r[0] for r in engine.sql("SELECT birth_year FROM learner GROUP BY birth_year DESC LIMIT 2").collect()] == [1996, 1995]
    assert engine.sql("SELECT 1 XOR 1 AS a, IF(2, 'y', 'n') AS b, MOD(7, 3) AS c").collect()[0] == (False, "y", 1)
    assert engine.spark.catalog.listTables() == [t for t in engine.spark.catalog.listTables() if not t.name.startswith("sl_learner")]


def test_maintenance(engine):
    table = engine.table("student")
    engine.spark.range(1).selectExpr("64L AS uid", "'stray' AS name", "1D AS score", "1990 AS birth_year", "1 AS __db", "9 AS __tb").write.mode("append").partitionBy("__db", "__tb").parquet(table.path)
    assert engine.sql("CHECK TABLE student").first()["Msg_text"] == "1 rows outside their shard"
    assert count(engine, "SELECT * FROM student WHERE name = 'stray'") == 0
    engine.sql("OPTIMIZE TABLE student")
    assert engine.sql("CHECK TABLE student").first()["Msg_type"] == "error"
    engine.sql("REPAIR TABLE student")
    assert engine.sql("CHECK TABLE student").first()["Msg_text"] == "OK"
    assert count(engine, "SELECT * FROM student WHERE uid = 64") == 2 and count(engine, "SELECT * FROM student") == 101
    got = engine.sql("SHOW TABLE STATUS LIKE 'student'").first()
    assert got["Rows"] == 101 and got["Data_length"] // 101 == got["Avg_row_length"] > 0
    files = glob.glob(f"{table.path.removeprefix('file://')}/*/*/*.parquet")
    with open(files[0], "wb") as f:
        f.write(b"no parquet")
    assert engine.sql("CHECK TABLE student").first()["Msg_type"] == "error"
