import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>", "None"):
            return None
        return float(v) if not isinstance(v, str) and hasattr(v, "__float__") else str(v)[:10]

    cols = sorted(frame.columns)
    return cols, sorted(repr([cell(v) for v in r]) for r in frame[cols].astype(object).values.tolist())


def names():
    from shardloom.queries import ORACLE_SQL

    return list(ORACLE_SQL)


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, name):
    import duckdb

    from shardloom.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(ORACLE_SQL[name]).fetchdf())


def test_format_bytes_ends_at_gib(spark, tmp_path):
    """Keys below and above each change of unit, 2^40 bytes and more included, where the SQL stays with GiB."""
    import duckdb

    from shardloom.queries import ORACLE_SQL, QUERIES

    keys = [None, 0, 11, 12, 362, 363, 11585, 11586, 370727, 370728, 899_999, 8_999_999, 1_073_741_823]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {k: b for k, b in con.execute(ORACLE_SQL["fn_format_bytes"]).fetchall()}
    assert want[370_728] == "1024.00 GiB"
    assert {r.o_orderkey: r.b for r in QUERIES["fn_format_bytes"](spark, str(tmp_path)).collect()} == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
