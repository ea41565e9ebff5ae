import pytest

from shardloom.sequence import EPOCH_MS, Group, SequenceError, Sequences, Snowflake
from shardloom.streaming import event_windows


def test_snowflake_layout():
    s = Snowflake(worker=5, clock=lambda: EPOCH_MS + 7)
    a, b = s.next(), s.next()
    assert a >> 22 == 7 and (a >> 12) & 1023 == 5 and b == a + 1
    assert len(set(s.block(5000))) == 5000


def test_group_blocks(tmp_path):
    path = str(tmp_path / "seq.json")
    one, two = Group("s", 3, path), Group("s", 3, path)
    assert one.block(2) == [1, 2] and two.next() == 4 and one.block(2) == [3, 7]


def test_registry():
    s = Sequences()
    s.register("own", lambda name, **o: Group(name, 2))
    s.create("x", "own")
    with pytest.raises(SequenceError):
        s.current_value("x")
    assert s.next_value("x") == 1
    with pytest.raises(SequenceError):
        s.next_value("y")


def test_windows_on_a_stream_equal_those_on_a_table(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7) AS ts, id % 3 AS user_id, concat('t', id % 2) AS event_type, id * 1.0D AS value FROM range(200)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("win").collect())) == sorted(map(str, event_windows(rows).collect()))


def test_reserved_ranges(spark, tmp_path):
    from pyspark.sql import functions as F

    from shardloom.sequence import Group, Snowflake

    clock = iter([2_000_000_000_000] * 3)
    s = Snowflake(3, lambda: next(clock))
    first = s.next()
    make, last = s.reserve(5000)
    got = [r[0] for r in spark.range(5000).select(make(F.col("id"))).collect()]
    assert got == sorted(set(got)) and got[0] == first + 1 and got[-1] == last and s.next() > last
    one, two = Group("g", 3, str(tmp_path / "c.json")), Group("g", 3, str(tmp_path / "c.json"))
    assert one.next() == 1
    make, last = two.reserve(4)
    assert [r[0] for r in spark.range(4).select(make(F.col("id"))).collect()] == [4, 5, 6, 7] and last == 7
    assert one.block(3) == [2, 3, 8]
