import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.shardexpr import ShardExpression, ShardExpressionError


def test_goldens():
    db, tb = ShardExpression.parse("($value % 128) / 32"), ShardExpression.parse("return $value % 128;")
    assert [db.evaluate(x) for x in (1, 16, 32, 100, 128, 129)] == [0, 0, 1, 3, 0, 0]
    assert [tb.evaluate(x) for x in (1, 16, 32, 100, 128, 129)] == [1, 16, 32, 100, 0, 1]
    assert ShardExpression.parse("$1*31+$0").evaluate(100, 7) == 317
    assert ShardExpression.parse("$0 % 128 / 32").evaluate(-100) == -3
    assert ShardExpression.parse("parseInt($0 % 32 / 8)").evaluate("42") == 1
    assert ShardExpression.parse("$0 % 0").evaluate(5) is None


@pytest.mark.parametrize("text", ["if ($0) { return 1 }", "$0 +", "foo($0)", "$x", "$0.length", ""])
def test_outside_the_language(text):
    with pytest.raises(ShardExpressionError):
        ShardExpression.parse(text)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**40), 2**40), st.integers(-1000, 1000)), min_size=1, max_size=20), st.sampled_from(["$0 % 32 / 8", "($0*31+$1) % 32", "-$0 % 7", "Math.floor($0 / 3)", "Math.abs($1) * 2 - 1", "parseInt($0 % 32 / 8) + $1 % 3"]))
def test_python_equals_spark(spark, rows, text):
    e = ShardExpression.parse(text)
    df = spark.createDataFrame(rows, "a long, b long").selectExpr("a", "b", f"{e.sql('a', 'b')} AS v")
    assert [r["v"] for r in df.collect()] == [e.evaluate(a, b) for a, b in rows]
