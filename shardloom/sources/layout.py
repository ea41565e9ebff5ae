"""Reading and writing a logical table as Parquet partitioned by (__db, __tb).

Every stored row satisfies the layout identity (__db, __tb) = rule(keys). Reads
carry it as a filter, so that Catalyst derives partition filters from equality
predicates and join keys by itself; the pruner covers lists, ranges and ORs.
"""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..catalog import LogicalTable, Shard
from ..prune import shard_filter

PARTS = ("__db", "__tb")


class ShardKeyError(ValueError):
    """A row without a shard key, or with one outside the topology."""


def storage_root(spark: SparkSession) -> str:
    """Folder shared by all executors: spark.checkpoint.dir; a temp folder only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def ensure_functions(spark: SparkSession) -> None:
    """Our SQL functions, in a session that was built elsewhere."""
    if not spark.catalog.functionExists("sl_strcmp"):
        from ..functions import register

        register(spark)


def with_shards(df: DataFrame, table: LogicalTable) -> DataFrame:
    """Add __db and __tb; a null or foreign shard raises when the row is computed."""
    sql = table.layout_sql()
    if sql:
        db, tb = F.expr(sql[0]).cast("int"), F.expr(sql[1]).cast("int")
    else:
        keys = list(table.vshards[0].columns)

        @F.pandas_udf("array<int>")
        def place(frame: pd.DataFrame) -> pd.Series:
            return pd.Series([list(table.locate(table.vshards[0], dict(zip(keys, v, strict=True))) or (None, None)) for v in frame.itertuples(index=False)])

        at = place(F.struct(*keys))
        db, tb = at[0], at[1]
    out = df.withColumns({"__db": db, "__tb": tb})
    grid = F.lit(False)
    for d, tables in table.topology.grid.items():
        grid = grid | ((F.col("__db") == d) & F.col("__tb").between(min(tables), max(tables)))
    wrong = F.raise_error(F.concat(F.lit(f"no shard of {table.name} for key "), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in table.vshards[0].columns])))
    return out.withColumn("__db", F.when(F.coalesce(grid, F.lit(False)), F.col("__db")).otherwise(wrong.cast("int")))


def write_table(df: DataFrame, table: LogicalTable, path: str, mode: str = "overwrite") -> None:
    """One shuffle brings each shard's rows together, so a shard gets few files; AQE splits large ones."""
    table.path = path
    placed = with_shards(df, table)
    table.schema = df.schema
    placed.hint("rebalance", *[F.col(p) for p in PARTS]).write.mode(mode).partitionBy(*PARTS).parquet(path)


def read_table(spark: SparkSession, table: LogicalTable, shards: set[Shard] | None = None, identity: bool = True) -> DataFrame:
    """The logical table; `shards` limits it to those partitions. The partition columns are left in."""
    if not table.path:
        raise ValueError(f"{table.name} has no storage")
    reader = spark.read
    if table.schema is not None:
        known = StructType.fromDDL(table.schema) if isinstance(table.schema, str) else table.schema
        reader = reader.schema(StructType([*known.fields, StructField("__db", IntegerType()), StructField("__tb", IntegerType())]))
    df = reader.parquet(table.path)
    if shards is not None:
        df = df.where(shard_filter(shards))
    sql = table.layout_sql()
    if identity and sql:
        df = df.where(f"{sql[1]} = __tb AND {sql[0]} = __db")
    return df
