"""The Spark session and the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import register


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; other settings stay the cluster's."""
    builder = SparkSession.builder.appName("shardloom")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    spark = builder.config(map=settings | conf).getOrCreate()
    register(spark)
    return spark


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Parquet tables of a folder as temporary views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
