"""Connected components of a link table by contraction, entirely in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, root): nodes of `edges` (a, b: long), alike in root exactly if linked, in any number of steps.

    Each round sends every node to the neighbour (or itself) with the smallest
    hash and contracts; hashed order halves even long chains. Minima are
    aggregated partially before the shuffle, so a hub costs no more than others,
    and every round is written to the shared folder. No edges: an empty table.
    """
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(5)).alias("h"), F.col(c).alias("v"))
    rest = C.materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = C.materialize(rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct().select("node", F.col("node").alias("root")))
    while rest.limit(1).count():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hook = C.materialize(near.select(F.col("a").alias("v"), F.least("m", rank("a"))["v"].alias("to")))
        labels = C.replace(labels, labels.join(hook, labels["root"] == hook["v"], "left").select("node", F.coalesce("to", "root").alias("root")))
        moved = rest.join(hook, rest["a"] == hook["v"]).select(F.col("to").alias("a"), "b")
        moved = moved.join(hook, moved["b"] == hook["v"]).select("a", F.col("to").alias("b")).where("a <> b")
        rest = C.replace(rest, moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        C.drop(hook)
    C.drop(rest)
    return labels
