"""Mixing sources to target weights by temperature.

Source shares p (of tokens) become weights p^a / sum p^a. The exponent a in
[0, 1] is found by repeated section of its interval (31 inner points a round,
all evaluated in one aggregation over the table of sources, which never leaves
Spark): the smallest a at which no source is repeated more than `max_repeats`
times within the budget and, if given, the entropy of the weights is at most
`target_entropy` (nats).

A source's target of tokens is realised as whole passes over its documents and
one partial pass. A pass is a permutation of blocks: documents fall into 4,096
blocks of 4,096 sub-blocks by hash; blocks follow each other in an order of the
pass's own. The partial pass takes blocks from the start until the next document
would exceed the budget; the bounding block, then the bounding sub-block, are
found from sums, so only one sub-block of a source is ever ordered by document.

Defined results: a null source is a source of its own; texts without words
(null, empty) weigh nothing and are in every whole pass; repeated rows are each
drawn; an empty table gives no rows. A budget beyond `max_repeats` times all
tokens, or an entropy that proportional weights already exceed, cannot be met
and raises ValueError. A very long text is one row like others, drawn whole or
not at all. Columns of the input are kept, whatever their names; added ones (n_tokens,
weight, pass, position) replace input columns of those names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import native as N

BLOCKS = 1 << 12
ROUNDS, POINTS = 6, 31


def find_exponent(sources: DataFrame, budget: float, total: float, max_repeats: float, target_entropy: float | None) -> float:
    """Smallest exponent that meets the limits; `sources` holds n_tokens > 0."""
    p = F.col("n_tokens") / F.lit(total)

    def meets(points: list[float]) -> list[bool]:
        out = []
        for i, a in enumerate(points):
            out += [F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"e{i}"), F.max(F.pow(p, F.lit(a - 1.0))).alias(f"r{i}")]
        got = sources.agg(*out).first()
        ok = []
        for i, a in enumerate(points):
            z, e, r = got[f"z{i}"], got[f"e{i}"], got[f"r{i}"]
            from math import log

            entropy = log(z) - a * e / z
            ok.append(r / z * budget / total <= max_repeats * (1 + 1e-9) and (target_entropy is None or entropy <= target_entropy * (1 + 1e-9)))
        return ok

    at_ends = meets([0.0, 1.0])
    if not at_ends[1]:
        raise ValueError("no exponent meets the limits: even proportional weights repeat a source too often or have too high an entropy")
    if at_ends[0]:
        return 0.0
    low, high = 0.0, 1.0  # low fails, high meets
    for _ in range(ROUNDS):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        ok = meets(points)
        first = ok.index(True) if True in ok else POINTS
        low, high = (points[first - 1] if first else low), (points[first] if first < POINTS else high)
    return high


def mix_sources(docs: DataFrame, budget: float | None = None, max_repeats: float = 1.25, target_entropy: float | None = None, seed: int = 23) -> DataFrame:
    """The rows of `docs`, each as often as it is drawn, with n_tokens, weight, pass (from 1) and position (0 to 1).

    `budget`: tokens of the mixture, by default as many as there are. Ordered by
    `position`, every stretch of the mixture holds the sources in their weights.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "weight", "pass", "position")
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(BLOCKS * BLOCKS))
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    # whole rows travel in one column, so that theirs may have any names
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("source"), n_tokens.alias("n_tokens"), u.alias("_u"))
    slim = C.materialize(rows.select("source", "n_tokens", "_u"))
    sources = C.materialize(slim.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")))
    full = sources.where("n_tokens > 0")
    total = float(full.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return rows.select("row.*", "n_tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("pass"), F.lit(0.0).alias("position"))
    budget = total if budget is None else float(budget)
    a = find_exponent(full, budget, total, max_repeats, target_entropy)
    share = F.pow(F.col("n_tokens") / F.lit(total), F.lit(a))
    z = full.agg(F.sum(share)).first()[0]
    plan = sources.withColumn("weight", F.when(F.col("n_tokens") > 0, share / F.lit(z)).otherwise(0.0))
    epochs = F.when(F.col("n_tokens") > 0, F.col("weight") * budget / F.col("n_tokens")).otherwise(1.0)
    # a target within rounding of whole passes is whole
    plan = plan.withColumn("epochs", epochs).withColumn("whole", F.floor(F.col("epochs") + 1e-9)).withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("epochs") - F.col("whole")) * F.col("n_tokens") + 1e-6))
    plan = C.materialize(plan.select(F.col("source").alias("_source"), "weight", "epochs", "whole", "rest"))

    def bounding(part: DataFrame, bounds: DataFrame, cell) -> DataFrame:
        """For each source the cell in which the running sum of tokens passes `rest`, and what is left there."""
        near = part.join(bounds, part["source"].eqNullSafe(bounds["_source"])).where("rest > 0")
        sums = near.groupBy("_source", "rest", cell.alias("cell")).agg(F.sum("n_tokens").alias("n"))
        run = F.sum("n").over(Window.partitionBy("_source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))  # at most BLOCKS rows a source
        passed = sums.withColumn("run", run).where(F.col("run") > F.col("rest"))
        first = passed.groupBy("_source").agg(F.min(F.struct("cell", (F.col("rest") - F.col("run") + F.col("n")).alias("left"))).alias("m"))
        return first.select("_source", F.col("m.cell").alias("cell"), F.col("m.left").alias("left"))

    block, sub = F.shiftright("_u", 12), F.col("_u").bitwiseAND(F.lit(BLOCKS - 1))
    one = C.materialize(bounding(slim, plan.select("_source", "rest"), block).withColumnsRenamed({"cell": "b1", "left": "left1"}))
    inside = slim.join(one.withColumnRenamed("_source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & (block == F.col("b1"))).select("source", "n_tokens", "_u")
    two = bounding(inside, one.select("_source", F.col("left1").alias("rest")), sub).withColumnsRenamed({"cell": "b2", "left": "left2", "_source": "_s2"})
    plan = plan.join(one.withColumnRenamed("_source", "_s1"), plan["_source"].eqNullSafe(F.col("_s1")), "left").drop("_s1")
    plan = C.materialize(plan.join(two, plan["_source"].eqNullSafe(F.col("_s2")), "left").drop("_s2"))

    small = plan.limit(N.BROADCAST_ROWS + 1).count() <= N.BROADCAST_ROWS
    joined = rows.join(F.broadcast(plan) if small else plan, rows["source"].eqNullSafe(plan["_source"]))
    # no bounding block: the partial pass, if any, takes all; a block whose own rest is nothing takes none of its cells
    cell = F.coalesce((block == F.col("b1")) & (sub == F.col("b2")), F.lit(False))
    before = F.coalesce((block < F.col("b1")) | ((block == F.col("b1")) & (sub < F.col("b2"))), (F.col("rest") > 0) & F.col("b1").isNull())
    out = joined.where(~cell).withColumn("partial", before.cast("int"))
    w = Window.partitionBy("_source").orderBy("_u", "row.doc_id", "row.text").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.where(cell).withColumn("partial", (F.sum("n_tokens").over(w) <= F.col("left2")).cast("int"))
    out = out.unionByName(edge).withColumn("_n", F.col("whole") + F.col("partial")).where("_n > 0")
    out = out.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))))
    turn = F.xxhash64("source", "pass", F.lit(seed))
    moved = F.pmod(block * (F.pmod(turn, F.lit(BLOCKS // 2)) * 2 + 1) + F.pmod(F.shiftright(turn, 20), F.lit(BLOCKS)), F.lit(BLOCKS))
    spot = F.when(F.col("pass") > F.col("whole"), F.col("_u")).otherwise(moved * BLOCKS + sub) / float(BLOCKS * BLOCKS)
    partial_size = F.greatest(F.col("epochs") - F.col("whole"), F.lit(1e-9))
    spot = F.when(F.col("pass") > F.col("whole"), F.least(F.lit(1.0), spot / partial_size) * partial_size).otherwise(spot)
    out = out.withColumn("position", F.least(F.lit(1.0), (F.col("pass") - 1 + spot) / F.greatest(F.col("epochs"), F.lit(1e-9))))
    return out.select("row.*", "n_tokens", "weight", "pass", "position")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).drop("text")
