"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated
random hashes (signs of random projections) and compares every vector with its
neighbours in that order. Passes carry vectors in a byte a component, whose error
is known; pairs that this leaves open are compared in double precision (others
follow from it), and verified pairs of all passes are united. A pair at the threshold agrees in a bit with probability
1 - arccos(t) / pi, so the number of passes follows from the size of the largest
label and the recall asked for (`passes_for`), if vectors are spread evenly. How
many bits it really takes to tell a vector from those it does not link with is
measured on each label (`measure`); labels whose vectors share a direction get
more passes, or are compared whole in blocks where that costs less.

Equal vectors are compared once and counted with their copies. A window bounds
what one pass compares, so large groups need more: after the components are
known, the vectors of every component are compared with each other in blocks of
bounded size, which finds all links inside a component exactly. No pair inside
a component is written; blocks report numbers of links.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of
different lengths do not link; repeated rows count as vectors of their own; a
null vec_id takes its component's smallest id, if any. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import graph

BITS = 32
#: Neighbours in order that each vector is compared with, at least.
WINDOW = 128
#: Windows that a partition of the order holds, at least, so that few end at its boundary.
WINDOWS = 32
#: Vectors of a component that are compared at a time.
BLOCK = 1024
#: Vectors of a label that measure() takes bits from, those it takes them for, and passes it looks at.
SAMPLE, QUERIES, PILOTS = 4096, 256, 8
#: Passes a label may need before it is compared whole instead, if small enough; and what stands for no number being enough.
PASSES, ENDLESS = 64, 1 << 20


def passes_for(largest: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold was neighbours at least once, with probability `recall`."""
    agree = 1 - math.acos(threshold) / math.pi
    depth = max(0.0, math.log2(max(1, largest) / (WINDOW / 2)))
    once = agree ** math.ceil(depth + 1) * (1 - 1 / WINDOWS)  # a window may end with its partition
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision; all rows have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def measure(x: np.ndarray, size: int, threshold: float, recall: float, seed: int = 17) -> int:
    """Passes that a label of `size` vectors needs for `recall`, from unit rows `x` drawn from it evenly.

    A pair is neighbours in a pass if it agrees in the bits after which fewer
    than half a window of others, not linked with it, are left beside it.
    """
    rng = np.random.default_rng([seed, len(x)])
    of = rng.permutation(len(x))[:QUERIES]
    other = x[of] @ x.T < threshold
    agree = (1 - math.acos(threshold) / math.pi) ** np.append(np.arange(BITS + 1), np.inf)
    once = np.zeros(len(of))
    for _ in range(PILOTS):
        code = (x @ rng.normal(size=(x.shape[1], BITS)) > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
        alike = BITS - np.frexp((code[of][:, None] ^ code[None, :]).astype(np.float64))[1]
        left = np.stack([((alike >= d) & other).sum(1) for d in range(BITS + 1)], 1) * (size / len(x)) < WINDOW / 2
        once += agree[np.where(left.any(1), left.argmax(1), BITS + 1)] * (1 - 1 / WINDOWS) / PILOTS
    need = 4
    while need < ENDLESS and np.mean((1 - once) ** need) > 1 - recall:
        need = math.ceil(need * 1.25)
    return min(need, ENDLESS)


def needed(vectors: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(part, size, need): vectors of each label and the passes they need."""
    sizes = vectors.groupBy("part").agg(F.count("*").alias("size"))
    drawn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < F.lit(SAMPLE * float(1 << 30)) / F.col("size")
    sample = vectors.join(sizes, "part").where(drawn).select("part", "size", "embedding")

    def run(rows):
        size = rows["size"][0].as_py()
        need = 4 if size <= WINDOW else measure(_matrix(rows["embedding"].combine_chunks()), size, threshold, recall)
        return pa.table({"part": rows["part"][:1], "size": [size], "need": pa.array([need], pa.int32())})

    return sample.groupBy("part").applyInArrow(run, "part long, size long, need int")


def compared_whole(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join whatever is linked among `vectors` (node, part, size, embedding), all compared in blocks."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = vectors.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = spread.select("part", "node", "embedding", "block", other)
    sent = sent.select("part", "node", "embedding", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def run(key, rows):
        first = np.flatnonzero(rows["block"].to_numpy() == key[1].as_py())
        second = np.flatnonzero(rows["block"].to_numpy() != key[1].as_py())
        x, node = _matrix(rows["embedding"].combine_chunks()), rows["node"].to_numpy()
        order = np.concatenate([first, second])
        r, c = forest(x[first] @ x[order].T >= threshold)
        return pa.table({"a": node[order][r], "b": node[order][c]})

    return sent.groupBy("part", "lo", "hi").applyInArrow(run, "a long, b long")


def project(vectors: DataFrame, seed: int = 17) -> DataFrame:
    """(turn, part, code, node, short, off): each vector once in each of its `passes`, with its concatenated hashes.

    `short`: the vector in a byte a component; `off`: how far its direction is from the vector's.
    """
    kind = pa.schema([("turn", pa.int32()), ("part", pa.int64()), ("code", pa.int64()), ("node", pa.int64()), ("short", pa.binary()), ("off", pa.float32())])

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        power = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in batches:
            for i in range(0, len(batch), 2048):
                rows = batch.slice(i, 2048)
                size, passes = np.asarray(rows.column(2).value_lengths()), rows.column(3).to_numpy()
                for dim, most in np.unique(np.column_stack([size, passes]), axis=0).tolist():
                    own = rows.take(pa.array(np.flatnonzero((size == dim) & (passes == most))))
                    x = _matrix(own.column(2))
                    byte = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
                    off = np.linalg.norm(x - directions(byte), axis=1) + 1e-5
                    short = pa.array([b.tobytes() for b in byte], pa.binary())
                    for turn in range(most):
                        if (dim, turn) not in planes:
                            planes[dim, turn] = np.random.default_rng([seed, dim, turn]).normal(size=(dim, BITS))
                        code = (x @ planes[dim, turn] > 0) @ power
                        yield C.batch_of(kind, turn=np.full(len(own), turn, np.int32), part=own.column(1), code=code, node=own.column(0), short=short, off=off)

    return vectors.select("node", "part", "embedding", "passes").mapInArrow(run, "turn int, part long, code long, node long, short binary, off float")


def directions(byte: np.ndarray) -> np.ndarray:
    """Unit rows of vectors of bytes."""
    x = byte.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of links that join whatever the links of `near` (columns beyond its diagonal) join."""
    near = np.triu(near, 1)
    if near.sum() <= 2 * near.shape[1]:
        return np.nonzero(near)
    n = near.shape[1]
    full = np.zeros((n, n), bool)
    full[: near.shape[0]] = near
    full |= full.T
    left, kept = np.ones(n, bool), []
    for root in np.flatnonzero(full.any(1)).tolist():
        if not left[root]:
            continue
        left[root] = False
        edge = np.array([root])
        while len(edge):
            step = full[edge] & left[None, :]
            new = np.flatnonzero(step.any(0))
            left[new] = False
            kept += [(int(edge[p]), int(c)) for p, c in zip(step[:, new].argmax(0), new, strict=True)]
            edge = new
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def neighbours(ordered: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sure): pairs among neighbours of the given order, within each partition.

    Directions of bytes tell a cosine to within the sum of what they are off; so
    a pair is a link for `sure`, or not at all, or left to `verified`, unless
    sure links of its window join the two already.
    """
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def run(batches):
        tail: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            turn, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            size = pc.binary_length(batch.column(4)).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (part[1:] != part[:-1]) | (size[1:] != size[:-1]), [True]]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                name = (int(turn[lo]), int(part[lo]), int(size[lo]))
                byte = np.frombuffer(b"".join(batch.column(4).slice(lo, hi - lo).to_pylist()), np.int8).reshape(hi - lo, -1)
                own = (directions(byte), batch.column(3).slice(lo, hi - lo).to_numpy(), batch.column(5).slice(lo, hi - lo).to_numpy().astype(float))
                if name in tail:
                    own = tuple(np.concatenate(v) for v in zip(tail[name], own, strict=True))
                x, node, off = own
                for i in range(0, len(x), WINDOW):
                    j = slice(i, i + 2 * WINDOW)
                    cosine = x[i : i + WINDOW] @ x[j].T
                    give = off[i : i + WINDOW, None] + off[j]
                    if not (cosine >= threshold - give).sum() > len(cosine):  # besides each with itself
                        continue
                    r, c = forest(cosine >= threshold + give)
                    joined = groups(len(x[j]), r, c)
                    ur, uc = np.nonzero(np.triu(np.abs(cosine - threshold) < give, 1) & (joined[: len(cosine), None] != joined[None, :]))
                    yield C.batch_of(kind, a=np.concatenate([node[i + r], node[i + ur]]), b=np.concatenate([node[i + c], node[i + uc]]), sure=np.arange(len(r) + len(ur)) < len(r))
                tail = {name: tuple(v[-WINDOW:] for v in own)}

    return ordered.mapInArrow(run, "a long, b long, sure boolean")


def groups(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A number for each of n things, alike for those that links r to c join."""
    of = np.arange(n)
    while len(r):
        low = np.minimum(of[r], of[c])
        before = of.copy()
        np.minimum.at(of, r, low)
        np.minimum.at(of, c, low)
        if (of == before).all():
            break
    return of


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) that are links, in double precision."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column(2).value_lengths())
            for dim in np.unique(size).tolist():
                rows = batch.take(pa.array(np.flatnonzero(size == dim)))
                ok = pa.array(np.einsum("ij,ij->i", _matrix(rows.column(2)), _matrix(rows.column(3))) >= threshold)
                yield C.batch_of(kind, a=rows.column(0).filter(ok), b=rows.column(1).filter(ok))

    side = lambda k, v: vectors.select(F.col("node").alias(k), F.col("embedding").alias(v))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links) for `members` (node, root, copies, embedding): links within each component, copies counted."""
    sizes = C.materialize(members.groupBy("root").agg(F.count("*").alias("size")))  # so that a large root's rows can be split in the join
    # few rows a block in small components, and no more copies of each vector than its root calls for in large ones
    blocks = F.greatest(F.ceil(F.sqrt(F.col("size") / 16)), F.ceil(F.col("size") / BLOCK))
    spread = members.join(sizes, "root").withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    # a block meets each block (itself too) once: as the smaller of the two or as the larger
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = spread.select("root", "node", "copies", "embedding", "block", other)
    sent = sent.select("root", "node", "copies", "embedding", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    kind = "node long, links long"

    def run(key, rows):
        x = _matrix(rows["embedding"].combine_chunks())
        node, copies, block = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
        one = np.flatnonzero(block == rows["lo"][0].as_py())
        two = np.flatnonzero(block == rows["hi"][0].as_py())
        near = x[one] @ x[two].T >= threshold
        if rows["lo"][0] == rows["hi"][0]:
            np.fill_diagonal(near, False)
            return pa.table({"node": node[one], "links": (near @ copies[two]).astype(np.int64)})
        return pa.table({"node": np.concatenate([node[one], node[two]]), "links": np.concatenate([near @ copies[two], copies[one] @ near]).astype(np.int64)})

    # one key of its own for each two blocks, or all of a component would stay where its root was dealt
    cells = sent.withColumn("cell", F.concat_ws(":", "root", "lo", "hi")).drop("root")
    return cells.groupBy("cell").applyInArrow(run, kind).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(table: DataFrame, threshold: float = 0.93, recall: float = 0.999) -> DataFrame:
    """One row for every row of `table`: vec_id, n_links, component_id, kept."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = table.select("vec_id", F.when(good, F.xxhash64("label", "embedding")).alias("node"), F.xxhash64("label", F.size(x)).alias("part"), "embedding")
    vectors = C.materialize(rows.where("node is not null").groupBy("node").agg(F.first("part").alias("part"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    plan = C.materialize(needed(vectors, threshold, recall))
    least_passes = passes_for(plan.agg(F.max("size")).first()[0] or 0, threshold, recall)
    plan = plan.withColumn("whole", (F.col("need") > PASSES) & (F.col("size") <= F.col("need") * (BLOCK // 2)))
    planned = vectors.select("node", "part", "embedding").join(plan.withColumn("passes", F.greatest("need", F.lit(least_passes))), "part")
    projected = project(planned.where("not whole"))
    sent = planned.where("not whole").agg(F.sum("passes")).first()[0] or 0
    n = max(1, min(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), sent // (WINDOWS * WINDOW)))
    # the node breaks ties, so that equal codes spread over partitions
    ordered = projected.repartitionByRange(n, "turn", "part", "code", "node").sortWithinPartitions("turn", "part", "code", "node")
    found = C.materialize(neighbours(ordered, threshold).distinct())
    links = found.where("sure").select("a", "b")
    links = links.union(verified(found.where("not sure").select("a", "b").join(links, ["a", "b"], "left_anti"), vectors, threshold))
    if plan.where("whole").limit(1).count():
        links = links.union(compared_whole(planned.where("whole"), threshold))
    links = C.materialize(links.distinct())
    roots = C.materialize(graph.components(links))
    members = C.materialize(roots.join(vectors, "node").select("node", "root", "copies", "embedding"))
    linked = link_counts(members, threshold)
    least = C.materialize(roots.join(vectors.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component")))
    known = vectors.select("node", "copies", "least").join(roots, "node", "left").join(linked, "node", "left").join(least, "root", "left")
    known = known.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    got = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component", "vec_id")
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
         WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT rid, rid FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY a),
n AS (SELECT a AS rid, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept
FROM v JOIN comp USING (rid) LEFT JOIN n USING (rid)
"""
