"""N-gram Jaccard join: exact set-similarity links by partitioning the universe.

A document's set holds the hashes of its distinct word n-grams. Sets of two
documents that reach the threshold differ in at most H elements, H following
from their sizes. Sizes fall into bands; for every band the universe of hashes
is cut into m segments, and a set's part of a segment is summed up in one
number, its signature. A band uses one of two forms, by expected cost
(`allocate`), which counts signatures written and sets kept for no reason:

* whole signatures: m = H + 1 + spare. Differences spoil at most H segments, so
  linked sets share all but H of their segments.
* one-deletion neighbourhoods: m = ceil((H + 1) / 2). Some segment differs in at
  most one element, so one set's signature is the other's, or that of the other
  with one element deleted; sets emit both kinds.

What follows never joins all members of a signature's group:

1. *Shared signatures.* A signature that no other set holds cannot be one of
   those that linked sets have in common. A set that is left with fewer shared
   ones than any link needs, has no partner and is done (`survivors`). Most sets
   end here, however common single passages of theirs are.
2. *Leaders.* Each remaining set meets the one of each of its groups that has most
   to spare, which in a group of near copies is about its middle. Candidates compare sketches (two sets' parity bits differ in no more
   cells than the sets do in elements) and are verified exactly.
3. *Allocation by set.* What is still in different components meets by the
   signatures that the sets' own costs allow to choose: all signatures have one
   order, rarest first; if at most H of two sets' segments differ, both hold a
   common one among their first H + 1. Within a group, sets of its largest
   component meet only sets of others, and only pairs whose sizes and 512-bit
   sketches leave a link possible are written; they are verified exactly.

So no link between components is lost; links inside one change nothing.

n-grams and sets are known by 64-bit hashes; two different sets count as the
same with a chance of 2^-64 a pair. The last verification compares the upper 48
bits of n-gram hashes.

Defined results: null and wordless texts have the empty set and link with
nothing (component_id is their own id); a text of fewer than n words has its
whole sequence as one n-gram; a null id takes the smallest id of its component,
if any; rows alike in all give rows alike; an empty table gives no rows. A very
long text is one set of as many elements, never cut. Other columns are ignored,
and `keep_one` carries them whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import graph
from . import native as N

RATIO = 1.4
#: Spare segments for each that may be spoiled, of which `allocate` takes the cheapest.
SPARE = (0.2, 0.5, 1.0, 2.0)
#: Chance that a given n-gram of a set stands in another, unrelated one; for the cost of chance partners only.
SHARED = 1e-6
#: Cost of a set kept for no reason, in signatures for each of its elements.
KEPT = 4.0
#: 64-bit words of the sketches that are compared inside the join.
WORDS = 8
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all documents, and the index of each document's first."""
    low = C.LOWER[data]
    start, end, first = C.words(low, offsets, C.NOT_SPACE)
    word = C.Hashes(low).of(start, end)
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), size)
    total = int(size.sum())
    gram_first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(total) - gram_first[doc] + first[doc]
    length = np.minimum(count, n)[doc]
    h = np.zeros(total, np.uint64)
    for j in range(n):
        use = j < length
        nxt = word[np.minimum(at + j, max(0, len(word) - 1))] if len(word) else h
        h = np.where(use, (h + nxt) * _ODD, h)
    h = C.mix(h + length.astype(np.uint64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(total, bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set's content."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(C.mix(h ^ np.uint64(0xA5A5A5A5)), out=sums[1:])
    return C.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


class Sets:
    """Runs over the chunks of a partition; tells which contents the task has not seen before."""

    def __init__(self, n: int):
        self.n, self.seen = n, set()

    def of(self, batches):
        for batch in batches:
            for part, data, offsets in C.chunks(batch):
                h, first = shingles(data, offsets, self.n)
                key = set_keys(h, first)
                yield part, h, first, key, self.fresh(key, first)

    def fresh(self, key: np.ndarray, first: np.ndarray) -> np.ndarray:
        new = np.diff(first) > 0
        for i in np.flatnonzero(new).tolist():
            k = int(key[i])
            if k in self.seen:
                new[i] = False
            else:
                self.seen.add(k)
        if len(self.seen) > 500_000:  # forgetting only repeats work
            self.seen.clear()
        return new


def sketches(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """Parity of each set's elements in 2^k cells, as many as it has elements or up to twice that, 64 at least."""
    size = np.diff(first)
    cells = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(cells)])
    doc = np.repeat(np.arange(len(size)), size)
    cell = ((h * _ODD) >> np.uint64(30)).astype(np.int64) & (cells[doc] - 1)
    bits = np.packbits((np.bincount(begin[doc] + cell, minlength=begin[-1]) & 1).astype(bool), bitorder="little")
    return [bits[a // 8 : b // 8].tobytes() if n else None for n, a, b in zip(size.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def apart(a: bytes, b: bytes) -> int:
    """Cells in which two sketches differ; a larger one is folded, which keeps parities."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def parities(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The same in 64 * WORDS cells whatever the size: a list of columns of 64-bit numbers."""
    size = np.diff(first)
    cells = 64 * WORDS
    doc = np.repeat(np.arange(len(size)), size)
    cell = ((h * _ODD) >> np.uint64(30)).astype(np.int64) & (cells - 1)
    bits = (np.bincount(doc * cells + cell, minlength=len(size) * cells) & 1).astype(bool)
    words = np.packbits(bits, bitorder="little").view(np.int64).reshape(len(size), WORDS)
    return list(words.T)


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The `pairs` (a, b) that sizes and sketches leave possible; `nodes`: node, n_shingles, sketch, each once."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            cells = np.array([apart(a.as_py(), b.as_py()) for a, b in zip(batch.column(3), batch.column(5), strict=True)], np.int64)
            # elements they may differ in: sizes and differences are whole
            most = differing(na, nb, percent)
            ok = (cells <= most) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield C.batch_of(kind, a=batch.column(0).filter(pa.array(ok)), b=batch.column(1).filter(pa.array(ok)))

    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return rows.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- signatures


def differing(a, b, percent: int):
    """Most elements in which linked sets of sizes a and b differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def band_of(low: int) -> tuple[int, int]:
    return low, max(low, int(low * RATIO))


def bands(largest: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= largest:
        out.append(band_of(low))
        low = out[-1][1] + 1
    return out


def _reached(n: float, k: int, p: float) -> float:
    """Bound on the chance that k or more of n independent events of chance p happen (Chernoff)."""
    if k <= n * p:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    q = k / n
    rest = (1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0
    return math.exp(-n * (q * math.log(q / p) + rest))


def allocate(low: int, high: int, sets: int, percent: int) -> tuple[int, bool] | None:
    """(segments, deletions) of least expected cost for the band; None if its sets link only when equal."""
    h = differing(high, high, percent)
    if not h:
        return None
    mean = math.sqrt(low * high)
    chance = min(1.0, sets * SHARED)

    def alone(load: float, j: int) -> float:  # a segment holds j elements, if any
        return load**j * math.exp(-load) / math.factorial(j) / (1 - math.exp(-load))

    m = -(-(h + 1) // 2)
    written = m + mean
    load = mean / m
    p = chance * (alone(load, 1) * m + 2 * alone(load, 2) * m) / written
    best = (written * (1 + p) + KEPT * mean * _reached(written, 1, p), m, True)
    for spare in SPARE:
        m = h + 1 + 2 + int(spare * h)
        load = mean / m
        written = m * (1 - math.exp(-load))
        p = chance * alone(load, 1)
        best = min(best, (written * (1 + p) + KEPT * mean * _reached(written, max(1, int(written) - h), p), m, False))
    return best[1:]


def emit(h: np.ndarray, first: np.ndarray, rows: np.ndarray, band: int, plan: tuple[int, bool], most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures for the band of the sets `rows`: signatures, index of each row's first, and how many shared ones a link needs.

    `most`: elements in which each may differ from a partner. The upper six bits
    of a signature are its band.
    """
    m, deletions = plan
    size = first[rows + 1] - first[rows]
    own = np.repeat(np.arange(len(rows)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) + first[rows][own]
    value = h[at]
    cell = own * m + ((value >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], C.mix(value[order] ^ np.uint64(0x5851F42D))
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    which = cell[begin]
    total = np.add.reduceat(value, begin) if len(begin) else np.zeros(0, np.uint64)
    spot = lambda c: (c % m).astype(np.uint64) + np.uint64(1)
    sign = lambda s, c: C.mix(s + spot(c) * _ODD) >> np.uint64(6) | np.uint64(band << 58)
    owner = which // m
    full = np.bincount(owner, minlength=len(rows))
    sig, of = [sign(total, which)], [owner]
    if deletions:
        fill = np.diff(np.append(begin, len(cell)))
        sig.append(sign(np.repeat(total, fill) - value, cell))
        of.append(cell // m)
        need = np.ones(len(rows), np.int64)
    else:
        need = np.maximum(1, full - most)
        # sets with no more filled segments than may be spoiled could have only empty ones in common with their like
        for r in np.flatnonzero(full <= most).tolist():
            c = r * m + np.setdiff1d(np.arange(m), which[owner == r] % m)
            sig.append(sign(np.full(len(c), 0x9E3779B9, np.uint64), c))
            of.append(np.full(len(c), r))
    sig, of = np.concatenate(sig), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return sig[order].view(np.int64), np.searchsorted(of[order], np.arange(len(rows) + 1)), need


def signed(docs: DataFrame, n: int, percent: int, total: int) -> DataFrame:
    """Rows `own` for every row of `docs` (doc_id, body, n_shingles, node; null node: the empty set), with the
    signatures for its band unless the task has seen the set; and further rows for larger bands that may hold partners."""
    names = ("own", "doc_id", "body", "n_shingles", "node", "band", "need", "sigs")
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    kind = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        edges: list[tuple[int, int]] = []
        plans: list = []
        for part, h, first, key, fresh in Sets(n).of(batches):
            size = np.diff(first)
            while len(size) and (not edges or edges[-1][1] * percent < size.max() * 100):
                edges.append(band_of(edges[-1][1] + 1 if edges else 1))
                plans.append(allocate(*edges[-1], total, percent))
            none = np.zeros(0, np.int64)
            done = np.zeros(len(size), bool)
            ids, body = part.column(0).cast(pa.int64()), part.column(1)

            def rows_of(own, at, band, need, sigs, begin):
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(sigs, pa.int64())) if band is not None else pa.nulls(len(at), kinds[-1])
                null = lambda v, t: pa.nulls(len(at), t) if v is None else pa.array(v, t)
                of = pa.array(at)
                return C.batch_of(kind, own=np.full(len(at), own), doc_id=ids.take(of), body=body.take(of), n_shingles=size[at], node=pa.array(key[at], pa.int64(), mask=size[at] == 0), band=null(None if band is None else np.full(len(at), band), kinds[5]), need=null(need, kinds[6]), sigs=lists)

            for band, ((low, high), plan) in enumerate(zip(edges, plans, strict=True)):
                if plan is None:
                    continue
                # a set also goes to larger bands that may hold a partner
                rows = np.flatnonzero(fresh & (size <= high) & (size * 100 >= low * percent))
                if not len(rows):
                    continue
                largest = np.minimum(high, size[rows] * 100 // percent)
                sigs, begin, need = emit(h, first, rows, band, plan, differing(size[rows], largest, percent))
                inside = size[rows] >= low
                for own in (True, False):
                    pick = np.flatnonzero(inside == own)
                    if len(pick):
                        width = np.diff(begin)[pick]
                        take = np.arange(int(width.sum())) - np.repeat(np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.repeat(begin[pick], width)
                        yield rows_of(own, rows[pick], band, need[pick], sigs[take], np.concatenate([[0], np.cumsum(width)]))
                done[rows[inside]] = True
            if not done.all():
                yield rows_of(True, np.flatnonzero(~done), None, None, none, none)

    columns = "own boolean, doc_id long, body long, n_shingles long, node long, band int, need int, sigs array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(run, columns)


def survivors(made: DataFrame) -> DataFrame:
    """(sig, node, band, keep): shared signatures of the sets that hold as many as a link needs.

    `keep`: of a set's shared signatures, rarest first, so many contain one that
    a linked set has in common among its own (those not shared come before).
    """
    entries = made.where("sigs is not null").select("node", F.explode("sigs").alias("sig"))
    shared = entries.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    shared = C.materialize(shared.select("sig"))
    C.release(made.sparkSession)
    # each side has a shuffle of its own, so a hot signature's partition can be split
    found = C.materialize(entries.join(shared, "sig"))
    found = C.replace(found, found.distinct().select("sig", "node", F.shiftrightunsigned("sig", 58).cast("int").alias("band")))
    C.drop(shared)
    held = found.groupBy("node", "band").agg(F.count("*").alias("held"))
    needs = made.where("sigs is not null").groupBy("node", "band").agg(F.max("need").alias("need"))
    alive = C.materialize(held.join(needs, ["node", "band"]).where("held >= need").select("node", "band", (F.col("held") - F.col("need") + 1).alias("keep")))
    return C.replace(found, found.join(alive, ["node", "band"]).select("sig", "node", "band", "keep"))


# ---------------------------------------------------------------- verification


def members(docs: DataFrame, made: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, n_shingles, elements, sketch, k0 ..) for each of `nodes`, made from one text each."""
    every = made.where("own and node is not null").groupBy("node").agg(F.min(F.struct("body", F.coalesce(F.col("doc_id"), F.lit(0)).alias("i"))).alias("m"))
    one = every.join(nodes, "node", "left_semi").select(F.col("m.body").alias("body"), F.col("m.i").alias("i"))
    one = C.materialize(one.distinct())
    texts = docs.select(F.xxhash64("text").alias("body"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), "text")
    marks = [f"k{i}" for i in range(WORDS)]
    kind = pa.schema([("node", pa.int64()), ("n_shingles", pa.int64()), ("elements", pa.binary()), ("sketch", pa.binary()), *[(k, pa.int64()) for k in marks]])
    # elements: the upper six bytes of each hash; two of a pair of sets coincide with a chance of 2^-48

    def run(batches):
        for _, h, first, key, fresh in Sets(n).of(batches):
            rows = np.flatnonzero(fresh)
            if len(rows):
                each = sketches(h, first)
                words = dict(zip(marks, (w[rows] for w in parities(h, first)), strict=True))
                elements = [h[first[i] : first[i + 1]].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for i in rows]
                yield C.batch_of(kind, node=key[rows], n_shingles=np.diff(first)[rows], elements=elements, sketch=[each[i] for i in rows], **words)

    columns = "node long, n_shingles long, elements binary, sketch binary, " + ", ".join(f"{k} long" for k in marks)
    got = N.join_small(texts, one, ["body", "i"], "left_semi").select("text").mapInArrow(run, columns)
    # rows alike in id and text may lie in several tasks
    return C.materialize(got.groupBy("node").agg(*[F.first(c).alias(c) for c in got.columns[1:]]))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`pairs` (a, b) with `linked`, stored."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def compare(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            linked = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                both = np.zeros((len(a[i].as_buffer()) + len(b[i].as_buffer())) // 6 * 8, np.uint8).reshape(-1, 8)
                both[:, 2:] = np.frombuffer(a[i].as_py() + b[i].as_py(), np.uint8).reshape(-1, 6)
                both = both.reshape(-1).view(np.uint64)
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * common >= percent * (len(both) - common)
            yield C.batch_of(out, a=batch.column(0), b=batch.column(1), linked=linked)

    left, right = sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return C.materialize(rows.mapInArrow(compare, "a long, b long, linked boolean"))


# ---------------------------------------------------------------- the join


def partner_sizes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, up_to), stored, of those of `sets` that may link within `sets`; up_to: the largest size a partner can have.

    A set has only those of its elements in common with a partner that some
    other of `sets` holds too, and the larger the partner, the more it takes.
    """
    kind = pa.schema([("node", pa.int64()), ("element", pa.int64())])

    def run(batches):
        for batch in batches:
            for node, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                wide = np.zeros((len(held.as_buffer()) // 6, 8), np.uint8)
                wide[:, 2:] = np.frombuffer(held.as_buffer(), np.uint8).reshape(-1, 6)
                yield C.batch_of(kind, node=np.full(len(wide), node), element=wide.reshape(-1).view(np.int64))

    own = sets.select("node", "elements").mapInArrow(run, "node long, element long")
    shared = own.groupBy("element").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    shared = C.materialize(shared.select("element"))
    held = own.join(shared, "element").groupBy("node").agg(F.count("*").alias("held"))
    up_to = F.least(F.expr(f"n * 100 div {percent}"), F.expr(f"held * {100 + percent} div {percent}") - F.col("n"))
    sizes = sets.select("node", F.col("n_shingles").alias("n")).join(held, "node").withColumn("up_to", up_to)
    sizes = C.materialize(sizes.where(F.col("up_to") * 100 >= F.col("n") * percent).select("node", "n", "up_to"))
    C.drop(shared)
    return sizes


def chosen_pairs(held: DataFrame, groups: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of different components that share a signature both have chosen, and may be linked by size and sketch."""
    order = Window.partitionBy("node", "band").orderBy("c", "sig")  # one set's signatures
    ranked = held.join(groups.select("sig", "c"), "sig").withColumn("nth", F.row_number().over(order))
    chosen = ranked.where("nth <= keep and c > 1").select("sig", "node").join(roots, "node", "left")
    chosen = C.materialize(chosen.select("sig", "node", F.coalesce("root", "node").alias("root")))
    by_root = chosen.groupBy("sig", "root").count().groupBy("sig").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("roots"))
    open_ = C.materialize(by_root.where("roots > 1").select("sig", F.col("m.root").alias("most")))
    marks = [f"k{i}" for i in range(WORDS)]
    rows = C.replace(chosen, chosen.join(open_, "sig"))
    sizes = partner_sizes(sets.join(rows.select("node").distinct(), "node", "left_semi"), percent)
    rows = C.replace(rows, rows.join(sizes, "node").join(sets.select("node", *marks), "node"))
    # of two components in a group one is not its largest: that one's sets come from the left
    left = rows.where("root <> most").select("sig", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "up_to", *marks)])
    right = rows.select("sig", "most", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "up_to", *marks)])
    cells = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in marks])
    may = (F.col("n_b") <= F.col("up_to_a")) & (F.col("n_a") <= F.col("up_to_b")) & (cells * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    met = left.join(right, (left["sig"] == right["sig"]) & (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("most")) | (F.col("node_a") < F.col("node_b"))) & may)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def rooted(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, body, n_shingles, root) for every row of `docs`, stored; root: the component, null for empty sets."""
    made = C.materialize(signed(docs, n, percent, docs.count()))
    held = survivors(made)
    groups = C.materialize(held.groupBy("sig").agg(F.count("*").alias("c"), F.max(F.struct("keep", "node"))["node"].alias("leader")).where("c > 1"))
    sets = members(docs, made, held.select("node").distinct(), n)
    none = docs.sparkSession.createDataFrame([], "a long, b long, linked boolean")
    tried, roots = none, none.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def look(tried, roots, pairs):
        if pairs.isEmpty():
            return tried, roots
        found = verify(pairs, sets, percent)
        tried = tried.union(found)
        return tried, roots if found.where("linked").isEmpty() else graph.components(tried.where("linked"))

    met = held.join(groups.select("sig", F.col("leader").alias("b")), "sig").where("node <> b").groupBy(F.col("node").alias("a"), "b").count()
    met = C.materialize(met)
    likely = C.materialize(alike(met, sets, percent))
    # the one it shares most with first; then others, where they could still join components
    best = likely.join(met, ["a", "b"]).groupBy("a").agg(F.max(F.struct("count", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    tried, roots = look(tried, roots, C.materialize(best))
    tried, roots = look(tried, roots, C.materialize(_across(likely, roots).join(tried.select("a", "b"), ["a", "b"], "left_anti")))
    C.drop(met)
    met = chosen_pairs(held, groups, roots, sets, percent)
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried, roots = look(tried, roots, C.materialize(alike(met.join(known, ["a", "b"], "left_anti"), sets, percent)))
    rows = made.where("own").select("doc_id", "body", "n_shingles", "node").join(roots, "node", "left")
    rows = C.materialize(rows.select("doc_id", "body", "n_shingles", F.coalesce("root", "node").alias("root")))
    C.drop(made, held, groups, sets)
    C.release(docs.sparkSession)
    return rows


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) whose nodes are in different components."""
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    got = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return got.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").distinct()


def component_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`."""
    rows = rooted(docs, n, percent)
    least = C.materialize(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, but one row of each component: that of the smallest id (null ids last, then by text).

    Rows without words stay. Of rows alike in id and text, one stays.
    """
    rows = rooted(docs, n, percent).where("root is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body"))
    stays = C.materialize(rows.groupBy("root").agg(first.alias("m"), F.count("*").alias("n")).where("n > 1"))
    same = rows["doc_id"].eqNullSafe(F.col("m.doc_id")) & (rows["body"] == F.col("m.body"))
    marked = C.materialize(rows.join(stays, "root").groupBy("doc_id", "body").agg(F.max(same).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("b"))
    at = lambda m: F.col("i").eqNullSafe(m["doc_id"]) & (F.col("b") == m["body"])
    rest = whole.join(marked, at(marked), "left_anti")
    again = marked.where("stays")
    once = whole.join(again, at(again), "left_semi").groupBy("i", "b").agg(F.first("row").alias("row"))
    return rest.select("row.*").unionByName(once.select("row.*"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_table(C.table(spark, sf_dir, "documents"), n=4, percent=85)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
sets AS (SELECT rid, n, md5(string_agg(g, chr(10) ORDER BY g)) AS s FROM g JOIN n USING (rid) GROUP BY rid, n),
rep AS (SELECT s, min(rid) AS rid, min(n) AS n FROM sets GROUP BY s),
rg AS (SELECT g.rid, g.g, hash(g.g) AS h FROM g JOIN rep USING (rid)),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM rg a JOIN rg b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN rep ra ON ra.rid = a JOIN rep rb ON rb.rid = b WHERE 100 * i >= 85 * (ra.n + rb.n - i)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT rid, rid FROM rep UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS (SELECT a AS rid, min(b) AS root FROM reach GROUP BY a),
named AS (SELECT w.rid, w.doc_id, coalesce(sets.n, 0) AS n, comp.root
          FROM w LEFT JOIN sets ON sets.rid = w.rid LEFT JOIN rep ON rep.s = sets.s LEFT JOIN comp ON comp.rid = rep.rid)
SELECT doc_id, n AS n_shingles, coalesce(CASE WHEN root IS NOT NULL THEN min(doc_id) OVER (PARTITION BY root) END, doc_id) AS component_id
FROM named
"""
