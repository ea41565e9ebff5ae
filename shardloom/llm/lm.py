"""LM scoring: a log-bilinear model trained with noise-contrastive estimation.

One pass over the learning texts counts words. Every word seen sqrt(N) / `ROOT`
times or more (N: all learning tokens; `FLOOR` times at least) gets a target
vector and a context vector; so both vocabularies grow with the corpus, by about
its root, as what each task must hold of them does. Rarer words are one class as
targets and one as contexts.

    s(u | a, b) = (C1 q[a] + C2 q[b]) . r[u] + bias[u]

A normaliser over all words would cost their number for each token, so targets
are found in two steps: first among the `HEAD` commonest words, the class of
rare words and blocks of all other words; then among the words of the block.
Both are log-bilinear with the same contexts and normalised exactly, at about
twice the square root of the vocabulary.

The model is fitted on all learning texts, whose every token is a target (in
small corpora several times, up to `DRAWS`): Spark's tasks take a part of the
texts each, and their changes are averaged by how often each row changed, in
groups of tasks first, in three rounds over a sixteenth, three and twelve
sixteenths of the texts, so that each text is in one of them. Noise words come
from the full unigram distribution of the step. Results depend on how the rows
are dealt to tasks, as training does.

Within the class of rare words a word has (c + 1) / (N' + V' + 1), N' and V'
being that class's tokens and distinct words; so the model's probabilities sum
to 1 over the known words and one unknown event, as those of the base score do.

Words are carried as 64-bit hashes; two different words share one with a chance
below V^2 / 2^65.

Defined results: a null text is empty and consists of the end token; a null id
is scored but never learned from; identical rows get identical rows back; with
nothing to learn from every token has log-probability 0 under the base. Other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Times a word must be seen to get vectors of its own: FLOOR, or the root of all tokens over ROOT if that is more.
FLOOR, ROOT = 16, 40
#: Words told in the first step; four times as many are still told in one.
HEAD = 128
DIM = 16
#: Tokens trained on at once, and noise words they share in the first and second step.
BATCH, NOISE, BLOCK_NOISE = 2048, 64, 16
#: Tokens a task gathers before it trains on them, so that blocks have many each.
TOKENS = 1_000_000
#: Rows of the table whose changes travel together, and tasks or groups of them whose changes are summed at once.
PART, TOGETHER = 4096, 64
#: Tokens a small corpus is repeated up to, and the most repetitions.
DRAWS, REPEATS = 1_536_000, 300
#: Sixteenths of the texts, by a hash of their ids, that each round takes.
ROUNDS = ((0, 1), (1, 4), (4, 16))
#: Words whose counts are sent to every worker; the counts of all others are joined.
COMMON = 1 << 18
#: The end token's key.
END = np.uint64(0x5BD1E9955BD1E995)


def keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each text's end included, and the index of each text's first (n + 1 entries)."""
    low = C.LOWER[data]
    start, end, first = C.words(low, offsets, C.NOT_SPACE)
    word = C.Hashes(low).of(start, end)
    out = np.full(len(word) + len(offsets) - 1, END)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out[np.arange(len(word)) + doc] = word
    return out, first + np.arange(len(offsets))


def count_words(texts: DataFrame) -> DataFrame:
    """(key, c) over all rows of `texts`: counted in each task, then summed."""
    kind = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def merged():
            which, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return which, np.bincount(at, np.concatenate([h[1] for h in held])).astype(np.int64)

        for batch in batches:
            for _, data, offsets in C.chunks(batch):
                held.append(np.unique(keys(data, offsets)[0], return_counts=True))
                rows += len(held[-1][0])
                if rows > 3_000_000:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows > 2_000_000:
                        yield C.batch_of(kind, key=held[0][0].view(np.int64), n=held[0][1])
                        held, rows = [], 0
        if held:
            which, n = merged()
            for i in range(0, len(which), 100_000):
                yield C.batch_of(kind, key=which[i : i + 100_000].view(np.int64), n=n[i : i + 100_000])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))


def ids(word: np.ndarray, sorted_keys: np.ndarray, order: np.ndarray, other: int) -> np.ndarray:
    """Rank of each key in a list given in sorted order; `other` if it isn't there."""
    if not len(sorted_keys):
        return np.full(len(word), other)
    at = np.minimum(np.searchsorted(sorted_keys, word), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == word, order[at], other)


def contexts(target: np.ndarray, first: np.ndarray, n_short: int) -> tuple[np.ndarray, np.ndarray]:
    """Context classes one and two tokens back: a word's rank, `n_short` for rare ones, `n_short` + 1 before the beginning."""
    one = np.concatenate([[n_short + 1], target[:-1]])[: len(target)]
    two = np.concatenate([[n_short + 1, n_short + 1], target[:-2]])[: len(target)]
    begin = first[:-1]
    one[begin] = n_short + 1
    two[begin] = n_short + 1
    second = begin + 1
    second = second[second < first[1:]]
    two[second] = n_short + 1
    return one, two


class Layout:
    """Rows of the one table that holds all parameters, for `words` words with vectors.

    First come the units of the first step (commonest words, the class of rare
    words, blocks), then all other words in blocks, contexts, and C1 and C2.
    """

    def __init__(self, words: int):
        self.words = words
        self.head = words if words <= 4 * HEAD else HEAD
        self.block = max(1, math.isqrt(words - self.head))
        self.blocks = -(-(words - self.head) // self.block)
        self.first = self.head + 1 + self.blocks
        self.context = self.first + words - self.head
        self.c1 = self.context + words + 2
        self.c2 = self.c1 + DIM
        self.rows = self.c2 + DIM

    def units(self, target: np.ndarray) -> np.ndarray:
        """The unit of the first step for each target."""
        tail = self.head + 1 + (target - self.head) // self.block
        return np.where(target < self.head, target, np.where(target == self.words, self.head, tail))

    def by_block(self, unit: np.ndarray):
        """(positions, first row, end row) for each block that occurs in `unit`."""
        tail = np.flatnonzero(unit > self.head)
        tail = tail[np.argsort(unit[tail], kind="stable")]
        which, at = np.unique(unit[tail], return_index=True)
        for k, lo, hi in zip((which - self.head - 1).tolist(), at.tolist(), np.append(at, len(tail))[1:].tolist(), strict=True):
            yield tail[lo:hi], self.first + k * self.block, min(self.first + (k + 1) * self.block, self.context)


@dataclass
class Model:
    short: np.ndarray  # keys of the words with vectors, commonest first
    table: np.ndarray  # Layout's rows; a vector, a bias and accumulated squares: float32
    tokens: int
    distinct: int
    rest_tokens: int
    rest_distinct: int

    def log_probabilities(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logs for each target (len(short): the class of rare words) after its contexts."""
        own = Layout(len(self.short))
        r = self.table[: own.context, : DIM + 1]  # the bias is one more component, which is 1 in contexts
        q = self.table[own.context : own.c1, :DIM]
        left, right = q @ self.table[own.c1 : own.c2, :DIM], q @ self.table[own.c2 :, :DIM]
        pair, at = np.unique(one * np.int64(own.words + 2) + two, return_inverse=True)
        h = np.ones((len(pair), DIM + 1), np.float32)
        h[:, :DIM] = left[pair // (own.words + 2)] + right[pair % (own.words + 2)]
        norm = np.empty(len(h), np.float32)
        for i in range(0, len(h), 512):
            norm[i : i + 512] = log_sum(h[i : i + 512], r[: own.first])
        unit = own.units(target)
        h = h[at]
        out = np.einsum("ij,ij->i", h, r[unit]) - norm[at]
        for rows, lo, hi in own.by_block(unit):
            for i in range(0, len(rows), 1024):
                some = rows[i : i + 1024]
                word = r[own.first + target[some] - own.head]
                out[some] += np.einsum("ij,ij->i", h[some], word) - log_sum(h[some], r[lo:hi])
        return out

    @property
    def logp(self) -> np.ndarray:
        """All contexts one, contexts two and targets; for small vocabularies."""
        n = len(self.short)
        one, two, target = (x.ravel() for x in np.indices((n + 2, n + 2, n + 1)))
        return self.log_probabilities(target, one, two).reshape(n + 2, n + 2, n + 1)


def log_sum(h: np.ndarray, r: np.ndarray) -> np.ndarray:
    """log of the sum of exp(h . r) over all rows of `r`, for each row of `h`."""
    z = h @ r.T
    if np.linalg.norm(h, axis=1).max() * np.linalg.norm(r, axis=1).max() < 60:  # no exponential can overflow or vanish
        return np.log(np.exp(z, out=z) @ np.ones(len(r), np.float32))
    top = z.max(1, keepdims=True)
    return np.log(np.exp(z - top).sum(1)) + top[:, 0]


def beginning(c: np.ndarray, rest: int, seed: int = 9) -> np.ndarray:
    """The table before training: small vectors, and the biases of the unigram model."""
    own = Layout(len(c))
    rng = np.random.default_rng(seed)
    table = np.zeros((own.rows, DIM + 2), np.float32)
    table[: own.c1, :DIM] = rng.normal(0, 0.1, (own.c1, DIM))
    table[own.c1 : own.c2, :DIM] = np.eye(DIM) + rng.normal(0, 0.05, (DIM, DIM))
    table[own.c2 :, :DIM] = 0.5 * np.eye(DIM) + rng.normal(0, 0.05, (DIM, DIM))
    starts = np.arange(own.head, own.words, own.block)
    sums = np.add.reduceat(c, starts) if len(starts) else np.zeros(0)
    first = np.concatenate([c[: own.head], [rest + 0.5], sums])
    table[: own.first, DIM] = np.log(first / first.sum())
    if len(starts):
        table[own.first : own.context, DIM] = np.log(c[own.head :] / np.repeat(sums, np.diff(np.append(starts, own.words))))
    table[:, DIM + 1] = 1e-4
    return table


class Trainer:
    """Stochastic steps on one task's own copy of the table."""

    def __init__(self, table: np.ndarray, unigram: np.ndarray, words: int, rng: np.random.Generator, rate: float):
        self.own, self.table, self.unigram, self.rng, self.rate = Layout(words), table.copy(), unigram, rng, rate
        self.touched = np.zeros(len(table), np.int64)
        self.cum = np.cumsum(np.exp(unigram[: self.own.first].astype(np.float64)))

    def change(self, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        self.move(rows[at], np.add.reduceat(grad[order], at, axis=0))

    def move(self, rows, g: np.ndarray) -> None:
        """`change` for rows that are all different."""
        t = self.table[rows]
        t[:, DIM + 1] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        t[:, : g.shape[1]] -= g * (self.rate / np.sqrt(t[:, DIM + 1]))[:, None]
        self.table[rows] = t
        self.touched[rows] += 1

    def step(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray) -> None:
        own, t = self.own, self.table
        a, b = own.context + one, own.context + two
        qa, qb, rw, rn = t[a, :DIM], t[b, :DIM], t[unit, :DIM], t[noise, :DIM]
        c1, c2 = t[own.c1 : own.c2, :DIM], t[own.c2 :, :DIM]
        h = qa @ c1 + qb @ c2
        k = np.float32(math.log(len(noise)))
        d = np.einsum("ij,ij->i", h, rw) + t[unit, DIM] - self.unigram[unit] - k
        dn = h @ rn.T + (t[noise, DIM] - self.unigram[noise] - k)
        g = 1 / (1 + np.exp(-np.clip(d, -30, 30))) - 1
        with np.errstate(over="ignore"):  # 1 / infinity is the 0 it should be
            gn = np.exp(np.negative(dn, out=dn), out=dn)
        gn += 1
        np.reciprocal(gn, out=gn)
        gh = g[:, None] * rw + gn @ rn
        last = np.concatenate([qa.T @ gh, qb.T @ gh])
        target = np.concatenate([np.column_stack([g[:, None] * h, g]), np.column_stack([gn.T @ h, gn.sum(0)])])
        context = np.concatenate([gh @ c1.T, gh @ c2.T])
        self.change(np.concatenate([unit, noise]), target)
        self.change(np.concatenate([a, b]), context)
        self.move(slice(own.c1, own.rows), last)

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One pass over the given tokens."""
        own = self.own
        order = self.rng.permutation(len(target))
        target, one, two = target[order], one[order], two[order]
        unit = own.units(target)
        for i in range(0, len(unit), BATCH):
            j = slice(i, i + BATCH)
            noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), own.first - 1)
            self.step(unit[j], one[j], two[j], noise)
        for rows, lo, hi in own.by_block(unit):
            cum = np.cumsum(np.exp(self.unigram[lo:hi].astype(np.float64)))
            for i in range(0, len(rows), BATCH):
                some = rows[i : i + BATCH]
                noise = lo + np.minimum(np.searchsorted(cum, self.rng.random(BLOCK_NOISE)), hi - lo - 1)
                self.step(own.first + target[some] - own.head, one[some], two[some], noise)


def changes(texts: DataFrame, short: np.ndarray, table: np.ndarray, unigram: np.ndarray, repeats: int, turn: int) -> DataFrame:
    """(part, rows, sums): the rows of the table that change in any task, packed, with weights and weighted sums of their changes.

    Tasks pack their changes by part of the table, since a number a column takes
    several times the space; vectors and biases leave them in half precision.
    """
    sent = texts.sparkSession.sparkContext.broadcast((short, table, unigram))
    kind = pa.schema([("part", pa.int32()), ("task", pa.int32()), ("rows", pa.binary()), ("n", pa.binary()), ("moved", pa.binary()), ("squares", pa.binary())])

    def run(batches):
        own, start, uni = sent.value
        order = np.argsort(own)
        sorted_keys = own[order]
        task = TaskContext.get().partitionId()
        rng = np.random.default_rng([turn, task])
        trainer = Trainer(start, uni, len(own), rng, 0.05 / (1 + turn))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def learn():
            for _ in range(repeats if held else 0):
                trainer.learn(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()

        for batch in batches:
            for _, data, offsets in C.chunks(batch):
                word, first = keys(data, offsets)
                target = ids(word, sorted_keys, order, len(own))
                held.append((target, *contexts(target, first, len(own))))
                if sum(len(h[0]) for h in held) > TOKENS:
                    learn()
        learn()
        row = np.flatnonzero(trainer.touched)
        for some in np.split(row, np.flatnonzero(np.diff(row // PART)) + 1) if len(row) else ():
            d = trainer.table[some] - start[some]
            yield C.batch_of(kind, part=[int(some[0]) // PART], task=[task], rows=[(some % PART).astype(np.uint16).tobytes()], n=[trainer.touched[some].astype(np.float32).tobytes()], moved=[d[:, : DIM + 1].astype(np.float16).tobytes()], squares=[d[:, DIM + 1].tobytes()])

    def total(rows: pa.Table) -> pa.Table:
        sums = np.zeros((PART, DIM + 3))
        for r in rows.to_pylist():
            at = np.frombuffer(r["rows"], np.uint16)
            if "sums" in r:
                sums[at] += np.frombuffer(r["sums"], np.float32).reshape(-1, DIM + 3)
                continue
            c = np.frombuffer(r["n"], np.float32)
            sums[at, 0] += c
            sums[at, 1:-1] += c[:, None] * np.frombuffer(r["moved"], np.float16).reshape(-1, DIM + 1)
            sums[at, -1] += c * np.frombuffer(r["squares"], np.float32)
        at = np.flatnonzero(sums[:, 0])
        return pa.table({"part": rows["part"][:1], "task": pa.array([rows["task"][0].as_py() // TOGETHER], pa.int32()), "rows": [at.astype(np.uint16).tobytes()], "sums": [sums[at].astype(np.float32).tobytes()]})

    got = texts.select("text").mapInArrow(run, "part int, task int, rows binary, n binary, moved binary, squares binary")
    left = texts.rdd.getNumPartitions()
    while True:  # each step leaves a row for TOGETHER tasks
        got = got.groupBy("part", F.expr(f"task div {TOGETHER}")).applyInArrow(total, "part int, task int, rows binary, sums binary")
        left = -(-left // TOGETHER)
        if left <= 1:
            return got


def fit(texts: DataFrame, counts: DataFrame, floor: int = FLOOR, root: int = ROOT) -> Model:
    """`counts`: what count_words gives for `texts`, stored."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = int(total["n"] or 0), int(total["v"])
    top = counts.where(F.col("c") >= max(floor, math.isqrt(tokens) // root)).toArrow()
    key, c = top["key"].to_numpy(), top["c"].to_numpy().astype(np.int64)
    order = np.lexsort((key, -c))
    short, c = np.ascontiguousarray(key[order]).view(np.uint64), c[order]
    rest = tokens - int(c.sum())
    table = beginning(c.astype(float), rest)
    unigram = table[: Layout(len(short)).context, DIM].copy()
    repeats = min(REPEATS, max(1, -(-DRAWS // max(1, tokens))))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    for turn, (lo, hi) in enumerate(ROUNDS if tokens else ()):
        for r in changes(texts.where((share >= lo) & (share < hi)), short, table, unigram, repeats, turn).collect():
            sums = np.frombuffer(r["sums"], np.float32).reshape(-1, DIM + 3)
            table[r["part"] * PART + np.frombuffer(r["rows"], np.uint16).astype(np.int64)] += sums[:, 1:] / sums[:, :1]
        C.release(texts.sparkSession)
    return Model(short, table, tokens, distinct, rest, distinct - len(short))


def score(docs: DataFrame, model: Model, counts: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of `docs`."""
    spark = docs.sparkSession
    top = counts.orderBy(F.desc("c"), "key").limit(COMMON).toArrow()
    order = np.argsort(known := top["key"].to_numpy().view(np.uint64))
    sent = spark.sparkContext.broadcast((model, known[order], top["c"].to_numpy()[order]))
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("body", pa.int64()), ("key", pa.int64()), ("tf", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("lbl", pa.float64())])

    def run(batches):
        model, table, c = sent.value
        n_short = len(model.short)
        rank = np.argsort(model.short)
        short = model.short[rank]
        for batch in batches:
            for part, data, offsets in C.chunks(batch):
                word, first = keys(data, offsets)
                which, at = np.unique(word, return_inverse=True)
                target = ids(which, short, rank, n_short)[at]
                c_of = ids(which, table, c, 0)
                one, two = contexts(target, first, n_short)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                rest_log = np.log10(c_of + 1.0)[at]
                lbl = model.log_probabilities(target, one, two) / np.log(10) + np.where(target == n_short, rest_log, 0.0) if model.tokens else np.zeros(len(word))
                known_of = (c_of > 0)[at]

                def total(v, cuts=first):
                    s = np.zeros(len(v) + 1)
                    np.cumsum(v, out=s[1:])
                    return np.diff(s[cuts])

                size = len(part)
                rest = total(target == n_short)
                lbl_total = total(lbl) - rest * np.log10(model.rest_tokens + model.rest_distinct + 1)
                body = part.column(2).to_numpy()
                # words beyond the table: once a text, with their number
                far = np.flatnonzero(~known_of)
                pair, tf = np.unique(doc[far] * np.int64(len(which)) + at[far], return_counts=True)
                d, w = pair // max(1, len(which)), pair % max(1, len(which))
                zero, none = np.zeros(len(d), np.int64), np.zeros(len(d))
                ids_of, held = part.column(0).cast(pa.int64()), part.column(1)
                # each row's own part travels under a key of its own, so these rows spread evenly, those of copies too
                far_from = C.mix(body.view(np.uint64) + C.mix(pc.fill_null(ids_of, 0).to_numpy().view(np.uint64) + np.uint64(77))).view(np.int64)
                yield C.batch_of(kind, doc_id=ids_of, held_out=held, body=body, key=far_from, tf=np.zeros(size, np.int64), copies=np.ones(size, np.int64), n_tokens=np.diff(first), known=total(known_of).astype(np.int64), logs=total(rest_log), lbl=lbl_total)
                if len(d) and model.distinct > len(table):
                    yield C.batch_of(kind, doc_id=ids_of.take(pa.array(d)), held_out=held.take(pa.array(d)), body=body[d], key=which[w].view(np.int64), tf=tf, copies=zero, n_tokens=zero, known=zero, logs=none, lbl=none)

    rows = docs.select("doc_id", C.held_out("doc_id", modulus, remainder).alias("held_out"), F.xxhash64("text").alias("body"), "text")
    rows = rows.mapInArrow(run, "doc_id long, held_out boolean, body long, key long, tf long, copies long, n_tokens long, known long, logs double, lbl double")
    if model.distinct > COMMON:
        rows = rows.join(counts, "key", "left")
    else:
        rows = rows.withColumn("c", F.lit(None).cast("long"))
    far = F.coalesce(F.when(F.col("tf") > 0, F.col("c")), F.lit(0))
    far_log = F.col("tf") * F.log10(far + F.lit(1.0))
    sums = rows.groupBy("doc_id", "held_out", "body").agg(
        F.sum("copies").alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("known").alias("known"),
        F.sum(F.when(far > 0, F.col("tf")).otherwise(0)).alias("far_known"),
        F.sum("logs").alias("logs"),
        F.sum("lbl").alias("lbl"),
        F.sum(far_log).alias("far_log"),
    )
    n = F.col("copies")
    base = F.log10(F.lit(float(model.tokens + model.distinct + 1)))
    return sums.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.expr("far_known div copies")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        ((F.col("logs") + F.col("far_log")) / n - F.col("n_tokens") * base).alias("base_score"),
        ((F.col("lbl") + F.col("far_log")) / n).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    texts = docs.where(C.learnable("doc_id", 7, 2))
    counts = C.materialize(count_words(texts))
    return score(docs, fit(texts, counts), counts)
