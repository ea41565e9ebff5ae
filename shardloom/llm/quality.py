"""Quality classifier: supervised subword embeddings.

Hashed vectors of words, adjacent word pairs and character 3- and 4-grams are
averaged per document; a softmax over the average gives the class. Vectors and
softmax are learned together by numpy stochastic gradient descent on a bounded
sample (`per_class`). As the softmax is linear, scoring needs one number a
bucket: the product of its vector with the softmax weights.

Defined results: null and empty texts have no features and score the bias
alone; a repeated row scores the same each time; a null id is scored but never
learned from; without a labelled row of both classes all scores are the share
of label 1 (0.5 without any). Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS = 18
_MUL3, _MUL4 = np.uint32(2654435761), np.uint32(2246822519)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, index of each document's first) for words, word pairs and both n-gram lengths."""
    start, end, first = C.words(data, offsets, C.NOT_SPACE)
    hashes = C.Hashes(data)
    word = hashes.of(start, end)
    out = [((word >> np.uint64(64 - BITS)).astype(np.int64), first)]
    if len(word):
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        same = np.flatnonzero(doc[1:] == doc[:-1])
        # a word that repeats the one before is its own kind of pair, whatever the word
        pair = np.where(word[same] == word[same + 1], np.uint64(0x1234567), C.mix(word[same] * np.uint64(31) + word[same + 1]))
        out.append(((pair >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(doc[same], np.arange(len(offsets)))))
    n = len(data)
    code = data.astype(np.uint32)
    space = np.zeros(n + 1, np.int32)
    np.cumsum(~C.NOT_SPACE[data], out=space[1:])
    nth = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for k, mul in ((3, _MUL3), (4, _MUL4)):
        if n < k:
            continue
        gram = code[: n - k + 1].copy()
        for j in range(1, k):
            gram |= code[j : n - k + 1 + j] << np.uint32(8 * j)
        inner = (space[k - 1 : n] == space[1 : n - k + 2]) & (nth[k - 1 :] == nth[: n - k + 1])
        at = np.flatnonzero(inner)
        gram = gram[at] * mul
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x85EBCA6B)
        out.append(((gram >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(at, offsets)))
    return out


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for bucket, first in features(data, offsets):
            sums = np.zeros(len(bucket) + 1)
            np.cumsum(self.weight[bucket], out=sums[1:])
            total += np.diff(sums[first])
            n += np.diff(first)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def train(texts: tuple[np.ndarray, np.ndarray], y: np.ndarray, dim: int = 8, epochs: int = 4, rate: float = 30.0, seed: int = 5) -> Model:
    data, offsets = texts
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) == 0 else np.clip(y.mean(), 0.01, 0.99)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    docs = []
    for i in range(len(y)):
        own = data[offsets[i] : offsets[i + 1]]
        bucket = np.concatenate([b for b, _ in features(own, np.array([0, len(own)]))])
        which, count = np.unique(bucket, return_counts=True)
        docs.append((which.astype(np.int32), (count / max(1, len(bucket))).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vec = rng.normal(0, 0.05, (1 << BITS, dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    balance = np.array([0.5 / (1 - y.mean()), 0.5 / y.mean()])
    steps = epochs * len(docs)
    for step, i in enumerate(np.concatenate([rng.permutation(len(docs)) for _ in range(epochs)])):
        which, share = docs[i]
        lr = 1 - step / steps
        v = vec[which]
        h = share @ v
        z = h @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        g = p
        g[y[i]] -= 1
        g *= balance[y[i]]
        vec[which] = v - (rate * lr) * share[:, None] * (out @ g)[None, :]
        out -= 0.2 * lr * np.outer(h, g)
        bias -= 0.02 * lr * g
    return Model((vec @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int = 3, remainder: int = 1) -> Model:
    """Learn `label` from at most about 2.5 * `per_class` rows outside the held-out fold."""
    got = C.labelled_sample(docs, labels, label, per_class, modulus, remainder)
    return train(C.texts_of(got), np.array([r["_y"] for r in got], np.int64))


def apply(docs: DataFrame, model: Model, threshold: float = 0.5, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`, over whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    rows = docs.select("doc_id", C.held_out("doc_id", modulus, remainder).alias("held_out"), "text")
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            for part, data, offsets in C.chunks(batch):
                yield C.batch_of(kind, doc_id=part.column(0).cast(pa.int64()), held_out=part.column(1), score=own.score(data, offsets))

    got = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that score at least `threshold`."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    at = docs.columns.index("text")

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            for part, data, offsets in C.chunks(batch, batch.schema.field(at).name):
                yield part.filter(pa.array(own.score(data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, C.table(spark, sf_dir, "labels"), "quality", per_class=2000))
