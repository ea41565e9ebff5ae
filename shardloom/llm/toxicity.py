"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels mark whole documents, so token labels come first: a word (or its
`PREFIX`-byte beginning) is taken as toxic where it stands in toxic learning
documents and hardly ever in others. The CRF (two tags; features: the word, its
beginning, its ending, and the neighbours' words, all hashed; one transition
table) is trained on these tagged token sequences by gradient ascent on the
likelihood. Forward-backward marginals over the whole text give spans, and a
logistic of the largest marginal and the expected number of toxic tokens,
fitted on the document labels, gives the score.

The recursions run as Moebius maps over blocks of tokens, so that one long text
costs no more steps than many short ones, and documents need no padding.

Defined results: a text without words has no spans and scores the learned base
rate, as a null text does; a null id is scored, never learned from; without
documents of both labels the share of label 1 is returned (0.5 without any).
Offsets are byte offsets in the text's UTF-8 form. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS = 16
PREFIX = 5
SUFFIX = 3
BLOCK = 256


def mobius_scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[t] = (a r[t-1] + b) / (c r[t-1] + d) for all t, from r[-1] = 1."""
    n = len(a)
    if not n:
        return np.zeros(0)
    rows = -(-n // BLOCK)
    shape = []
    for v, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)):
        w = np.full(rows * BLOCK, fill)
        w[:n] = v
        shape.append(np.ascontiguousarray(w.reshape(rows, BLOCK).T))
    a, b, c, d = shape
    p, q, s, t = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for i in range(BLOCK):
        p, q, s, t = a[i] * p + b[i] * s, a[i] * q + b[i] * t, c[i] * p + d[i] * s, c[i] * q + d[i] * t
        if i % 8 == 7:
            top = np.maximum(np.maximum(np.abs(p), np.abs(q)), np.maximum(np.abs(s), np.abs(t)))
            p, q, s, t = p / top, q / top, s / top, t / top
    r = np.empty(rows)
    x = 1.0
    for i in range(rows):
        r[i] = x
        x = (p[i] * x + q[i]) / (s[i] * x + t[i])
    out = np.empty((BLOCK, rows))
    for i in range(BLOCK):
        r = (a[i] * r + b[i]) / (c[i] * r + d[i])
        out[i] = r
    return out.T.reshape(-1)[:n]


def tokens(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    low = C.LOWER[data]
    start, end, first = C.words(low, offsets, C.ALNUM)
    hashes = C.Hashes(low)
    word = hashes.of(start, end)
    head = hashes.of(start, np.minimum(end, start + PREFIX))
    tail = hashes.of(np.maximum(start, end - SUFFIX), end)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return {"start": start, "end": end, "first": first, "word": word, "head": head, "tail": tail, "doc": doc}


def buckets(tok: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of features: word, beginning, ending, word before, word after; each kind in its own range."""
    word = tok["word"]
    before, after = np.zeros_like(word), np.zeros_like(word)
    if len(word):
        same = tok["doc"][1:] == tok["doc"][:-1]
        before[1:][same] = word[:-1][same]
        after[:-1][same] = word[1:][same]
    kinds = (word, tok["head"], tok["tail"], C.mix(before + np.uint64(1)), C.mix(after + np.uint64(2)))
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS) for k, h in enumerate(kinds)])


@dataclass
class Model:
    weight: np.ndarray  # 5 << BITS: log odds of the toxic tag
    bias: float
    trans: np.ndarray  # 2, 2: log potentials
    doc: np.ndarray  # intercept, log-odds of the largest marginal, log1p of the expected count

    def odds(self, tok: dict[str, np.ndarray], feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward ratio, backward ratio and emission ratio of the toxic to the clean tag."""
        g = np.exp(np.clip(self.bias + sum(self.weight[f] for f in feats), -30, 30)) if feats.size else np.zeros(0)
        e = np.exp(self.trans)
        starts, ends = np.zeros(len(g), bool), np.zeros(len(g), bool)
        full = np.flatnonzero(np.diff(tok["first"]))
        starts[tok["first"][:-1][full]] = True
        ends[tok["first"][1:][full] - 1] = True
        fwd = mobius_scan(np.where(starts, 0, g * e[1, 1]), np.where(starts, g, g * e[0, 1]), np.where(starts, 0, e[1, 0]), np.where(starts, 1, e[0, 0]))
        nxt = np.append(g[1:], 1.0)[: len(g)]
        back = mobius_scan(*(v[::-1] for v in (np.where(ends, 0, e[1, 1] * nxt), np.where(ends, 1, e[1, 0]), np.where(ends, 0, e[0, 1] * nxt), np.where(ends, 1, e[0, 0]))))[::-1]
        return fwd, back, g

    def marginals(self, tok: dict[str, np.ndarray]) -> np.ndarray:
        fwd, back, _ = self.odds(tok, buckets(tok))
        x = fwd * back
        return x / (1 + x)

    def features(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(np.diff(first))
        most, total = np.full(len(first) - 1, 1e-6), np.zeros(len(first) - 1)
        if len(full):
            most[full] = np.clip(np.maximum.reduceat(p, first[:-1][full]), 1e-6, 1 - 1e-6)
            total[full] = np.add.reduceat(np.where(p > 0.05, p, 0), first[:-1][full])
        return np.stack([np.ones(len(most)), np.log(most / (1 - most)), np.log1p(total)], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        tok = tokens(data, offsets)
        p = self.marginals(tok)
        score = 1 / (1 + np.exp(-np.clip(self.features(p, tok["first"]) @ self.doc, -30, 30)))
        spans: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        last = (-1, -1)
        for t in np.flatnonzero(p >= 0.5).tolist():
            d = int(tok["doc"][t])
            start, end = int(tok["start"][t] - offsets[d]), int(tok["end"][t] - offsets[d])
            if last == (d, t - 1):
                spans[d][-1]["end"] = end
                spans[d][-1]["p"] = max(spans[d][-1]["p"], float(p[t]))
            else:
                spans[d].append({"start": start, "end": end, "p": float(p[t])})
            last = (d, t)
        return score, spans


def weak_tags(tok: dict[str, np.ndarray], y: np.ndarray, least: int = 3, ratio: float = 20.0) -> np.ndarray:
    """Token labels from document labels."""
    toxic = y[tok["doc"]] == 1 if len(tok["doc"]) else np.zeros(0, bool)
    tag = np.zeros(len(toxic), bool)
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    for kind in ("word", "head"):
        which, at = np.unique(tok[kind], return_inverse=True)
        pairs = np.unique(at * np.int64(len(y)) + tok["doc"])
        df1 = np.bincount(pairs // len(y), weights=y[pairs % len(y)] == 1, minlength=len(which))
        df0 = np.bincount(pairs // len(y), weights=y[pairs % len(y)] == 0, minlength=len(which))
        marked = (df1 >= least + 0.002 * n1) & (df1 / n1 >= ratio * (df0 + 0.5) / n0)
        tag |= marked[at] & toxic
    return tag


def train(texts: tuple[np.ndarray, np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.3, seed: int = 3) -> Model:
    model = Model(np.zeros(5 << BITS), -4.0, np.zeros((2, 2)), np.zeros(3))
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 0.01, 0.99))
        model.doc[0] = np.log(p / (1 - p))
        return model
    data, offsets = texts
    tok = tokens(data, offsets)
    tag = weak_tags(tok, y)
    feats = buckets(tok)
    rng = np.random.default_rng(seed)
    seen_w, seen_t, seen_b = np.full(5 << BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    group = 64
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), group):
            docs = order[s : s + group]
            sizes = (tok["first"][docs + 1] - tok["first"][docs]).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            own = np.concatenate([np.arange(tok["first"][d], tok["first"][d + 1]) for d in docs])
            if not len(own):
                continue
            f, want = feats[:, own], tag[own]
            fwd, back, g = model.odds({"first": first}, f)
            p = fwd * back / (1 + fwd * back)
            miss = p - want
            grad = sum(np.bincount(row, miss, 5 << BITS) for row in f)
            # pair marginals between neighbours of a document
            left = np.setdiff1d(np.arange(len(own) - 1), first[1:-1] - 1, assume_unique=False)
            e = np.exp(model.trans)
            right = g[left + 1] * back[left + 1]
            joint = np.stack([np.full(len(left), e[0, 0]), e[0, 1] * right, fwd[left] * e[1, 0], fwd[left] * e[1, 1] * right])
            joint /= joint.sum(0)
            gt = joint.sum(1).reshape(2, 2)
            np.subtract.at(gt, (want[left].astype(int), want[left + 1].astype(int)), 1)
            grad += 1e-3 * model.weight * (grad != 0)
            seen_w += grad * grad
            model.weight -= rate * grad / np.sqrt(seen_w)
            seen_t += gt * gt
            model.trans -= 0.1 * gt / np.sqrt(seen_t)
            gb = miss.sum()
            seen_b += gb * gb
            model.bias -= 0.3 * gb / np.sqrt(seen_b)
    x = model.features(model.marginals(tok), tok["first"])
    w = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    beta = np.zeros(3)
    for _ in range(50):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(3)
        step = np.linalg.solve(hess, x.T @ (w * (y - q)) - 0.5 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    model.doc = beta
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int, modulus: int = 3, remainder: int = 1) -> Model:
    """Learn from at most about 2.5 * `per_class` labelled rows outside the held-out fold."""
    got = C.labelled_sample(docs, labels, "toxic", per_class, modulus, remainder)
    return train(C.texts_of(got), np.array([r["_y"] for r in got], np.int64))


def apply(docs: DataFrame, model: Model, threshold: float = 0.7, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score, spans (start, end, p) and predicted for every row, over whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", C.held_out("doc_id", modulus, remainder).alias("held_out"), "text")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches):
        own = sent.value
        for batch in batches:
            for part, data, offsets in C.chunks(batch):
                score, spans = own.score(data, offsets)
                yield C.batch_of(kind, doc_id=part.column(0).cast(pa.int64()), held_out=part.column(1), score=score, spans=spans)

    got = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, spans array<struct<start: long, end: long, p: double>>")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, C.table(spark, sf_dir, "labels"), per_class=1200))
