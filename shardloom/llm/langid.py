"""Language ID: a byte convolutional network over fixed-length windows.

Bytes (ASCII lower-cased) are embedded, filters of widths 2, 3 and 4 slide over
windows of `WINDOW` bytes, the largest response of each filter goes through a
softmax. Everything is learned in numpy from windows of a bounded sample of
labelled texts (`per_class` a language, spread over each whole text). A
document's answer is the mean of the class probabilities of all its windows.

When applied, embedding and filter collapse into tables: a filter's response is
a sum of table rows chosen by byte pairs, so a window costs a few gathers.

Defined results: null texts and texts without a letter give `und` with score 0,
as does everything when no row can be learned from; a null id is predicted but
never learned from; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
DIM = 8


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows (zero-padded) and the index of each document's first; an empty text has one."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // WINDOW))
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], count)
    # the last window of a long text ends with it, so that no window is nearly empty
    start = np.repeat(offsets[:-1], count) + np.minimum(nth * WINDOW, np.maximum(0, np.repeat(size, count) - WINDOW))
    at = start[:, None] + np.arange(WINDOW)[None, :]
    inside = at < np.repeat(offsets[1:], count)[:, None]
    low = np.append(C.LOWER[data], np.uint8(0))
    return np.where(inside, low[np.minimum(at, len(data))], np.uint8(0)), first


@dataclass
class Model:
    classes: list[str]
    embed: np.ndarray  # 256, DIM
    filters: list[np.ndarray]  # width, DIM, FILTERS
    fbias: np.ndarray  # widths * FILTERS
    out: np.ndarray  # widths * FILTERS, classes
    bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the tables whose rows are added: by byte pairs, and by a byte if the width is odd."""
        made = []
        for filt in self.filters:
            single = [self.embed @ filt[j] for j in range(len(filt))]
            pairs = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(filt) - 1, 2)]
            made.append([t.astype(np.float32) for t in pairs + single[len(filt) - len(filt) % 2 :]])
        return made

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pooled = []
        pair = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        for filt, parts in zip(self.filters, tables, strict=True):
            n = WINDOW - len(filt) + 1
            got = parts[0][pair[:, :n]]
            if len(filt) == 3:
                got += parts[1][windows[:, 2 : 2 + n]]
            elif len(filt) == 4:
                got += parts[1][pair[:, 2 : 2 + n]]
            pooled.append(got.max(axis=1))
        h = np.maximum(np.concatenate(pooled, 1) + self.fbias, 0)
        z = h @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)

    def predict(self, data: np.ndarray, offsets: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        windows, first = cut(data, offsets)
        p = np.empty((len(windows), len(self.classes)))
        for i in range(0, len(windows), 512):
            p[i : i + 512] = self.probabilities(windows[i : i + 512], tables)
        mean = np.add.reduceat(p, first[:-1], axis=0) / np.diff(first)[:, None]
        best = mean.argmax(1)
        return best, mean[np.arange(len(best)), best]


def train(texts: tuple[np.ndarray, np.ndarray], y: np.ndarray, classes: list[str], per_text: int = 6, epochs: int = 4, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    data, offsets = texts
    windows, first = cut(data, offsets)
    chosen, target = [], []
    for i in range(len(y)):
        own = np.arange(first[i], first[i + 1])
        take = own if len(own) <= per_text else rng.choice(own, per_text, replace=False)
        chosen.append(take)
        target.append(np.full(len(take), y[i]))
    x = windows[np.concatenate(chosen)].copy()
    t = np.concatenate(target)
    short = rng.random(len(x)) < 0.3  # texts may be far shorter than a window
    keep = rng.integers(16, WINDOW, len(x))
    x[short[:, None] & (np.arange(WINDOW)[None, :] >= keep[:, None])] = 0

    k = len(classes)
    width = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.3, (256, DIM)), "b": np.zeros(width), "o": rng.normal(0, 0.2, (width, k)), "c": np.zeros(k)}
    p |= {f"f{w}": rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)) for w in WIDTHS}
    seen = {n: np.full_like(v, 1e-6) for n, v in p.items()}
    batch = 64
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(order), batch):
            xb, tb = x[order[s : s + batch]], t[order[s : s + batch]]
            m = len(xb)
            em = p["e"][xb]
            pooled, where = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                r = sum(em[:, j : j + n] @ p[f"f{w}"][j] for j in range(w))
                a = r.argmax(1)
                where.append(a)
                pooled.append(np.take_along_axis(r, a[:, None, :], 1)[:, 0])
            pre = np.concatenate(pooled, 1) + p["b"]
            h = np.maximum(pre, 0)
            z = h @ p["o"] + p["c"]
            z -= z.max(1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(1, keepdims=True)
            q[np.arange(m), tb] -= 1
            q /= m
            g = {"o": h.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
            gh = (q @ p["o"].T) * (pre > 0)
            g["b"] = gh.sum(0)
            rows = np.arange(m)[:, None]
            for i, w in enumerate(WIDTHS):
                gw = gh[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"f{w}"] = np.empty_like(p[f"f{w}"])
                for j in range(w):
                    spot = where[i] + j
                    g[f"f{w}"][j] = np.einsum("mf,mfd->df", gw, em[rows, spot])
                    np.add.at(g["e"], xb[rows, spot], gw[:, :, None] * p[f"f{w}"][j].T[None])
            for name, grad in g.items():
                seen[name] += grad * grad
                p[name] -= 0.05 * grad / np.sqrt(seen[name])
    return Model(classes, p["e"], [p[f"f{w}"] for w in WIDTHS], p["b"], p["o"], p["c"])


def fit(docs: DataFrame, per_class: int, modulus: int = 3, remainder: int = 1) -> Model | None:
    """Learn from at most 1.25 * `per_class` texts a language outside the held-out fold."""
    rows = docs.where(C.learnable("doc_id", modulus, remainder) & F.col("lang").isNotNull()).select("text", F.col("lang").alias("_y"))
    got = C.sample_by_class(rows, "_y", per_class, "text").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["text"] or "", r["_y"]))  # training depends on the order
    classes = sorted({r["_y"] for r in got})
    return train(C.texts_of(got), np.array([classes.index(r["_y"]) for r in got]), classes)


def _predicted(model: Model | None, docs: DataFrame, columns: list, kind: pa.Schema, spark_kind, filtering: float | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        tables = own.tables() if own else None
        for batch in batches:
            for part, data, offsets in C.chunks(batch, batch.schema.field(text_at).name):
                text = part.column(text_at)
                letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if own is None:
                    name, score = ["und"] * len(part), np.zeros(len(part))
                else:
                    best, score = own.predict(data, offsets, tables)
                    name = [own.classes[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                    score = np.where(letter, score, 0.0)
                if filtering is None:
                    yield C.batch_of(kind, doc_id=part.column(0).cast(pa.int64()), held_out=part.column(1), lang_pred=name, score=score)
                else:
                    yield part.filter(pa.array(letter & (score >= filtering) if own else letter))

    rows = docs.select(*columns)
    text_at = rows.columns.index("text")
    return rows.mapInArrow(run, spark_kind or rows.schema)


def apply(docs: DataFrame, model: Model | None, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of `docs`, over whole texts."""
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    columns = ["doc_id", C.held_out("doc_id", modulus, remainder).alias("held_out"), "text"]
    return _predicted(model, docs, columns, kind, "doc_id long, held_out boolean, lang_pred string, score double", None)


def keep_language(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose text has letters and is told with at least `least` confidence."""
    return _predicted(model, docs, ["*"], None, None, least)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, per_class=500))
