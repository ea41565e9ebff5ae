"""Words, hashes, token counts and the text models, against plain Python."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import common as C
from shardloom.llm import langid, lm, quality, tokencount, toxicity

SPACE, ALNUM = rb"[^\x20\x09-\x0D]+", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXTS = ["Hello, World!  it's é2", "", " \t\n", "a", "É1 É1\x0bé1", "x" * 70_000 + " tail", "ß\x1cß ÄÖ 日本語 text", "1,2;3", "Kelvin İstanbul"]


def packed(texts):
    return C.texts_of([{"text": t} for t in texts])


def documents(spark, rows=None, schema="doc_id long, text string, lang string, source string, score int, key string, body string, h int, w string"):
    """Nulls everywhere, empty, long, repeated rows and ids, and columns with names the operators use."""
    if rows is None:
        rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "other text of id one"), (0, TEXTS[0]), (None, "no id at all here"), (None, None), (77, None)]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None if i is None else f"s{i % 3}", 1, "k", None, 2, "w") for i, t in rows], schema)


@pytest.mark.parametrize(("table", "pattern"), [(C.NOT_SPACE, SPACE), (C.ALNUM, ALNUM)])
def test_words(table, pattern):
    data, offsets = packed(TEXTS)
    low = C.LOWER[data]
    start, end, first = C.words(low, offsets, table)
    for i, t in enumerate(TEXTS):
        want = re.findall(pattern, bytes(C.LOWER[np.frombuffer(t.encode(), np.uint8)]))
        got = [low[a:b].tobytes() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)]
        assert got == want
    hashes = C.Hashes(low).of(start, end)
    by = {}
    for h, a, b in zip(hashes.tolist(), start, end, strict=True):
        assert by.setdefault(low[a:b].tobytes(), h) == h
    assert len(set(by.values())) == len(by)


VOCABULARY = ("▁", "▁a", "▁ab", "abc", "bc", "c", "cd", "cde", "▁abcd", "d", "é", "ef")


def greedy(word, vocabulary):
    n = i = 0
    longest = max(map(len, vocabulary))
    while i < len(word):
        size = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in vocabulary), 0)
        n += 1 if size else len(word[i].encode())
        i += size or 1
    return n


def test_automaton_is_greedy():
    own, rng = tokencount.Automaton(VOCABULARY), np.random.default_rng(0)
    for _ in range(3000):
        word = "▁" + "".join(rng.choice(list("abcdefé日x"), rng.integers(0, 12)))
        assert own.count(word) == greedy(word, set(VOCABULARY)), word


def test_token_counts(spark):
    vocabulary = tokencount.pieces()
    known = set(vocabulary)
    docs = documents(spark)
    want = sorted(str((r["doc_id"], len((r["text"] or "").encode()), len(w), sum(greedy("▁" + x.decode(), known) for x in w))) for r in docs.collect() for w in [(r["text"] or "").encode().split()])
    # the 70,000-letter word is as much a word as any
    assert sorted(str(tuple(r)) for r in tokencount.count_tokens(docs, vocabulary).collect()) == want
    assert tokencount.count_tokens(docs.limit(0), vocabulary).count() == 0


def lm_rows(spark, docs):
    texts = docs.where(C.learnable("doc_id", 7, 2))
    counts = C.materialize(lm.count_words(texts))
    return lm.fit(texts, counts), counts


def test_lm_against_plain_counts(spark, monkeypatch):
    import zlib
    from collections import Counter

    rows = [(i, f"the cat {'sat' if i % 3 else 'ran'} on the mat w{i} w{i % 5}") for i in range(60)] + [(3, None), (None, "the cat"), (1, "the cat sat on the mat w1 w1"), (1, "the cat sat on the mat w1 w1")]
    docs = documents(spark, rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = lambda t: [x.decode() for x in (t or "").encode().lower().split()] + [None]
    c = Counter(x for i, t in rows if i is not None and not held(i) for x in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted(str((i, held(i), len(toks(t)), sum(c[x] > 0 for x in toks(t)), n, round(float(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in toks(t))), 6))) for i, t in rows)
    for common in (lm.COMMON, 4):  # all counts sent, and most joined
        monkeypatch.setattr(lm, "COMMON", common)
        model, counts = lm_rows(spark, docs)
        assert (model.tokens, model.distinct) == (n, v)
        out = lm.score(docs, model, counts).collect()
        got = sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in out)
        assert got == want
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert np.allclose(np.exp(model.logp.astype(float)).sum(-1), 1, atol=1e-4)
    empty = docs.limit(0)
    assert lm.score(empty, *lm_rows(spark, empty)).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    docs = documents(spark, [(i, "a b c d e " * (i % 4 + 1)) for i in range(40)])
    model, counts = lm_rows(spark, docs)
    # the shortlist holds all words here, so the class of others is the one unknown event
    assert model.rest_distinct == 0 and len(model.short) == model.distinct
    assert np.allclose(np.exp(model.logp.astype(float)).sum(-1), 1, atol=1e-4)


def test_lm_vocabulary_and_training_grow_with_the_corpus(spark):
    # 1,500 pairs of words, each pair always in this order: told by context vectors only
    rows = [(i, " ".join(f"a{j % 1500} b{j % 1500}" for j in range(7 * i, 7 * i + 40))) for i in range(1500)]
    docs = documents(spark, rows)
    model, counts = lm_rows(spark, docs)
    own = lm.Layout(len(model.short))
    assert model.distinct == len(model.short) == 3001 and own.blocks > 1
    rng = np.random.default_rng(0)
    for one, two in rng.integers(0, 3003, (5, 2)):
        p = np.exp(model.log_probabilities(np.arange(3002), np.full(3002, one), np.full(3002, two)))
        assert np.isclose(p.sum(), 1, atol=1e-4)
    out = [r for r in lm.score(docs, model, counts).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
    print("gain a token", gain)
    assert gain > 0.3


def test_lm_learns_from_every_token(spark, monkeypatch):
    monkeypatch.setattr(lm, "DRAWS", 1)  # as in large corpora: one pass
    docs = documents(spark, [(i, " ".join(f"w{i}_{j}" for j in range(10))) for i in range(400)])
    texts = docs.where(C.learnable("doc_id", 7, 2))
    model = lm.fit(texts, C.materialize(lm.count_words(texts)), floor=1)
    own = lm.Layout(len(model.short))
    assert model.distinct == own.words and own.blocks > 1
    # each word but the end token stands once, so its vector moves only if that one token is a target (or noise)
    start = lm.beginning(np.array([texts.count()] + [1.0] * (own.words - 1)), 0)
    moved = (model.table != start).any(1)
    assert moved[: own.head].all() and moved[own.first : own.context].all()


def test_mobius_scan():
    rng = np.random.default_rng(1)
    a, b, c, d = rng.random((4, 1000)) + 0.1
    want, r = [], 1.0
    for i in range(1000):
        r = (a[i] * r + b[i]) / (c[i] * r + d[i])
        want.append(r)
    assert np.allclose(toxicity.mobius_scan(a, b, c, d), want)


def test_crf_marginals_equal_enumeration():
    import itertools

    model = toxicity.Model(np.random.default_rng(2).normal(0, 1, 5 << toxicity.BITS), -0.5, np.array([[0.3, -1.0], [-0.2, 0.8]]), np.zeros(3))
    data, offsets = packed(["one two three four five", "", "six seven"])
    tok = toxicity.tokens(data, offsets)
    emit = model.bias + sum(model.weight[f] for f in toxicity.buckets(tok))
    got = model.marginals(tok)
    for lo, hi in ((0, 5), (5, 7)):
        total, hit = 0.0, np.zeros(hi - lo)
        for tags in itertools.product((0, 1), repeat=hi - lo):
            s = np.exp(sum(emit[lo + i] for i, x in enumerate(tags) if x) + sum(model.trans[x, y] for x, y in itertools.pairwise(tags)))
            total += s
            hit += s * np.array(tags)
        assert np.allclose(got[lo:hi], hit / total)


def labelled(n=300):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = rng.choice(["alpha", "beta", "gamma", "delta", "omega"], 30).tolist()
        if i % 3 == 0:
            words[int(rng.integers(30))] = "dreadword"
        rows.append((i, " ".join(words)))
    return rows


def test_toxicity(spark):
    rows = labelled()
    docs = documents(spark, [*rows, (None, "dreadword here"), (999, None), (998, ""), (0, rows[0][1])])
    labels = spark.createDataFrame([(i, int("dread" in t), 1 - i % 2) for i, t in rows] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    out = toxicity.apply(docs, toxicity.fit(docs, labels, 100)).collect()
    assert len(out) == len(rows) + 4
    text = dict(rows) | {None: "dreadword here"}
    for r in out:
        t = text.get(r.doc_id) or ""
        assert r.predicted == int("dreadword" in t) and 0 <= r.score <= 1
        assert [t[s.start : s.end] for s in r.spans] == ["dreadword"] * t.count("dreadword")
    empty = toxicity.fit(docs, labels.limit(0), 100)
    assert {r.score for r in toxicity.apply(docs, empty).collect()} == {0.5}
    assert toxicity.apply(docs.limit(0), empty).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        words = rng.choice(["stone", "river", "cloud", "field"], 40).tolist()
        rows.append((i, " ".join(w.upper() + "!!" if i % 2 else w for w in words)))
    docs = documents(spark, [*rows, (None, "x"), (999, None)])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, "quality", 100)
    out = {r.doc_id: r for r in quality.apply(docs, model).collect()}
    assert all(out[i].predicted == 1 - i % 2 for i, _ in rows) and len(out) == 302
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 300} == {i for i, _ in rows if i % 2 == 0}
    assert {round(r.score, 6) for r in quality.apply(docs, quality.fit(docs, labels.limit(0), "quality", 100)).collect()} == {0.5}
    assert quality.apply(docs.limit(0), model).count() == 0


def test_language(spark):
    rng = np.random.default_rng(6)
    words = {"en": ["the", "and", "thing", "where"], "fr": ["être", "où", "chaque", "les"], "de": ["und", "über", "schön", "ich"]}
    rows = []
    for i in range(240):
        lang = ["en", "fr", "de"][i % 3]
        rows.append((i, " ".join(rng.choice(words[lang], 50)), lang))
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 456 !!", "de"), (902, "", None), (None, "the and thing where the", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, 60)
    out = {r.doc_id: r for r in langid.apply(docs, model).collect()}
    assert sum(out[i].lang_pred == lang for i, _, lang in rows) >= 236
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[None].lang_pred == "en"
    kept = langid.keep_language(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id >= 900").count() == 0
    assert {r.lang_pred for r in langid.apply(docs, langid.fit(docs.limit(0), 60)).collect()} == {"und"}
    assert langid.apply(docs.limit(0), model).count() == 0


def test_sample_learns_every_class(spark):
    rows = [(f"text {i}", f"l{i % 70:02d}") for i in range(700)]
    got = C.sample_by_class(spark.createDataFrame(rows, "text string, _y string"), "_y", 5, "text").collect()
    assert {r._y for r in got} == {y for _, y in rows}


def test_copies_do_not_crowd_out_a_small_class(spark):
    from collections import Counter

    draws = spark.range(400).selectExpr("concat('hot ', id) AS t", "pmod(xxhash64(concat('hot ', id), 11), 1 << 30) AS d").orderBy("d").first()
    rows = [(draws.t, "big")] * 1000 + [(f"text {i}", "big") for i in range(400)] + [(f"rare {i}", "small") for i in range(20)]
    got = C.sample_by_class(spark.createDataFrame(rows, "text string, _y string"), "_y", 20, "text").collect()
    n = Counter(r._y for r in got)
    assert n["small"] == 20 and 0 < n["big"] <= 25 and len({tuple(r) for r in got}) == len(got)


def test_folds_follow_crc32(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", C.held_out("doc_id", 3, 1).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id").select(C.held_out("doc_id", 3, 1), C.learnable("doc_id", 3, 1)).first()[:] == (False, False)
    assert F.lit(1) is not None


# ---------------------------------------------------------------- models against plain loops


def test_language_scores_against_direct_convolution():
    rng = np.random.default_rng(11)
    width = langid.FILTERS * len(langid.WIDTHS)
    filters = [rng.normal(size=(w, langid.DIM, langid.FILTERS)) for w in langid.WIDTHS]
    model = langid.Model(["a", "b", "c"], rng.normal(size=(256, langid.DIM)), filters, rng.normal(size=width), rng.normal(size=(width, 3)), rng.normal(size=3))
    texts = ["", "short", "Ünïcode ÄÖ " * 9, "x" * langid.WINDOW, "The Quick brown fox " * 40]
    best, score = model.predict(*C.texts_of([{"text": t} for t in texts]), model.tables())
    for i, t in enumerate(texts):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
        starts = [min(k * langid.WINDOW, max(0, len(low) - langid.WINDOW)) for k in range(max(1, -(-len(low) // langid.WINDOW)))]
        found = []
        for s in starts:
            w = low[s : s + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            pooled = []
            for f in filters:
                pooled += np.max([sum(model.embed[w[p + j]] @ f[j] for j in range(len(f))) for p in range(langid.WINDOW - len(f) + 1)], axis=0).tolist()
            z = np.maximum(np.array(pooled) + model.fbias, 0) @ model.out + model.bias
            found.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        mean = np.mean(found, axis=0)
        assert best[i] == mean.argmax() and score[i] == pytest.approx(mean.max(), abs=1e-4)


def test_quality_scores_against_a_plain_average():
    rng = np.random.default_rng(12)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    texts = ["", "one", "a a a", "The cat  sat\ton the mat the mat", "é È ünder", "x" * 50 + " y"]
    got = model.score(*C.texts_of([{"text": t} for t in texts]))
    cut, mask = 64 - quality.BITS, (1 << 32) - 1

    def hash_of(w):
        own = np.frombuffer(w, np.uint8)
        return int(C.Hashes(own).of(np.array([0]), np.array([len(w)]))[0])

    for t, score in zip(texts, got, strict=True):
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        hashes = [hash_of(w) for w in words]
        buckets = [h >> cut for h in hashes]
        for a, b in zip(hashes, hashes[1:], strict=False):
            pair = 0x1234567 if a == b else int(C.mix(np.array([(a * 31 + b) % (1 << 64)], np.uint64))[0])
            buckets.append(pair >> cut)
        raw = t.encode()
        for k, mul in ((3, 2654435761), (4, 2246822519)):
            for i in range(len(raw) - k + 1):
                if re.search(rb"[\x20\x09-\x0D]", raw[i + 1 : i + k - 1]):
                    continue  # a gram may begin or end with a space, but holds none inside
                g = int.from_bytes(raw[i : i + k], "little") * mul & mask
                buckets.append(((g ^ g >> 15) * 0x85EBCA6B & mask) >> 32 - quality.BITS)
        mean = float(np.mean([model.weight[b] for b in buckets])) if buckets else 0.0
        assert score == pytest.approx(1 / (1 + math.exp(-mean - 0.3)), abs=1e-6)


def test_pipeline_stages_on_odd_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    own = C.table(spark, folder, "documents")
    some = own.where("doc_id < 60").unionByName(own.where("doc_id < 3"))  # rows alike
    long = own.where("doc_id = 1").withColumn("text", F.repeat("text", 300)).withColumn("doc_id", F.lit(900_001).cast("long"))
    null = {c: F.lit(None).cast(own.schema[c].dataType) for c in own.columns}
    docs = some.unionByName(long).unionByName(own.where("doc_id = 2").withColumns(null)).unionByName(own.where("doc_id = 4").withColumn("text", F.lit("")))
    odd = ("row", "rest", "_n", "_h", "node", "root", "body", "size", "n", "i", "b", "m", "own", "_y", "held_out")
    docs = C.materialize(docs.withColumns({c: F.lit(3) for c in odd}))
    for k, (name, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, folder)
        rows = got.collect()
        assert all(r[c] == 3 for r in rows for c in odd), name
        if k < len(P.STAGES) - 1:
            assert got.columns == docs.columns and 0 < len(rows) <= docs.count(), name
        none = stage(spark, docs.limit(0), folder)
        assert none.count() == 0, name
