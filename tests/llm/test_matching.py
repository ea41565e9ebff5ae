"""Decontamination, license scans, set joins, embeddings and mixing, against brute force."""

import hashlib
import math
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import common as C
from shardloom.llm import decontaminate, graph, jaccard, license, mixing, neardup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(UP))


def frame(spark, rows):
    """Documents with extra columns whose names the operators use."""
    return spark.createDataFrame([(i, t, 1, "x", None, "s") for i, t in rows], "doc_id long, text string, n_hit int, body string, size int, source string")


# ---------------------------------------------------------------- decontamination


def contamination(rows, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                got = wins.get(tuple(w[k : k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


def test_decontamination(spark):
    rng = np.random.default_rng(0)
    text = lambda n: " ".join(rng.choice(["Stone", "river", "cloud", "field", "Éclair", "x1"], n))
    items = [(i, text(int(n))) for i, n in enumerate((20, 13, 12, 5, 3, 1, 30, 0, 14, 2))] + [(100, None), (10, text(25)), (9, "unseen"), (101, "ÉCLAIR éclair Éclair stone stone stone stone river river river cloud cloud cloud field")]
    pieces = [t for _, t in items if t]
    rows = [(i, text(int(rng.integers(0, 40))) + " -- " + pieces[int(rng.integers(len(pieces)))].upper() + ", " + text(int(rng.integers(0, 20)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "..."), (None, pieces[0]), (3, rows[3][1]), (4, "another text of id four"), (None, pieces[0]), (203, " ".join(words(pieces[0])[:12]))]
    docs, bench = frame(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, win string")
    got = decontaminate.judge(docs, bench)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got.collect()) == contamination(rows, items)
    # without short items, as by default few pass
    long = [(i, t) for i, t in items if len(words(t)) >= 13]
    few = spark.createDataFrame(long, "item_id long, text string")
    got = decontaminate.judge(docs, few)
    want = contamination(rows, long)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got.collect()) == want
    docs = docs.withColumns({c: F.lit(7) for c in ("_n", "_body", "_size", "_words", "row", "i", "b", "s", "n")})
    kept = decontaminate.drop_contaminated(docs, few)
    assert kept.columns == docs.columns and kept.count() == sum(w.endswith("False)") for w in want)
    assert decontaminate.judge(docs, few.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.judge(docs.limit(0), few).count() == 0
    assert decontaminate.drop_contaminated(docs, few.limit(0)).count() == len(rows)


def test_native_plans_have_no_python(spark):
    docs, bench = frame(spark, [(1, "a b c")]), spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    plans = [decontaminate.judge(docs, bench), license.scan(docs, license.templates(spark, license.PHRASES, 2, 1.0), license.templates(spark, license.NOTICES, 4, 0.5))]
    for p in plans:
        assert not re.search("Python|Pandas|Arrow", p._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- licences


def places(t):
    w = words(t)
    out = []
    for phrase, label in license.PHRASES.items():
        p = phrase.split()
        out += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), out


def test_licenses(spark):
    rng = np.random.default_rng(1)
    bits = ["GNU General Public License", "apache license", "Apache, LICENSE", "cc by", "CC-BY", "mit license", "gnu general public", "license", "by", "word", "mit", "apache", "ÉCC by"]
    rows = [(i, " ".join(rng.choice(bits, rng.integers(1, 25)))) for i in range(80)] + [(100, None), (101, ""), (102, "!!"), (None, "mit license"), (1, "other cc by"), (5, None), (103, "cc by cc by cc by")]
    rows.append((2, rows[2][1]))
    notice = list(license.NOTICES)[1]
    cut = notice.split()
    rows += [(300, "x " * 50 + notice.upper()), (301, " ".join([*cut[:8], "very", *cut[8:]])), (302, " ".join(cut[:5]))]
    docs = frame(spark, rows)
    got = license.scan(docs, license.templates(spark, license.PHRASES, 2, 1.0), license.templates(spark, license.NOTICES, 4, 0.5)).collect()
    want = []
    for i, t in rows:
        n, at = places(t)
        want.append((i, n, len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 300}
    assert [by[i].labels for i in (300, 301, 302)] == ["mit", "mit", ""] and all(0 <= r.score <= 1 for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license.scan(docs.limit(0), license.templates(spark, license.PHRASES, 2, 1.0), license.templates(spark, license.NOTICES, 4, 0.5)).count() == 0


def test_licenses_in_long_texts(spark):
    """A text of thousands of places takes no more than in proportion, and templates need no Python."""
    import time

    def seconds(n):
        docs, began = frame(spark, [(1, "cc by " * n + "words " * 100_000), (2, "mit license")]), time.perf_counter()
        got = {r.doc_id: r for r in license.scan(docs, license.templates(spark, license.PHRASES, 2, 1.0), license.templates(spark, license.NOTICES, 4, 0.5)).collect()}
        assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == (n, 0, 2 * n - 2, 2 * n + 100_000)
        return time.perf_counter() - began

    seconds(10)
    few, many = seconds(2_000), seconds(8_000)
    assert many < 4 * few + 5
    plan = license.templates(spark, license.NOTICES, 4, 0.5)._jdf.queryExecution()
    assert "RDD" not in plan.analyzed().toString() and "python" not in plan.toRdd().toDebugString().lower()


# ---------------------------------------------------------------- components, set joins


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(int(a) + 2000, int(b) + 2000) for a, b in rng.integers(0, 200, (120, 2))]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups(got) == groups(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def set_components(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    edges = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = closure(range(len(rows)), edges)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(map(str, out))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, n, percent):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    for size in (1, 2, 3, 4, 5, 8, 12, 20, 40, 90, 200, 600):
        for _ in range(4):
            base = rng.choice(vocabulary, size).tolist()
            for _ in range(5):  # a chain of ever more edits
                rows.append((i, " ".join(base)))
                i += 1
                for _ in range(max(1, size // 60)):
                    base[int(rng.integers(size))] = str(rng.choice(vocabulary))
    common = rng.choice(vocabulary, 60).tolist()
    rows += [(i + k, " ".join([*common, *rng.choice(vocabulary, int(rng.integers(0, 14)))])) for k in range(40)]
    rows += [(5000, None), (5001, ""), (5002, " \t"), (None, rows[100][1]), (None, None), (7, "other text of id seven"), (3, rows[3][1]), (5003, rows[60][1].upper())]
    got = jaccard.component_table(frame(spark, rows), n, percent)
    assert sorted(str(tuple(r)) for r in got.collect()) == set_components(rows, n, percent)


def test_jaccard_keeps_one(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(5, long), (3, long), (3, long), (9, "a b c d e f"), (None, long), (None, None), (10, None), (11, ""), (9, "q r s t u v"), (12, "g h i j k l"), (9, long + " more"), (None, "u1 u2 u3 u4"), (None, "u1 u2 u3 u4")]
    docs = frame(spark, rows).withColumns({"b": F.lit(1), "m": F.lit(2), "row": F.lit(3), "node": F.lit(4), "root": F.lit(5), "_again": F.lit(6), "i": F.lit(7)})
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(3, long), (9, "a b c d e f"), (9, "q r s t u v"), (12, "g h i j k l"), (None, None), (10, None), (11, ""), (None, "u1 u2 u3 u4")]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, want))
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        for band, (low, high) in enumerate(jaccard.bands(900)):
            most = jaccard.differing(high, high, percent)
            plans = {jaccard.allocate(low, high, sets, percent) for sets in (1, 1000, 10**7, 10**11)} | ({(-(-(most + 1) // 2), True), (most + 1, False)} if most else set())
            for plan in plans - {None}:
                for _ in range(6):
                    size = int(rng.integers(low, high + 1))
                    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                    drop = int(rng.integers(0, (100 - percent) * len(a) // 100 + 1))
                    b = a[rng.permutation(len(a))[: len(a) - drop]]
                    while len(b) < high and 100 * len(np.intersect1d(a, b)) >= percent * (len(np.union1d(a, b)) + 1):
                        b = np.append(b, rng.integers(0, 2**63, dtype=np.uint64))
                    b = np.sort(b)
                    if len(a) == len(b) and (a == b).all():
                        continue
                    h, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                    largest = np.minimum(high, np.diff(first) * 100 // percent)
                    sig, begin, need = jaccard.emit(h, first, np.array([0, 1]), band, plan, jaccard.differing(np.diff(first), largest, percent))
                    one, two = set(sig[: begin[1]].tolist()), set(sig[begin[1] :].tolist())
                    both = one & two
                    assert len(both) >= need.max(), (low, high, plan, len(a), len(b))
                    # whatever the order, what each chooses has one in common
                    order = {s: i for i, s in enumerate(rng.permutation(sorted(one | two)).tolist())}
                    pick = lambda own, k: set(sorted(own, key=order.get)[: len(own) - int(k) + 1])
                    assert pick(one, need[0]) & pick(two, need[1])
                    assert {s >> 58 & 63 for s in both} == {band}


def test_jaccard_in_groups_that_share_most_words(spark):
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):  # one group of copies with zero to eight edits
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            w[k] = f"e{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:60] + [f"own{i}x{k}" for k in range(50)])) for i in range(60)]
    rows += [(2000 + i, f"x{i % 7} " + "same " * int(rng.integers(4, 300))) for i in range(40)]
    for n, percent in ((4, 85), (5, 80)):
        got = jaccard.component_table(frame(spark, rows), n, percent)
        assert sorted(str(tuple(r)) for r in got.collect()) == set_components(rows, n, percent)
    assert jaccard.component_table(frame(spark, rows).limit(0), 4, 85).count() == 0


# ---------------------------------------------------------------- embeddings


def vector_rows(seed=5, groups=40, size=12):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.normal(size=24)
        for _ in range(size):
            out.append(((centre + rng.normal(0, 0.22, 24)).tolist(), g % 3))
    big = rng.normal(size=24)
    out += [((big + rng.normal(0, 0.05, 24)).tolist(), 1) for _ in range(300)]
    out += [(big.tolist(), 1)] * 20 + [((big * 2).tolist(), 1), (big.tolist(), None), ([0.0] * 24, 1), (None, 1), ([], 1), ([float("nan")] * 24, 1), ([float("inf")] + [1.0] * 23, 1), ([None] + [1.0] * 23, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    return [(i if i % 50 else None, e, label, "x") for i, (e, label) in enumerate(out)]


def test_embeddings(spark):
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = neardup.near_duplicates(table)
    exact = []
    for i, e, label, _ in rows:
        x = None if e is None or label is None or not e or any(v is None or not math.isfinite(v) for v in e) else np.array(e, np.float32).astype(float)
        exact.append((i, label, None if x is None or not x.any() else x / np.linalg.norm(x)))
    edges = [(a, b) for a, b in combinations(range(len(rows)), 2) if exact[a][1] == exact[b][1] and exact[a][2] is not None and exact[b][2] is not None and len(exact[a][2]) == len(exact[b][2]) and exact[a][2] @ exact[b][2] >= 0.93]
    root, n = closure(range(len(rows)), edges), [0] * len(rows)
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    want = []
    for k, (i, _, _) in enumerate(exact):
        ids = [exact[j][0] for j in range(len(rows)) if root[j] == root[k] and exact[j][0] is not None]
        least = min(ids, default=None)
        want.append((i, n[k], least, i is not None and i == least))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_that_share_a_direction(spark):
    rng = np.random.default_rng(3)

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    n, dim, cosine = 8_000, 256, 0.9
    common = unit(rng.normal(size=dim))
    x = unit(np.sqrt(cosine) * common + np.sqrt(1 - cosine) * unit(rng.normal(size=(n, dim))))
    for i in range(0, 600, 2):  # planted pairs at 0.94 or so
        x[i + 1] = unit(np.sqrt(cosine) * common + np.sqrt(1 - cosine) * unit(0.4 * unit(x[i] - (x[i] @ common) * common) + 0.917 * unit(rng.normal(size=dim))))
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    linked = near.sum(1)
    assert linked.sum() > 200
    table = spark.createDataFrame([(i, "one", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(table).collect()}
    assert [got[i] for i in range(n)] == linked.tolist()


def test_embeddings_over_many_partitions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1::2] = 0.935 * x[::2] + 0.355 * x[1::2]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    linked = [int(sum(near[i, j] for j in range(500) if i != j and i // 50 == j // 50)) for i in range(500)]
    table = spark.createDataFrame([(i, str(i // 50), v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = {r.vec_id: r.n_links for r in neardup.near_duplicates(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(linked) > 100 and [got[i] for i in range(500)] == linked


def test_forest_joins_what_the_links_join():
    rng = np.random.default_rng(6)
    for share in (0.02, 0.2, 0.9):
        near = rng.random((40, 80)) < share
        r, c = neardup.forest(near)
        full = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
        kept = list(zip(r.tolist(), c.tolist(), strict=True))
        one, two = closure(range(80), full), closure(range(80), kept)
        groups = lambda m: sorted(sorted(k for k in m if m[k] == x) for x in set(m.values()))
        assert groups(one) == groups(two) and set(kept) <= set(full) | {(b, a) for a, b in full}


# ---------------------------------------------------------------- mixing


def test_mixing(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s, n in (("big", 400), ("mid", 120), ("small", 40), (None, 20)):
        rows += [(len(rows) + k, " ".join(["w"] * int(rng.integers(1, 30))), s) for k in range(n)]
    rows += [(9000, None, "big"), (9001, "", "void"), (None, "x y", "small"), (5, rows[5][1], "big")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, weight int")
    odd = ("rest", "epochs", "_n", "_u", "row", "whole", "partial", "_source", "b1", "left1", "_s1", "cell", "left")
    docs = docs.withColumns({c: F.lit(7) for c in odd})
    tokens = lambda t: len((t or "").split())
    total, by = {}, {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + tokens(t)
    whole = sum(total.values())
    for limit, budget in ((1.25, None), (2.0, 1.5 * whole), (50.0, 10.0 * whole)):
        got = mixing.mix_sources(docs, budget=budget, max_repeats=limit).collect()
        b = budget or whole
        by = {}
        for r in got:
            by.setdefault(r.source, []).append(r)
        weights = {s: by[s][0].weight for s in by}
        assert sum(weights.values()) == pytest.approx(1)
        longest = max(tokens(t) for _, t, _ in rows)
        for s, drawn in by.items():
            if not total[s]:
                continue
            target = weights[s] * b
            assert target / total[s] <= limit * 1.001
            assert target - longest - 1 <= sum(r.n_tokens for r in drawn) <= target + 1
            assert len({r.weight for r in drawn}) == 1
        # the exponent is the smallest that keeps the limit
        ratio = max(weights[s] * b / total[s] for s in by if total[s])
        uniform = max(b / (len([s for s in by if total[s]]) * total[s]) for s in by if total[s])
        assert ratio == pytest.approx(min(limit, uniform), rel=1e-3)
        counts = {}
        for r in got:
            counts[(r.source, r["pass"])] = counts.get((r.source, r["pass"]), 0) + 1
        for (s, p), n in counts.items():
            epochs = weights[s] * b / total[s] if total[s] else 1
            if p <= epochs:
                assert n == sum(x[2] == s for x in rows)
        assert all(0 <= r.position <= 1 for r in got)
    assert all(r[c] == 7 for r in got for c in odd)
    entropy = lambda w: -sum(x * math.log(x) for x in w if x)
    got = mixing.mix_sources(docs, max_repeats=1e9, target_entropy=1.1)
    w = {r.source: r.weight for r in got.select("source", "weight").distinct().collect()}
    assert entropy(w.values()) == pytest.approx(1.1, abs=1e-3)
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, budget=3.0 * whole, max_repeats=2.0)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs.where("doc_id = 9001")).count() == 1


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    docs = C.table(spark, folder, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = C.materialize(stage(spark, before, folder))
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns and docs.join(before, columns, "left_anti").count() == 0, name
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {r[0] for r in map(eval, set_components(rows, 5, 80)) if r[0] == r[2]}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "benchmark decontamination":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            items = [(r.item_id, r.text) for r in C.table(spark, folder, "benchmark").collect()]
            want = {eval(r)[0] for r in contamination(rows, items) if r.endswith("False)")}
            assert {r.doc_id for r in docs.collect()} == want
    assert set(columns) < set(docs.columns) and docs.where(F.col("position").isNull()).count() == 0
    assert [len(P.STAGES), P.ORACLE_SQL] == [5, None]
