"""Benchmark decontamination: winnowed fingerprints, joined and extended. DataFrame functions only.

Of every `window` consecutive words of an item (an item of fewer words is one
window) a document may hold an occurrence. Winnowing keeps, of each window's
k-gram hashes, the smallest; an occurrence has the same k-grams as its window,
so the same smallest one is kept on both sides and every occurrence is found.
The training fingerprints meet the test fingerprints in a join; documents that
hit are extended: all their windows meet the test windows, exactly, as text.

The fingerprints use a looser equality of words (case beyond A-Z is ignored),
which can only add hits; the extension compares the exact words.

Defined results: a null or wordless text has n_words 0 and hits nothing; a null
or wordless item has no window; identical rows get identical rows back; an item
id may be null (listed as nothing, yet counted by its windows); documents of the
same id but other texts are told apart; a very long text is looked at whole, in
time that grows with its words; empty tables give no rows or no hits. Other
columns are ignored, and `drop_contaminated` carries them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import native as N

WINDOW = 13
GRAM = 8


def least_of(grams: Column, w: int) -> Column:
    """The smallest of each run of `w`; none if there are fewer."""
    if w == 1:
        return grams
    n = F.size(grams)
    least = F.transform(F.sequence(F.lit(1), n - (w - 1)), lambda i: F.array_min(F.slice(grams, i, w)))
    return F.when(n >= w, least).otherwise(F.array().cast("array<bigint>"))


def with_fingerprints(df: DataFrame, lengths: list[int], k: int = GRAM) -> DataFrame:
    """Explode `h` (word hashes): for each length a row (len, mark) for each fingerprint.

    A fingerprint is the smallest k-gram hash of a run of `length` words.
    """
    kept = []
    for n in lengths:
        g, w = min(k, n), n - min(k, n) + 1
        df = N.fence(df, f"g{n}", N.grams(F.col("h"), g))
        df = N.fence(df, f"m{n}", F.array_distinct(least_of(F.col(f"g{n}"), w))).drop(f"g{n}")
        kept.append(F.struct(F.lit(n).alias("len"), F.col(f"m{n}").alias("marks")))
    df = df.select("*", F.explode(F.array(*kept)).alias("f")).drop("h", *[f"m{n}" for n in lengths])
    return df.select("*", F.explode("f.marks").alias("mark")).select("*", F.col("f.len").alias("len")).drop("f")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, len, win) for every window of every item, each once."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), N.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1))
    return w.select("item_id", "w", "len", at.alias("at")).select("item_id", "len", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("win")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """The documents that hold an occurrence: doc_id, body, size, n_hit, n_items, items_sha256.

    `body` and `size` (hash and bytes of the text) tell documents of one id apart.
    """
    windows = C.materialize(item_windows(items, window))
    lengths = sorted(r[0] for r in windows.select("len").distinct().limit(window).collect())  # at most `window` numbers
    if not lengths:
        return docs.select("doc_id", F.lit(0).cast("long").alias("body"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items_sha256")).limit(0)

    key = ["doc_id", "body", "size"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "text")

    # fingerprints of both sides; an item's windows give those of their own length only
    test = N.fence(windows.select(F.col("len").alias("own"), "win"), "h", N.loose_hashes(F.split("win", " "))).drop("win")
    marks = C.materialize(with_fingerprints(test, lengths, k).where(F.col("own") == F.col("len")).select("len", "mark").distinct())
    hashed = N.fence(docs.select(*key, "text"), "cw", N.cased_words(F.col("text"))).drop("text")
    found = with_fingerprints(N.fence(hashed, "h", N.loose_hashes(F.col("cw"))).drop("cw"), lengths, k)
    hit = N.join_small(found, marks, ["len", "mark"], "left_semi").select(*key).distinct()

    # extension: exact windows of the documents that hit
    hit = C.materialize(hit)
    again = N.join_small(docs.withColumn("doc_id_", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), hit.withColumn("doc_id_", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).drop("doc_id"), ["doc_id_", "body", "size"], "left_semi")
    again = N.fence(again.select(*key, "text"), "w", N.words(F.col("text"))).drop("text")
    spots = None
    for n in lengths:
        part = again.where(F.size("w") >= n).select(*key, "w", F.explode(F.sequence(F.lit(1), F.size("w") - (n - 1))).alias("at"))
        part = part.select(*key, F.col("at"), F.lit(n).alias("len"), F.array_join(F.slice("w", F.col("at"), n), " ").alias("win"))
        spots = part if spots is None else spots.unionByName(part)
    wins = windows.select("len", "win").distinct().withColumn("win_id", F.xxhash64("win"))
    spots = C.materialize(N.join_small(spots, wins, ["len", "win"]).select(*key, "at", "len", "win_id").distinct())

    end = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "len"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["at"] + x["len"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(acc["end"], x["at"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    cover = spots.groupBy(*key).agg(end.alias("n_hit"))
    named = N.join_small(spots.select(*key, "len", "win_id").distinct(), windows.select("item_id", "len", F.xxhash64("win").alias("win_id")), ["len", "win_id"])
    listed = named.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    same = [cover[c].eqNullSafe(listed[c]) for c in key]
    return cover.join(listed, same[0] & same[1] & same[2]).select(*[cover[c] for c in key], "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = GRAM, share: int = 20) -> DataFrame:
    """One row for every row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, items, window, k).withColumnsRenamed({"doc_id": "_d", "body": "_b", "size": "_s"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.size(N.cased_words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["body"] == F.col("_b")) & (rows["size"] == F.col("_s")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = GRAM, share: int = 20) -> DataFrame:
    """The rows of `docs`, all columns, but for contaminated documents."""
    # stored, so that its size is known and the rows need not be shuffled for a small one
    found = C.materialize(contamination(docs, items, window, k).select("doc_id", "body", "size", "n_hit"))
    # whole rows travel in one column, so that theirs may have any names
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("b"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("s"), F.size(N.cased_words(F.col("text"))).alias("n"))
    bad = F.col("i").eqNullSafe(found["doc_id"]) & (F.col("b") == found["body"]) & (F.col("s") == found["size"]) & (found["n_hit"] * share >= F.col("n"))
    return rows.join(found, bad, "left_anti").select("row.*")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (
    SELECT CAST(item_id AS VARCHAR) AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w
    FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
          FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
found AS (SELECT s.rid, s.i, s.n, item_id FROM spots s JOIN wins USING (n, win)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""
