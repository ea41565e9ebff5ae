"""License scans by diagonal voting. DataFrame functions only.

Every rolling k-gram hash of a document's words meets, in a join, the positions
it has in the templates; hits vote for their diagonal (document position minus
template position); neighbouring diagonals of a template merge, so that a word
put in or left out does not split a span; spans with enough votes are verified
on the exact words.

Two kinds of templates: short phrases (k = 2), whose every word must stand
consecutively (a diagonal with all its votes, then equal words), and passages
of common licence notices (k = 4), of which a share suffices. Templates are
constants of this module, so the broadcast side is bounded.

Defined results: a null or wordless text has n_words 0, no places and score 0;
identical rows get identical rows back; documents of one id but other texts are
told apart; a very long text is looked at whole, in time that grows with its
words and the places found. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import native as N

#: Phrases and labels given by the operator's contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Passages of widely used public licence notices, and the label each gives.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def templates(spark: SparkSession, texts: dict[str, str], k: int, share: float) -> DataFrame:
    """(t, label, tw, k, need): number, label, words, gram length and least share of grams to find."""
    rows = [F.struct(F.lit(i).alias("t"), F.lit(label).alias("label"), F.array(*map(F.lit, text.split())).alias("tw")) for i, (text, label) in enumerate(texts.items())]
    return spark.range(1).select(F.inline(F.array(*rows))).withColumns({"k": F.lit(k), "need": F.lit(share)})


def _votes(hashed: DataFrame, key: list[str], plans: DataFrame, k: int) -> DataFrame:
    """(key, t, diagonal, at): one row for every gram that stands in a template."""
    held = N.fence(plans.select("t", "tw"), "h", N.loose_hashes(F.col("tw")))
    grams = N.fence(held, "g", N.grams(F.col("h"), k)).select("t", F.posexplode("g").alias("q", "gram"))
    seen = N.fence(hashed, "g", N.grams(F.col("h"), k)).select(*key, F.posexplode("g").alias("at", "gram"))
    return seen.join(F.broadcast(grams), "gram").select(*key, "t", (F.col("at") - F.col("q")).alias("diagonal"), "at", "q")


def spans(docs: DataFrame, plans: DataFrame, k: int, drift: int) -> DataFrame:
    """doc_id, body, size, t, start, end, found: merged diagonals of the templates `plans`, before verification.

    `drift`: diagonals of one template that differ by no more, one after
    another and within a template's length of each other, are one span.
    """
    key = ["doc_id", "body", "size"]
    cased = docs.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "text")
    cased = N.fence(cased, "cw", N.cased_words(F.col("text"))).drop("text")
    votes = _votes(N.fence(cased, "h", N.loose_hashes(F.col("cw"))).drop("cw"), key, plans, k)
    # a diagonal of a phrase is one place; longer spans are cut where more than a template lies between votes
    by = votes.groupBy(*key, "t", "diagonal").agg(F.collect_set("q").alias("q"), F.min("at").alias("first"), F.max("at").alias("last")).distinct()
    if drift:
        w = Window.partitionBy(*key, "t").orderBy("diagonal")
        apart = (F.col("diagonal") - F.lag("diagonal").over(w)) > drift
        by = by.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(w))
        by = by.groupBy(*key, "t", "span").agg(F.min("first").alias("start"), (F.max("last") + k).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("q")))).alias("found"))
        return by.drop("span")
    return by.select(*key, "t", F.col("first").alias("start"), (F.col("last") + k).alias("end"), F.size("q").alias("found"))


def scan(docs: DataFrame, phrases: DataFrame, notices: DataFrame) -> DataFrame:
    """One row for every row of `docs`; columns as the contract has them, and `notice_spans`."""
    key = ["doc_id", "body", "size"]
    full = F.size("tw") - F.col("k") + 1
    near = spans(docs, phrases, 2, 0).join(F.broadcast(phrases), "t").where(F.col("found") == full)
    far = spans(docs, notices, 4, 3).join(F.broadcast(notices), "t").where(F.col("found") >= F.col("need") * full)
    columns = [*key, "label", "tw", "k", "start", "end", "found"]
    # an exact look at the words of the documents with spans: each text is split once, whatever the number of its spans
    # distinct: of rows that are alike each gave the span
    some = near.select(*columns).unionByName(far.select(*columns)).distinct()
    some = C.materialize(some.groupBy(*key).agg(F.collect_list(F.struct("label", "tw", "k", "start", "end")).alias("spans")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "text").withColumnsRenamed({"doc_id": "_d", "body": "_b", "size": "_s"})
    marked = some.select(*key)
    texts = texts.join(marked, texts["_d"].eqNullSafe(marked["doc_id"]) & (F.col("_b") == marked["body"]) & (F.col("_s") == marked["size"]), "left_semi").dropDuplicates(["_d", "_b", "_s"])
    joined = some.join(texts, some["doc_id"].eqNullSafe(texts["_d"]) & (some["body"] == F.col("_b")) & (some["size"] == F.col("_s"))).select(*key, "spans", "text")
    joined = N.fence(joined, "w", N.words(F.col("text"))).drop("text")

    def share_of(s):
        span = F.slice("w", s["start"] + 1, s["end"] - s["start"])
        part = F.size(F.array_intersect(span, s["tw"])) / F.size(F.array_distinct(s["tw"]))
        return F.struct(s["label"].alias("label"), s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), F.when(s["k"] == 2, (span == s["tw"]).cast("double")).otherwise(part).alias("share"))

    judged = joined.select(*key, F.explode(F.transform("spans", share_of)).alias("s")).select(*key, "s.*")
    phrase = F.col("k") == 2
    good = judged.where(F.col("share") >= F.when(phrase, 1.0).otherwise(0.6))
    base = F.when(phrase, F.col("start"))
    got = good.groupBy(*key).agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(~phrase, F.struct("start", "end", "label")))).alias("notice_spans"),
    )
    got = got.withColumnsRenamed({"doc_id": "_d", "body": "_b", "size": "_s"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.size(N.cased_words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(got, rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["body"] == F.col("_b")) & (rows["size"] == F.col("_s")), "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "notice_spans",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"), templates(spark, PHRASES, 2, 1.0), templates(spark, NOTICES, 4, 0.5))
