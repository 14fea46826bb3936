"""Licence scans by diagonal voting.

All rolling word k-grams of all texts are joined by hash to the positions of the same k-grams in
licence templates. Hits of one passage lie on one diagonal (text position minus template position);
hits are summed by diagonal, neighbouring diagonals (words put in or left out) are merged, and a
merged span counts if it holds enough of the template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut
from .licences import LICENCES

# The base phrases and their labels.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
# Opening sentences of widespread licences and usual notices; whole licence texts beside them.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    *LICENCES,
)

#: Words, once A-Z are lower-cased: runs of digits, ASCII letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words a gram has; a phrase of two words has grams of two.
GRAM = 3
#: Share of a notice's grams that a merged span must hold, and the most its length may be of the notice's.
COVERAGE, STRETCH = 0.7, 1.5
#: Diagonals this near belong to one passage.
NEAR = 3
#: Grams of a template are bits of longs, so many to a long.
_BITS = 62


def words(phrase: str) -> list[str]:
    """The words of a template as the scan sees them."""
    low = "".join(c.lower() if c in _UPPER else c for c in phrase)
    return re.findall(WORD, low)


def grams(phrase: str) -> list[tuple]:
    """(position, w1, w2, w3) of a template's grams; w3 is None in a phrase of two words."""
    w = words(phrase)
    k = min(GRAM, len(w))
    if len(w) < 2:
        raise ValueError(f"a template has two words or more: {phrase!r}")
    return [(i, w[i], w[i + 1], w[i + 2] if k == GRAM else None) for i in range(len(w) - k + 1)]


def templates(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """A row for each gram of each template, of any length; the size is that of the lists given, not of the data."""
    rows = []
    for t, (label, phrase) in enumerate([*base, *notices]):
        g = grams(phrase)
        rows += [(t, label, t < len(base), len(g), len(words(phrase)), x[0] // _BITS, 1 << x[0] % _BITS, *x) for x in g]
    df = spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, n_words int, block int, bit long, at int, t1 string, t2 string, t3 string")
    return df.withColumn("hash", F.xxhash64("t1", "t2", "t3"))


def _words() -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))


def spans(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """Verified spans: key (md5 of the text), label, base, start, end (words), coverage (0 to 1).

    A base phrase counts where its words stand consecutively; a notice where neighbouring diagonals
    together hold COVERAGE of its grams. Equal texts have one key and one set of spans.
    """
    rows = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), _words().alias("w"))
    n = F.size("w")
    rolling = F.arrays_zip(F.col("w").alias("w1"), F.slice("w", F.lit(2), n).alias("w2"), F.slice("w", F.lit(3), n).alias("w3"))
    all_grams = rows.where(n > 1).select("key", F.posexplode(rolling).alias("pos", "g")).select("key", "pos", "g.*")
    # grams of three words; at the first words of templates of two words, those two as well (a null word adds nothing to a hash)
    three, two = F.xxhash64("w1", "w2", "w3"), F.xxhash64("w1", "w2")
    pairs = sorted({w[0] for w in map(words, (phrase for _, phrase in [*base, *notices])) if len(w) == 2})
    hashes = F.when(F.col("w1").isin(pairs), F.array_distinct(F.array(three, two))).otherwise(F.array(three)) if pairs else F.array(three)
    all_grams = all_grams.withColumn("hash", F.explode(hashes))
    # the hash finds, the words decide
    same = (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("t3").isNull() | (F.col("w3") == F.col("t3")))
    hits = all_grams.join(F.broadcast(templates(docs.sparkSession, base, notices)), "hash").where(same)
    of = ("key", "template", "label", "base", "n_grams", "n_words")
    # the positions on a diagonal are bits: copies of a text and merged diagonals add nothing twice
    votes = hits.groupBy(*of, (F.col("pos") - F.col("at")).alias("diagonal"), "block").agg(F.bit_or("bit").alias("bits"))
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    # blocks of one diagonal are one passage; a base phrase has one block, and each of its diagonals is a place
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > F.when(F.col("base"), 0).otherwise(NEAR)
    votes = votes.withColumn("passage", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = (F.col("diagonal") + F.col("block") * _BITS + f for f in (F.bit_count(F.expr("(bits & -bits) - 1")), F.length(F.bin("bits")) - 1))
    blocks = votes.groupBy(*of, "passage", "block").agg(F.bit_or("bits").alias("bits"), F.min(first).alias("start"), F.max(last).alias("last"))
    merged = blocks.groupBy(*of, "passage").agg(F.sum(F.bit_count("bits")).alias("held"), F.min("start").alias("start"), F.max("last").alias("last"))
    merged = merged.withColumn("coverage", F.col("held") / F.col("n_grams")).withColumn("end", F.col("last") + F.col("n_words") - F.col("n_grams") + 1)
    sound = (F.col("coverage") >= F.when(F.col("base"), 1.0).otherwise(COVERAGE)) & (F.col("end") - F.col("start") <= STRETCH * F.col("n_words"))
    return merged.where(sound).select("key", "label", "base", F.col("start").cast("long"), F.col("end").cast("long"), "coverage")


def scan(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Places and labels as in ``spans``; first_word and last_word are the smallest and largest start
    of a base place, null without one. score is the largest coverage of any span, 0 without one.
    Null and empty texts have no words. Of docs only doc_id and text are read.
    """
    found = spans(docs, base, notices)
    start, label = (F.when(F.col("base"), F.col(c)) for c in ("start", "label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_text = found.groupBy("key").agg(
        F.count_if("base").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        joined(label).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score"),
    )
    # computed apart, so that Spark may broadcast it or split a key that very many copies share
    per_text = broadcast_if_small(cut(per_text))
    text = F.coalesce("text", F.lit(""))
    n_words = F.regexp_count(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", F.md5(text).alias("key"), n_words.alias("n_words"))
    return rows.join(per_text, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
