"""License statements by diagonal voting.

Templates and texts are sequences of words. Every window of k words of every text is
hashed and joined to the places where the same window stands in a template. A hit at
word i of the text and word j of the template lies on diagonal i - j, and a statement
that is quoted as it stands puts all its hits on one diagonal. Hits are counted by
diagonal; diagonals that lie close together are merged, since a word put in or left out
moves the rest to the next one; what is left is verified by the share of the template's
windows that the span holds.

Everything is built-in expressions: one pass explodes the windows, a hash join with the
templates (a fixed list of a few kilobytes) drops nearly all of them in the same stage, and
only hits are shuffled, pre-aggregated by text and template place.

Short phrases are templates too, with a share of one on a single diagonal: every place
where their words stand one after the other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textprov.llm.prints import let
from textprov.session import materialize

K = 2  # words of a window
SLACK = 3  # diagonals that may lie between two that are merged
SHARE = 0.6  # of a template's windows that a span must hold
REPEATS = 1 << 16  # equal rows listed at once

# Phrases that count wherever their words stand one after the other.
PHRASES: Mapping[str, str] = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Statements by which licences are usually given.
TEMPLATES: Mapping[str, str] = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms "
    "of the gnu general public license as published by the free software foundation": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy "
    "of the license at": "apache-notice",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "this work is licensed under a creative commons attribution 4 0 international "
    "license": "cc-by-4",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or "
    "without fee is hereby granted": "isc-notice",
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for a null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), 1)


def templates(
    spark: SparkSession, phrases: Mapping[str, str], statements: Mapping[str, str]
) -> DataFrame:
    """``gram, template, at, size, label, exact, first, second`` for each window of each template."""
    rows = []
    for number, (text, label) in enumerate([*phrases.items(), *statements.items()]):
        own = text.split()
        for at in range(len(own) - K + 1):
            rows.append((
                number, at, len(own) - K + 1, label, number < len(phrases), own[at], own[at + 1],
            ))
    df = spark.createDataFrame(
        rows, "template int, at int, size int, label string, exact boolean, first string, second string"
    )
    return df.withColumn("gram", F.xxhash64("first", "second"))


def hits(df: DataFrame, id: str, text: str, grams: DataFrame) -> DataFrame:
    """``id, key, n_words, template, at, size, label, exact, place`` of every window that stands in a template.

    Each text also has one row of null ``place``, so that no text is lost and equal rows
    can be counted. ``key`` tells texts of one id apart.
    """
    def windows(w: Column) -> Column:
        """The number of words and, for each window, its place, hash and words."""
        at = lambda i: F.struct(
            i.alias("place"), F.xxhash64(F.get(w, i), F.get(w, i + 1)).alias("gram"),
            F.get(w, i).alias("one"), F.get(w, i + 1).alias("two"),
        )
        listed = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0))), at)
        none = F.lit(None).cast("struct<place: int, gram: bigint, one: string, two: string>")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.when(F.size(w) >= K, F.concat(F.array(none), listed)).otherwise(F.array(none)).alias("windows"),
        )

    # A window takes only its own words along, so the work is in proportion to a text's length.
    own = df.select(
        F.col(id).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"),
        let(words(F.col(text)), windows).alias("x"),
    ).select("id", "key", F.col("x.n_words").alias("n_words"), F.explode("x.windows").alias("w"))
    every = own.select("id", "key", "n_words", "w.place", "w.gram", "w.one", "w.two")
    met = every.join(F.broadcast(grams), "gram", "left").where(
        F.col("template").isNotNull() | F.col("place").isNull()
    )
    # The words themselves decide, not their hash.
    same = F.coalesce((F.col("one") == F.col("first")) & (F.col("two") == F.col("second")), F.lit(False))
    return met.select(
        "id", "key", "n_words",
        *[F.when(same, F.col(c)).alias(c) for c in ("template", "at", "size", "label", "exact")],
        F.col("place").cast("long").alias("place"),
    )


def spans(
    found: DataFrame, slack: int = SLACK, share: float = SHARE
) -> DataFrame:
    """``id, key, template, label, exact, start, stop, score`` of verified spans.

    Votes are counted by diagonal. Phrases need all their windows on one diagonal.
    Diagonals of other templates are merged over gaps of up to ``slack``; a span's score
    is the share of distinct template windows among its hits.
    """
    votes = (
        found.where("template is not null")
        .withColumn("diagonal", F.col("place") - F.col("at"))
        .groupBy("id", "key", "template", "label", "exact", "size", "diagonal")
        .agg(
            F.collect_set("at").alias("held"),  # at most as many as the template has words
            F.min("place").alias("start"), F.max("place").alias("last"),
        )
    )
    by = ["id", "key", "template"]
    order = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order)
    new = F.col("exact") | apart.isNull() | (apart > slack)
    marked = votes.withColumn("group", F.sum(new.cast("int")).over(order))
    merged = (
        marked.groupBy(*by, "label", "exact", "size", "group")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n"),
            F.max(F.size("held")).alias("best"),
            F.min("start").alias("start"), F.max("last").alias("last"),
        )
        # Spans that grew together over many diagonals count by their best one.
        .withColumn("n", F.expr("if(last - start < 2 * size, n, best)"))
        .withColumn("score", F.col("n") / F.col("size"))
    )
    whole = F.col("n") == F.col("size")
    return merged.where(whole | (~F.col("exact") & (F.col("score") >= share))).select(
        *by, "label", "exact", "start", (F.col("last") + K).alias("stop"), "score"
    )


def scan_licenses(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    statements: Mapping[str, str] = TEMPLATES,
    each_row: bool = False,
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every text.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the
    least and greatest word at which one starts, ``base_labels`` names them; ``labels``
    adds what the statements give, and ``score`` is the best share of a template found.
    Phrases and statements need at least two words.

    Defined results: a null or empty text has no words, no labels, null places and score
    0; rows equal in id and text are one document, or with ``each_row`` one each; null ids are kept; other columns are
    not looked at; an empty table gives an empty result. Time is in proportion to a text's words.
    """
    grams = templates(df.sparkSession, phrases, statements)
    found = materialize(hits(df, id, text, grams), "hits")
    base = lambda c: F.when(F.col("exact"), F.col(c))
    named = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    verified = (
        spans(found)
        .groupBy("id", "key")
        .agg(
            F.count(base("start")).alias("n_base"),
            F.min(base("start")).alias("first_word"), F.max(base("start")).alias("last_word"),
            named(base("label")).alias("base_labels"), named(F.col("label")).alias("labels"),
            F.max("score").alias("score"),
        )
        .withColumnsRenamed({"id": "_id", "key": "_key"})
    )
    rows = found.groupBy("id", "key").agg(
        F.first("n_words").alias("n_words"), F.count(F.when(F.col("place").isNull(), 1)).alias("rows")
    )
    same = (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    out = rows.join(verified, same, "left")
    if each_row:  # in two steps, so that no list is longer than REPEATS
        start = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(REPEATS).cast("long")))
        out = out.withColumn("from", start)
        upto = F.least(F.col("rows"), F.col("from") + (REPEATS - 1))
        out = out.withColumn("row", F.explode(F.sequence("from", upto)))
    return out.select(
        F.col("id").alias(id),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
