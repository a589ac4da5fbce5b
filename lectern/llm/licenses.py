"""License scan by diagonal voting. DataFrame functions only.

A text's words are the runs of `WORD` after lower-casing A-Z. All its rolling three-word hashes join the hashes of
the templates (hash and words must agree); a hit votes for the diagonal of its text position minus its template
position. Neighbouring diagonals of a template, at most `GAP` apart, are merged, so that words put in or left out
don't split a notice; a merged group is a span if the template words that its hits cover are `COVERAGE` of the
template or more. Of overlapping spans those with the best coverage stay. The base phrases are templates too: a place
of a phrase is a diagonal with a vote for each of its grams, and always stays.

The templates are a short list given by the caller; their table is broadcast, and its size is checked.

Defined results: null and empty text has no words and no labels, score 0; repeated rows give repeated results; of
overlapping spans with equal coverage all stay. Empty tables give no rows. Only doc_id and text are read; rows are
told apart by a row number of the one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM, GAP, COVERAGE = 3, 3, 0.75
MOST_TEMPLATE_WORDS = 200_000

# The phrases and labels of the base scan.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Opening sentences and usual short notices of common licenses.
TEMPLATES = (
    ("agpl-3", "licensed under the GNU Affero General Public License version 3"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                 "compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work"),
    ("gpl-2", "licensed under the GNU General Public License version 2"),
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
              "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _grams(words: str) -> Column:
    """The word at each position with its two followers; null past the end."""
    size = F.size(words)
    return F.arrays_zip(F.col(words).alias("w0"), F.slice(words, 2, F.greatest(size, F.lit(1))).alias("w1"),
                        F.slice(words, 3, F.greatest(size, F.lit(1))).alias("w2"))


def template_grams(spark: SparkSession, templates, phrases) -> DataFrame:
    """hash, w0-w2, template, place in it, its numbers of grams and words, label, whether it is a base phrase."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"),
                     F.lit(i < len(phrases)).alias("base"))
            for i, (label, text) in enumerate((*phrases, *templates))]
    if sum(len(text.split()) for _, text in (*phrases, *templates)) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of over {MOST_TEMPLATE_WORDS} words are too large to broadcast")
    table_ = spark.range(1).select(F.inline(F.array(*rows))).withColumn("words", words_of(F.col("text")))
    return table_.select("template", "label", "base", F.size("words").alias("length"),
                         F.posexplode(_grams("words")).alias("place", "g")).where("g.w2 is not null").select(
        F.xxhash64("g.w0", "g.w1", "g.w2").alias("hash"), F.col("g.w0").alias("t0"), F.col("g.w1").alias("t1"),
        F.col("g.w2").alias("t2"), "template", "label", "base", "length", "place")


def diagonals(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per row, template and diagonal: the template places that voted. Every row of docs also has an entry without a
    template, whatever it holds."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    grams = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"),
                        F.posexplode_outer(_grams("words")).alias("pos", "g"))
    grams = grams.select("row", "doc_id", "n_words", "pos", F.col("g.w0").alias("w0"), F.col("g.w1").alias("w1"),
                         F.col("g.w2").alias("w2"), F.xxhash64("g.w0", "g.w1", "g.w2").alias("hash"))
    known = F.broadcast(template_grams(docs.sparkSession, templates, phrases))
    hits = grams.join(known, "hash", "left").where(
        F.col("template").isNull() | ((F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
                                      & (F.col("w2") == F.col("t2"))))
    # without a hit only the first position is needed, so that no document is lost; a document whose first position
    # has a hit has an entry by that
    hits = hits.where("template is not null or pos is null or pos = 0")
    return hits.groupBy("row", "doc_id", "n_words", "template", "label", "base", "length",
                        (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_list("place").alias("places"))


def spans_of(found: DataFrame) -> DataFrame:
    """row, label, base, first, last (word after the span), coverage."""
    base = found.where(F.col("base") & (F.size("places") == F.col("length") - (GRAM - 1))).select(
        "row", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length")).alias("last"),
        F.lit(1.0).alias("coverage"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > GAP).cast("int"), F.lit(0))
    merged = (found.where(~F.col("base")).withColumn("apart", apart)
              .withColumn("group", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("row", "template", "label", "base", "length", "group")
              .agg(F.flatten(F.collect_list("places")).alias("places"),
                   F.min(F.col("diagonal") + F.array_min("places")).alias("first"),
                   F.max(F.col("diagonal") + F.array_max("places") + GRAM).alias("last")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (GRAM - 1))))))
    spans = merged.withColumn("coverage", covered / F.col("length")).where(
        (F.col("coverage") >= COVERAGE) & (F.col("last") - F.col("first") <= 2 * F.col("length")))
    both = base.union(spans.select("row", "label", "base", "first", "last", "coverage"))
    better = F.filter("all", lambda s: s["base"] | ~F.exists(
        "all", lambda o: (o["coverage"] > s["coverage"]) & (o["first"] < s["last"]) & (s["first"] < o["last"])))
    return (both.groupBy("row").agg(F.collect_list(F.struct("label", "base", "first", "last", "coverage")).alias("all"))
            .select("row", F.inline(better)))


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:first:last)."""
    found = stored(diagonals(docs, templates, phrases), "diagonals")
    spans = spans_of(found.where("template is not null"))
    texts = found.select("row", "doc_id", "n_words").distinct()
    everything = texts.withColumns({
        "label": F.lit(None).cast("string"), "base": F.lit(False), "first": F.lit(None).cast("int"),
        "last": F.lit(None).cast("int"), "coverage": F.lit(0.0)}).unionByName(spans, allowMissingColumns=True)

    def joined(values: Column) -> Column:
        return F.array_join(F.array_sort(values), ",")

    text = F.concat_ws(":", "label", "first", "last")
    return everything.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"), F.max("coverage").alias("score"),
        joined(F.collect_set(F.when(F.col("label").isNotNull(), text))).alias("spans")).drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in every document."""
    return scanned(table(spark, sf_dir, "documents"))
