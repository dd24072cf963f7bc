"""License scans by diagonal voting.

All rolling word k-grams of the documents are joined to the places where they stand in license
templates. Matches are counted by document, template and diagonal (place in the text less place in the
template), neighbouring diagonals are merged, and a span counts by the share of the template's words
that it covers with equal words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialise, text_of

GRAM = 4
#: Diagonals at most so far apart belong to one span (words put in or left out).
MERGE = 3
#: Least share of the template's words, and least number of them, in a verified span.
MIN_SHARE, MIN_WORDS = 0.6, 6
#: Templates with up to this many k-grams are looked up in place; more are joined by a shuffle of hashes.
FEW_GRAMS = 10_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base scan with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Wording of public licenses and notices, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced"),
]


def words_of(text: Column) -> Column:
    """Words of the license scan: ASCII letters in lower case, digits, and all other characters beyond ASCII."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, NO_WORD), "")


def grams_of(words: Column, seed: int | None = None, k: int = GRAM) -> Column:
    """Hashes of all k-grams, by their first word's place."""
    lead = [] if seed is None else [F.lit(seed)]
    return F.when(F.size(words) >= k, let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*lead, *[w[i + j] for j in range(k)])))).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``template``, ``label``, ``t_words`` and, for each place ``t_pos``, two hashes ``h`` and ``h2`` of the gram there."""
    rows = [(n, label, text) for n, (label, text) in enumerate(templates or TEMPLATES)]
    table = spark.createDataFrame(rows, "template int, label string, body string").select("template", "label", words_of(F.col("body")).alias("w"))
    both = F.arrays_zip(grams_of(F.col("w")).alias("h"), grams_of(F.col("w"), 1).alias("h2"))
    return table.select("template", "label", F.size("w").alias("t_words"), F.posexplode(both).alias("t_pos", "g")).select("template", "label", "t_words", "t_pos", "g.*")


def worded(docs: DataFrame, grams: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written row for each row of ``docs``: its number ``n``, ``doc_id``, ``n_words``, phrase places ``found`` and template grams ``hits``.

    Words are cut once and only grams that stand in some template are kept. While the templates have few
    grams these are picked out of the row's own; a larger table is joined by both hashes.
    """
    few = sorted({r.h for r in grams.select("h").limit(FEW_GRAMS + 1).collect()})
    cut = docs.select(docs[doc_id].cast("long").alias("doc_id"), words_of(text_of(docs, text)).alias("w"))
    w = F.col("w")
    base = [F.col("doc_id"), F.size(w).cast("long").alias("n_words"), base_places(w).alias("found")]
    if len(few) <= FEW_GRAMS:
        known = F.array(*[F.lit(x).cast("long") for x in few])
        second = lambda w, i: F.xxhash64(F.lit(1), *[F.get(w, i + j) for j in range(GRAM)])

        def picked(x: Column, some: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(x["h"]) - 1), lambda i: F.array_contains(some, x["h"][i]))
            return F.when(F.size(some) > 0, F.transform(at, lambda i: F.struct(i.alias("pos"), x["h"][i].alias("h"), second(x["w"], i).alias("h2"))))

        hits = let(F.struct(w.alias("w"), grams_of(w).alias("h")), lambda x: let(F.array_intersect(x["h"], known), lambda some: picked(x, some)))
    else:
        hits = F.transform(F.arrays_zip(grams_of(w).alias("h"), grams_of(w, 1).alias("h2")), lambda x, i: F.struct(i.alias("pos"), x["h"].alias("h"), x["h2"].alias("h2")))
    return materialise(cut.select(*base, hits.alias("hits")).withColumn("n", F.monotonically_increasing_id()), "worded")


def spans_of(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Verified spans of ``worded`` rows, by their number ``n``."""
    met = rows.select("n", F.explode("hits").alias("x")).select("n", "x.*").join(grams, ["h", "h2"])
    votes = met.groupBy("n", "template", "label", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("places"))
    along = Window.partitionBy("n", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > MERGE, F.lit(True))
    run = votes.withColumn("run", F.sum(apart.cast("int")).over(along))
    merged = run.groupBy("n", "template", "label", "t_words", "run").agg(F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + GRAM - 1)))))
    merged = merged.select("n", "template", "label", "first", "last", F.size("places").alias("votes"), covered.alias("covered"), (covered / F.col("t_words")).alias("share"))
    return merged.filter((F.col("share") >= MIN_SHARE) & (F.col("covered") >= F.least(F.lit(MIN_WORDS), F.round(F.col("covered") / F.col("share")))))


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified spans: ``doc_id``, ``template``, ``label``, ``first``, ``last``, ``votes``, ``share``.

    A null or empty text and one of under ``GRAM`` words has none; a template that stands twice in a
    text gives two spans. Each row, whatever its id, has spans of its own: repeated rows have them each.
    """
    grams = template_grams(docs.sparkSession, templates)
    rows = worded(docs, grams, doc_id, text)
    return spans_of(rows, grams).join(rows.select("n", "doc_id"), "n").drop("n")


def base_places(w: Column) -> Column:
    """Where each phrase stands in the words: an array of place and label."""

    def places(w: Column, phrase: str, label: str) -> Column:
        parts = phrase.split(" ")
        here = lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))
        fits = lambda i: F.forall(F.array(*[F.get(w, i + j) == p for j, p in enumerate(parts)]), lambda x: F.coalesce(x, F.lit(False)))
        at = F.filter(F.transform(w, lambda x, i: F.when(x == parts[0], i)), lambda i: i.isNotNull())
        return F.transform(F.filter(at, fits), here)

    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(F.array_contains(w, "license"), let(w, lambda x: F.concat(*[places(x, *p) for p in PHRASES]))).otherwise(none)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: words, phrase places, base labels, all labels and the best share.

    A null or empty text has 0 words, no labels (empty strings) and score 0. Rows that share an id, or
    have none, are judged each by its own text.
    """
    grams = template_grams(docs.sparkSession, templates)
    base = worded(docs, grams, doc_id, text)
    by_row = materialise(spans_of(base, grams).groupBy("n").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")), "license-spans")
    own = F.array_distinct(F.transform("found", lambda x: x["label"]))
    at = F.transform("found", lambda x: x["at"])
    joined = base.drop("hits").join(by_row, "n", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("found").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.sort_array(own), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("found") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
