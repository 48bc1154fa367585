"""License scan: exact phrases, and an exact set-similarity join of text blocks with license notices.

A block is a window of words, whatever lines they stand on: windows of twice ``step`` words begin at every ``step``-th word,
so that each run of up to ``step`` words is whole in one of them; a template, one license notice, is compared with the
windows of the smallest step that holds it. Both are sets of words. A block meets a template when it holds at least
``threshold`` of the template's words. The join finds every such pair:

* all template words are ordered by the number of documents that hold them, rarest first;
* prefix filter: a block that meets a template of n words, of which it needs k, holds one of the first n - k + 1;
* length filter: a block needs k words of the templates' vocabulary;
* positional filter: from the place of the first common word on, block and template must have k words left;
* what remains is compared exactly.

Everything runs in DataFrame functions. Texts are read twice, for the word counts and for the rest. The templates are a
argument, a list of any lengths that the driver holds, so their index is broadcast.

Defined results: a null or empty text has no words, no labels and score 0; very long texts are scanned whole; null ids are
kept; rows that repeat an id and a text each give the same row; words in equally many documents are ordered by text; an
empty table gives an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import Workspace, ascii_lower

#: Words that must stand consecutively, and the label they give.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: License notices in the words of their authors' usual statements, and the label they give.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program if not see", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("all rights reserved no part of this publication may be reproduced without permission", "all-rights-reserved"),
]
THRESHOLD = 0.8
#: Words between the starts of windows for the shortest templates, and how much longer the next ones are.
STEP, TIMES = 32, 4
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced_words(text: Column) -> Column:
    """The words of a text (case kept) with one space between them."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, " "))


def count_words(spaced: Column) -> Column:
    n_spaces = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(spaced == "", 0).otherwise(n_spaces + 1).cast("long")


def starts_of(words: Column, phrase: list[str]) -> Column:
    """Indices (from 0) at which the phrase's words stand consecutively."""

    def stands(i: Column) -> Column:
        fit = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            fit = fit & (F.get(words, i + k) == word)
        return fit

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)


def with_phrases(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, also: list[str] | None = None) -> DataFrame:
    """id, text_hash, n_words, n_base, first_word, last_word and base (sorted labels) of rows (id, text); and ``candidate``,
    the words of the texts that hold one of the words ``also``."""
    any_of = lambda terms: "(?i)(?:^| )(?:" + "|".join(terms) + ")(?: |$)" if terms else "(?!)"
    base = docs.select("id", F.xxhash64("text").alias("text_hash"), spaced_words(F.col("text")).alias("spaced"))
    held, wanted = F.col("spaced").rlike(any_of([p for p, _ in phrases])), F.col("spaced").rlike(any_of(also))
    words = F.split(ascii_lower(F.col("spaced")), " ")
    base = base.select("id", "text_hash", count_words(F.col("spaced")).alias("n_words"), F.when(held, words).alias("words"), F.when(wanted, words).alias("candidate"))
    empty = F.array().cast("array<int>")
    for k, (phrase, _) in enumerate(phrases):
        base = base.withColumn(f"at{k}", F.when(F.col("words").isNull(), empty).otherwise(starts_of(F.col("words"), phrase.split())))
    every = F.concat(*[F.col(f"at{k}") for k in range(len(phrases))])
    labels = F.array(*[F.when(F.size(f"at{k}") > 0, label) for k, (_, label) in enumerate(phrases)])
    return base.select(
        "id",
        "text_hash",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"),
        "candidate",
    )


def step_of(template: str) -> int:
    """The smallest step (32, 128, 512, ...) whose windows hold any run of as many words as the template has."""
    step = STEP
    while step < len(template.split()):
        step *= TIMES
    return step


def document_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many rows of (text) each word occurs, over all rows; one number for each word of the templates."""
    seen = F.array_intersect(F.split(F.lower(spaced_words(F.col("text"))), " "), F.array(*map(F.lit, words)))
    counts = docs.select(F.explode(seen).alias("word")).groupBy("word").count()
    return {row["word"]: row["count"] for row in counts.collect()}


def template_index(spark: SparkSession, order: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """One row for each template and word of its prefix; words are their places in the global order (from 1)."""
    place = {word: i for i, word in enumerate(order, 1)}
    rows = []
    for text, label in templates:
        words = sorted({place[w] for w in text.split()})
        need = math.ceil(threshold * len(words) - 1e-9)
        prefix = words[: len(words) - need + 1]
        rows += [(step_of(text), word, at, prefix, words, need, label) for at, word in enumerate(prefix, 1)]
    return spark.createDataFrame(rows, "step int, word int, at int, prefix array<int>, words array<int>, need int, label string")


def word_order(docs: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words, those in the fewest documents first."""
    vocabulary = sorted({w for text, _ in templates for w in text.split()})
    counts = document_frequencies(docs, vocabulary)
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def notice_labels(candidates: DataFrame, index: DataFrame, order: list[str]) -> DataFrame:
    """id, text_hash, found (labels) and containment (largest) of the rows (id, text_hash, candidate) with a block that
    meets a template of the index."""
    words_in_order = F.array(*map(F.lit, order))
    # Words become their places in the order, others 0.
    coded = candidates.filter("candidate IS NOT NULL").select("id", "text_hash", F.transform("candidate", lambda w: F.array_position(words_in_order, w).cast("int")).alias("codes"))
    steps = F.array(*[F.lit(s) for s in sorted({r["step"] for r in index.select("step").distinct().collect()})])
    stepped = coded.withColumn("step", F.explode(steps))
    start = F.sequence(F.lit(0), F.greatest(F.size("codes") - F.col("step") - 1, F.lit(0)), F.col("step"))
    windows = stepped.withColumn("start", F.explode(start))
    own = F.filter(F.slice("codes", F.col("start") + 1, 2 * F.col("step")), lambda c: c > 0)
    blocks = windows.select("id", "text_hash", "step", F.array_sort(F.array_distinct(own)).alias("block"))
    pairs = blocks.withColumn("word", F.explode("block")).join(F.broadcast(index), ["step", "word"])
    first_common = F.element_at(F.array_intersect("prefix", "block"), 1) == F.col("word")
    length_filter = F.size("block") >= F.col("need")
    left_in_both = F.least(F.size("words") - F.col("at"), F.size("block") - F.array_position("block", F.col("word")).cast("int")) + 1
    common = F.size(F.array_intersect("words", "block"))
    met = pairs.filter(length_filter & first_common & (left_in_both >= F.col("need"))).withColumn("common", common).filter(F.col("common") >= F.col("need"))
    return met.groupBy("id", "text_hash").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.size("words")).alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a phrase, else the
    largest containment of a template met, else 0)."""
    space = Workspace(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = word_order(own, templates)
    index = template_index(docs.sparkSession, order, templates, threshold)
    prefix_words = sorted({order[r["word"] - 1] for r in index.select("word").distinct().collect()})
    base = space.write(with_phrases(own, also=prefix_words), "license-candidates")
    found = notice_labels(base.select("id", "text_hash", "candidate"), index, order)
    found = found.select(F.col("id").alias("found_id"), F.col("text_hash").alias("found_hash"), "found", "containment")
    joined = base.drop("candidate").join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
