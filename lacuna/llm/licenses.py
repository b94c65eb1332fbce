"""License scans with a positional rare-token index, in DataFrame functions only.

Templates are short licence notices. Their words make the licence vocabulary, whose document frequencies are counted
over all documents. Of each template the `rare` words of the highest IDF have postings (word -> template, place), and
all places of these words in a file are looked up, whatever other notices it holds; places that agree (place in the
file - place in the template) are intersected by counting, for each template and shift, the template places that were
hit. A template is found where the places hit carry at least `least` of the IDF that its rare words have, and its
mandatory key phrases stand in the file.

Defined results: a null text counts as empty: no words, no labels, score 0; null doc_id and repeated rows are kept
row by row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

#: Phrases and labels of the contract.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Notices by label: (text, mandatory phrases).
TEMPLATES = {
    "apache": ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["under the apache license"]),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "general public license"]),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose"]),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license cc by 4 0", ["creative commons attribution"]),
    "cc0": ("the person who associated a work with this deed has dedicated the work to the public domain cc0", ["dedicated the work to the public domain"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    "copyright": ("all rights reserved no part of this publication may be reproduced without prior written permission", ["all rights reserved"]),
}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 12
LEAST = 0.6


def normal(text: Column) -> Column:
    """A blank, the words with a blank after each: A-Z lower-cased, all else that's ASCII and neither letter nor digit a blank."""
    # lower() also folds letters beyond ASCII, which are word characters before and after, but for the Kelvin sign,
    # which would become k, and the dotted I, which would become i and a dot.
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ĸ"))
    words = F.regexp_replace(F.lower(safe), NOT_WORD, " ")
    return F.concat(F.lit(" "), F.trim(words), F.when(F.trim(words) == "", F.lit("")).otherwise(F.lit(" ")))


def blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id, text (normalised) and n_words."""
    docs = docs.select("doc_id", normal(text_or_empty()).alias("text"))
    return docs.withColumn("n_words", F.greatest(blanks(F.col("text")) - 1, F.lit(0)).cast("long"))


#: Words of everyday text, which say nothing about a licence; fixed values.
STOP = "a all an and any are as at be but by can code file for form free from has have in into is it may met no not of on or other part person purpose source terms that the this to under use v version was who with without work you your".split()


def vocabulary(templates: dict) -> list[str]:
    return sorted({w for text, _ in templates.values() for w in text.split()} - set(STOP))


def frequencies(tokens: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each licence word stands, and at "" the number of documents; as long as the vocabulary."""
    listed = F.array(*map(F.lit, ["", *words]))  # a normalised text begins with a blank, so that "" is in each
    met = tokens.select(F.explode(F.array_intersect(listed, F.split("text", " "))).alias("word"))
    return {r["word"]: r["n"] for r in met.groupBy("word").agg(F.count("*").alias("n")).collect()}


def with_phrases(tokens: DataFrame, phrases=PHRASES) -> DataFrame:
    """Adds n_base, first_word, last_word and base (an array of labels)."""
    out = tokens
    for i, (phrase, _) in enumerate(phrases):
        seen = F.contains("text", F.lit(f" {phrase} "))
        out = out.withColumn(f"cut{i}", F.when(seen, F.split("text", f" {re.escape(phrase)}(?= )", -1)))
    long = lambda c: c.cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for i, (phrase, label) in enumerate(phrases):
        cut, size = F.col(f"cut{i}"), len(phrase.split())
        counts.append(long(F.when(cut.isNull(), 0).otherwise(F.size(cut) - 1)))
        firsts.append(long(blanks(cut[0])))
        lasts.append(F.col("n_words") - (blanks(F.element_at(cut, -1)) - 1) - size)
        labels.append(F.when(cut.isNotNull(), F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return out.select(
        "doc_id",
        "text",
        "n_words",
        total.alias("n_base"),
        F.least(*firsts).alias("first_word"),
        long(F.greatest(*lasts)).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    )


def scan(docs: DataFrame, templates: dict = TEMPLATES, phrases=PHRASES, rare: int = RARE, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (array), labels (array) and score for each document."""
    tokens = tokenized(docs)
    words = vocabulary(templates)
    seen = frequencies(tokens, words)
    idf = {w: math.log((seen.get("", 0) + 1) / (seen.get(w, 0) + 1)) + 1 for w in words}
    docs = with_phrases(tokens, phrases)
    names = sorted(templates)
    marks = F.lit(0)
    for i, name in enumerate(names):
        has = F.lit(True)
        for p in templates[name][1]:
            has = has & F.contains("text", F.lit(f" {p} "))
        marks = marks + F.when(has, F.lit(1 << i)).otherwise(F.lit(0))
    docs = docs.withColumn("phrases", marks).withColumn("row", F.monotonically_increasing_id())
    # Each template's rarest words, then all places that the file has of those whose template's phrases it holds.
    rarest = {name: sorted({w for w in templates[name][0].split() if w in idf}, key=lambda w: (-idf[w], w))[:rare] for name in names}
    docs = docs.withColumn("words", F.split("text", " "))
    looked = [F.when(F.col("phrases").bitwiseAND(F.lit(1 << i)) != 0, F.array(*map(F.lit, rarest[name]))).otherwise(F.array().cast("array<string>")) for i, name in enumerate(names)]
    docs = docs.withColumn("own", F.when(F.col("phrases") != 0, F.array_distinct(F.concat(*looked))).otherwise(F.array().cast("array<string>")))
    places = F.transform("words", lambda w, i: F.when(F.array_contains("own", w), F.struct(w.alias("word"), (i - 1).alias("at"))))
    places = F.when(F.size("own") > 0, F.array_compact(places))
    facts = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "phrases"]
    kept = docs.select(*facts, F.explode_outer(places).alias("x")).select(*facts, "x.word", "x.at")
    posts = [
        F.struct(F.lit(w).alias("word"), F.lit(i).alias("template"), F.lit(j).alias("place"), F.lit(idf[w]).alias("idf"))
        for i, name in enumerate(names)
        for j, w in enumerate(templates[name][0].split())
        if w in rarest[name]
    ]
    postings = docs.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*posts)).alias("p")).select("p.*")
    # As many rows as the templates have words: bounded by a parameter, not by data.
    met = kept.join(F.broadcast(postings), "word", "left")
    hits = met.groupBy(*facts, "template", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set(F.struct("word", "idf")).alias("words"))
    got = F.aggregate("words", F.lit(0.0), lambda a, x: a + F.coalesce(x["idf"], F.lit(0.0)))
    top = [sum(idf[w] for w in rarest[name]) for name in names]
    could = F.element_at(F.array(*map(F.lit, top)), F.col("template") + 1)
    share = F.least(F.lit(1.0), got / could)
    has = F.expr("phrases & shiftleft(1, template)") != 0
    best = hits.select("*", F.when(has & (share >= least), share).alias("share"))
    best = best.withColumn("label", F.when(F.col("share").isNotNull(), F.element_at(F.array(*map(F.lit, names)), F.col("template") + 1)))
    out = best.groupBy("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share")
    )
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base",
        F.array_sort(F.array_union("base", "more")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return scan(documents).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
