"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a run of lines between blank lines. Its words are a set, and a template is found in it if at least PERCENT of the template's
distinct words are there. The join is exact: words are ordered by their frequency over all blocks, the rarest first; only
a template's prefix - as many of its rarest words as must hit in any block that qualifies - is looked up (prefix filter), blocks with fewer words than
the threshold needs are passed over (length filter), and so are those where too few words are left behind the first hit (positional
filter). What remains is verified on the full sets. Words that no template has can't change a containment, so blocks are kept as the template words they hold.

Only DataFrame expressions are used. The templates are a table of fixed size and are broadcast; the frequencies are counted map-side, one row a
template word.

Defined results: null and empty texts have no words and score 0. Repeated rows, and those without doc_id (which stays null), are scanned each on its own. A text of any length is scanned whole; one without blank
lines is one block. Where templates are contained equally well, score is their common value, and all their labels are given. An empty table gives none."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._native import let
from tessera.llm._tables import keep

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences by which licenses are granted, and their labels. Fixed values.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
PERCENT = 80

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK_LINE = r"\n[ \t\x0B\f\r]*\n"


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() also changes characters beyond ASCII, which stay beyond it but for the Kelvin sign; that is put aside first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def _spaces(x: Column) -> Column:
    return F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))


def _places(spaced: Column, phrase: str) -> Column:
    """n, first and last of the places of a phrase in ' word word ... '; word numbers from the counts of spaces before and after."""

    def found(parts: Column) -> Column:
        n = F.size(parts) - 1
        return F.struct(n.alias("n"), F.when(n > 0, _spaces(parts[0])).alias("first"), F.when(n > 0, _spaces(F.element_at(parts, -1))).alias("from_end"), F.when(n > 0, F.lit(PHRASES[phrase])).alias("label"))

    return let(F.split(spaced, f" (?={phrase} )", -1), found)


def need(words: int, percent: int) -> int:
    """Words of a template that a block must hold."""
    return ceil(words * percent / 100)


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs, and blocks: what was found, as template, block and containment."""
    templates = TEMPLATES if templates is None else templates
    sets = [sorted(set(t.split())) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    spark = docs.sparkSession
    low = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lowered(F.col("text").cast("string")).alias("low"))
    known = F.array(*[F.lit(w) for w in vocabulary])
    blocks = F.filter(F.transform(F.split("low", _BLANK_LINE, -1), lambda b, i: F.struct(i.alias("block"), F.array_intersect(F.split(b, _NOT_WORD, -1), known).alias("words"))), lambda b: F.size(b["words"]) > 0)
    likely = F.col("low").rlike("|".join(dict.fromkeys(p.split()[0] for p in PHRASES)))
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("from_end"), F.lit(None).cast("string").alias("label"))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", _NOT_WORD, " ")), F.lit(" "))
    base = F.when(likely, let(spaced, lambda s: F.array(*[_places(s, p) for p in PHRASES]))).otherwise(F.array(none))
    rows = low.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_count("low", F.lit(_WORD)).cast("bigint").alias("n_words"), base.alias("base"), blocks.alias("blocks"))
    rows = keep(rows, "blocks")
    block = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.words")
    frequency = {r.w: r.n for r in block.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row a template word
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    prefixes, full = [], []
    for t, s in enumerate(sets):
        ranks = sorted(order[w] for w in s)
        least = need(len(ranks), percent)
        full.append((t, templates[t][0], ranks, least))
        prefixes += [(ranks[p], t, p, len(ranks), least) for p in range(len(ranks) - least + 1)]
    prefix = spark.createDataFrame(prefixes or [(-1, -1, 0, 0, 1)], "word int, template int, place int, size int, least int")
    whole = spark.createDataFrame(full or [(-1, "", [], 1)], "template int, label string, ranks array<int>, least int")
    rank = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))]) if order else F.create_map(F.lit(""), F.lit(-1))
    wanted = F.array(*[F.lit(w) for w in sorted({w for w in vocabulary if any(order[w] == p[0] for p in prefixes)})]) if vocabulary else F.array(F.lit(""))
    ranked = block.where(F.arrays_overlap("words", wanted)).select("row", "block", F.array_sort(F.transform("words", lambda w: F.element_at(rank, w))).alias("ranks"))
    hits = ranked.select("row", "block", "ranks", F.posexplode("ranks").alias("at", "word")).join(F.broadcast(prefix), "word")
    hits = hits.where((F.size("ranks") >= F.col("least")) & (1 + F.least(F.col("size") - F.col("place") - 1, F.size("ranks") - F.col("at") - 1) >= F.col("least") - F.col("place")))  # hits before this place: `place` at most
    pairs = hits.groupBy("row", "block", "template").agg(F.first("ranks").alias("own"))
    verified = pairs.join(F.broadcast(whole), "template").withColumn("common", F.size(F.array_intersect("own", "ranks"))).where("common >= least")
    found = verified.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.size("ranks")).alias("best"), F.array_sort(F.collect_list(F.struct("block", "template", (F.col("common") / F.size("ranks")).alias("containment")))).alias("found"))
    places = F.col("base")
    n_base = F.aggregate(places, F.lit(0), lambda a, x: a + x["n"]).cast("bigint")
    labels = F.filter(F.array_distinct(F.transform(places, lambda x: x["label"])), lambda x: x.isNotNull())
    all_labels = F.array_distinct(F.concat(labels, F.coalesce("more", F.array().cast("array<string>"))))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform(places, lambda x: x["first"])).cast("bigint").alias("first_word"),
        (F.col("n_words") - F.array_min(F.transform(places, lambda x: x["from_end"]))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_labels), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("found", F.array().cast("array<struct<block:int,template:int,containment:double>>")).alias("blocks"),
    )
