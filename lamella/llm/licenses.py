"""License scans: phrases, and an exact set-similarity join of text blocks against license templates.

A block is a window of words: for a template of m words (repeats counted) the windows start at every m-th word and hold
2 * m words, wherever lines end. So every stretch of m words of a text lies in a block, a template broken over lines
or behind comment signs too, while words scattered over a long text do not add up. A block's tokens are its distinct
words; it meets a template of its own m if at least THRESHOLD of the template's distinct words are in it. Tokens are
ordered by how many documents of the whole corpus hold them, rarest first. A block and a template that meet share a
token within both prefixes of that order, so only prefix tokens are joined; length and positional filters drop pairs
that cannot reach the threshold, and the rest is counted exactly.

Tokens outside all templates can never match, so blocks carry template tokens only, and only documents that hold
THRESHOLD of a template's words at all are cut into its blocks. The frequencies are counts over all documents, but of at
most as many tokens as the templates have. DataFrame functions only.

Defined results: null text counts as empty and has no words, places or labels; a document with a phrase scores 1, else
its best containment among templates met, else 0; of equal containments any gives that score, and every label met is
named; very long texts give one block to m words; repeated documents each get a row; extra columns are never read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
THRESHOLD = 0.8
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU license"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    low = text.translate(str.maketrans(_UPPER, _LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def template_tokens(text: str) -> list[str]:
    return list(dict.fromkeys(template_words(text)))


def least_shared(tokens: list, threshold: float) -> int:
    return max(1, math.ceil(threshold * len(tokens) - 1e-9))


def _plain(text: Column) -> Column:
    """Words with single blanks between them."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.btrim(F.regexp_replace(low, _SEPARATORS, " "))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _places(line: Column, words: Column, phrase: str) -> Column:
    """Word numbers at which phrase begins; the words are walked only where the text holds the phrase."""
    first, *rest = phrase.split(" ")

    def at(w, i):
        here = w == first
        for k, word in enumerate(rest, 1):
            here = here & (F.get(words, i + k) == word)
        return F.when(here, i)

    inside = F.concat(F.lit(" "), line, F.lit(" ")).contains(f" {phrase} ")
    found = F.filter(F.transform(words, at), lambda i: i.isNotNull())
    return F.when(inside, found).otherwise(F.array().cast("array<int>"))


def _blocks(words: Column, tokens: Column, vocabulary: list[str], templates, threshold: float) -> Column:
    """Blocks (m, tokens) of a document for the templates whose words it holds, those that can reach a threshold."""
    least: dict[int, int] = {}
    held: dict[int, Column] = {}
    for _, text in templates:
        mine = template_tokens(text)
        if not mine:
            continue
        m, needed = len(template_words(text)), least_shared(mine, threshold)
        least[m] = min(least.get(m, needed), needed)
        here = F.size(F.array_intersect(tokens, _strings(mine))) >= needed
        held[m] = held[m] | here if m in held else here

    def of(m: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - m, F.lit(1)), F.lit(m))
        cut = F.transform(starts, lambda s: F.array_intersect(F.slice(words, s, 2 * m), _strings(vocabulary)))
        enough = F.array_distinct(F.filter(cut, lambda t: F.size(t) >= least[m]))
        found = F.transform(enough, lambda t: F.struct(F.lit(m).alias("m"), t.alias("tokens")))
        return F.when(held[m], found).otherwise(F.array().cast("array<struct<m:int,tokens:array<string>>>"))

    return F.concat(*[of(m) for m in sorted(held)]) if held else F.array().cast("array<struct<m:int,tokens:array<string>>>")


def scanned(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One pass over the texts: counts, places, the template tokens of the document, and its blocks."""
    vocabulary = sorted({w for _, t in templates for w in template_tokens(t)})
    words = F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " "))
    held = docs.select(F.col("doc_id").cast("long"), "text", _plain(F.col("text")).alias("line")).select(
        "doc_id", "text", "line", words.alias("words")
    )
    shared = F.array_intersect("words", _strings(vocabulary))
    places = [_places(F.col("line"), F.col("words"), p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)]
    return (
        held.withColumn("tokens", shared)
        .select(
            "doc_id", F.xxhash64("text").alias("h"), F.size("words").cast("long").alias("n_words"), *places, "tokens",
            _blocks(F.col("words"), F.col("tokens"), vocabulary, templates, threshold).alias("blocks"),
        )
    )


def containment_join(blocks: DataFrame, counts: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """blocks (`m`, `tokens`: distinct words) to their other columns, label and containment, a row per template of m words met.

    counts holds the frequencies of template tokens; any order gives the same pairs, rarest first gives the fewest
    candidates.
    """
    spark = blocks.sparkSession
    token_lists = [template_tokens(t) for _, t in templates]
    order = sorted({w for t in token_lists for w in t}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    others = [c for c in blocks.columns if c not in ("m", "tokens")]
    values = []
    for (label, text), tokens in zip(templates, token_lists, strict=True):
        ranks, least = sorted(rank[w] for w in tokens), least_shared(tokens, threshold)
        for i, r in enumerate(ranks[: len(ranks) - least + 1]):
            values.append(f"({len(template_words(text))}, {r}, {i}, '{label}', {least}, array({', '.join(map(str, ranks))}))")
    if not values:
        return blocks.select(*others, F.lit("").alias("label"), F.lit(0.0).alias("containment")).where("false")
    prefixes = spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t(m, token, i, label, least, ranks)")
    smallest = min(least_shared(t, threshold) for t in token_lists if t)
    number = F.transform(
        F.array_intersect("tokens", _strings(order)), lambda w: (F.array_position(_strings(order), w) - 1).cast("int")
    )
    ranked = blocks.select(F.struct(*others).alias("of"), "m", F.array_sort(number).alias("mine"))
    short = F.slice("mine", 1, F.greatest(F.size("mine") - smallest + 1, F.lit(0)))
    own = ranked.where(F.size("mine") >= smallest).select("of", "m", "mine", F.posexplode(short).alias("j", "token"))
    reach = F.least("i", "j") + 1 + F.least(F.size("ranks") - F.col("i"), F.size("mine") - F.col("j")) - 1
    common = F.size(F.array_intersect("mine", "ranks"))
    return (
        own.join(F.broadcast(prefixes), ["m", "token"])  # a constant of the code: a row per prefix token of a template
        .where(F.size("mine") >= F.col("least"))  # length
        .where(reach >= F.col("least"))  # position
        .withColumn("common", common)
        .where(F.col("common") >= F.col("least"))  # verification
        .select("of.*", "label", (F.col("common") / F.size("ranks")).alias("containment"))
        .distinct()
    )


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = stored(scanned(docs, templates, threshold), "licenses")
    counts = {r.token: r["count"] for r in rows.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()}
    blocks = rows.where(F.size("blocks") > 0).select("doc_id", "h", F.inline("blocks")).distinct()
    met = (
        containment_join(blocks, counts, templates, threshold)
        .groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g"))
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    )
    base = rows.drop("tokens", "blocks")
    places = [F.col(f"p{i}") for i in range(len(PHRASES))]
    named = F.filter(F.array(*[F.when(F.size(p) > 0, label) for p, (_, label) in zip(places, PHRASES, strict=True)]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    n_base = sum((F.size(p) for p in places[1:]), F.size(places[0])).cast("long")
    return base.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.least(*[F.array_min(p) for p in places]).cast("long").alias("first_word"),
        F.greatest(*[F.array_max(p) for p in places]).cast("long").alias("last_word"),
        F.array_join(F.sort_array(named), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(named, F.coalesce("found", none))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
