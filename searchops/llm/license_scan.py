"""License scans: an exact set-similarity join of text blocks with license templates, in native Spark.

One pass over the documents counts the templates' words in all texts. A second keeps, of every whole text, its word
count and, where a phrase or a word of some template's prefix occurs, the places of words that a phrase or template has. All else
works on that slim table:

* base places: consecutive words of a phrase, found by comparing the kept places with those shifted by one;
* blocks: a template of ``w`` words has blocks of ``2 * b`` words that start at every ``b``-th word, where ``b`` is the least
  power of two that is not under ``w``; so any span of at most ``b`` words lies whole in some block. A block is the set of its words that a
  template with blocks of this size has;
* words are ordered by their frequency over all documents, the rarest first. A template of ``n`` distinct words and a block
  of ``m`` match if they share ``need = ceil(n * threshold)``. Before anything is counted, a block must have ``need`` words at
  all (length filter); the two must share a word that is among the first ``n - need + 1`` of the template and
  the first ``m - need + 1`` of the block (prefix filter), the only words that are joined; and from its place in both lists enough
  words must be left in each (positional filter). The pairs that are left are verified by counting.

Defined results: a null text counts as empty; a document without places has nulls and empty labels; repeated
rows and null ids each give their own row; words of equal frequency are ordered by name; a table without rows gives none; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Templates of the method: what grants and notices of each license say.
TEMPLATES = {
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    ),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",),
    "apache": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",),
}
THRESHOLD = 0.9
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _texts() -> list[tuple[str, list[str]]]:
    return [(label, text.split()) for label, many in TEMPLATES.items() for text in many]


def block_step(words: int) -> int:
    """The least power of two that is not under the number of words."""
    return 1 << max(0, words - 1).bit_length()


def vocabulary() -> list[str]:
    return sorted({w for p in PHRASES for w in p.split()} | {w for _, words in _texts() for w in words})


def _spaced(docs: DataFrame) -> DataFrame:
    """doc_id and the words of each text between single spaces, one in front and one behind.

    Lower-casing all letters changes only words that no phrase has, but for the two characters that
    would turn into ASCII letters; texts with these are lower-cased on A-Z alone.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.when(text.rlike("[\u212A\u0130]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    docs = docs.select(F.col("doc_id").cast("long"), F.btrim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")).alias("words"))
    return docs.select("doc_id", F.when(F.col("words") == "", " ").otherwise(F.concat(F.lit(" "), "words", F.lit(" "))).alias("spaced"))


def frequencies(spaced: DataFrame) -> dict[str, int]:
    """How often each word of the vocabulary occurs in all texts; at most one row for each of these words."""
    words = spaced.select(F.explode(F.split("spaced", " ")).alias("word")).where(F.col("word").isin(vocabulary()))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}


def ranked_templates(frequency: dict[str, int], threshold: float) -> list[tuple[int, str, int, int, list[str]]]:
    """template, label, step, need, words of each template: its distinct words, rarest first."""
    order = lambda w: (frequency.get(w, 0), w)
    return [(k, label, block_step(len(words)), math.ceil(len(set(words)) * threshold), sorted(set(words), key=order)) for k, (label, words) in enumerate(_texts())]


def _places(docs: DataFrame, templates: list[tuple]) -> DataFrame:
    """row, doc_id, n_words and, of texts with a phrase or a word of some template's prefix, hits:
    (place, word) of the words that a phrase or template has."""
    prefix = sorted({w for *_, need, words in templates for w in words[: len(words) - need + 1]})
    rows = _spaced(docs).select("doc_id", "spaced", F.split(F.btrim("spaced"), " ").alias("words"))
    near = F.arrays_overlap("words", F.array(*map(F.lit, prefix)))
    for phrase in PHRASES:
        near = near | F.col("spaced").contains(f" {phrase} ")
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda h: h["word"].isin(*vocabulary()))
    return rows.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.when(F.trim("spaced") == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.when(near, hits).otherwise(F.array().cast("array<struct<place:int,word:string>>")).alias("hits"),
    )


def _starts(phrase: str) -> Column:
    """Starts of a phrase among ``hits``, whose places rise: the next kept words must follow at once."""
    words = phrase.split()

    def here(h: Column, i: Column) -> Column:
        ok = h["word"] == words[0]
        for k, w in enumerate(words[1:], 1):
            nxt = F.try_element_at("hits", i + F.lit(k + 1))
            ok = ok & F.coalesce((nxt["word"] == w) & (nxt["place"] == h["place"] + k), F.lit(False))
        return ok

    return F.transform(F.filter("hits", here), lambda h: h["place"])


def _blocks(rows: DataFrame, templates: list[tuple], frequency: dict[str, int]) -> DataFrame:
    """row, step, block, words: the distinct words of every block, rarest first; of blocks that are long enough for some template."""
    spark = rows.sparkSession
    steps = {step: min(t[3] for t in templates if t[2] == step) for step in {t[2] for t in templates}}
    order = {w: i for i, w in enumerate(sorted(vocabulary(), key=lambda w: (frequency.get(w, 0), w)))}
    known = spark.createDataFrame(sorted({(w, t[2], order[w]) for t in templates for w in t[4]}), "word string, step int, place_in_order int")  # constant
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.place", "h.word").join(F.broadcast(known), "word")
    first = F.floor(F.col("place") / F.col("step")).cast("int")
    tokens = hits.select("row", "step", F.explode(F.array_distinct(F.array(first, F.greatest(F.lit(0), first - 1)))).alias("block"), F.struct("place_in_order", "word").alias("w"))
    blocks = tokens.groupBy("row", "step", "block").agg(F.array_sort(F.collect_set("w")).alias("w"))  # at most the vocabulary
    enough = F.coalesce(*(F.when(F.col("step") == step, need) for step, need in steps.items()))
    return blocks.where(F.size("w") >= enough).select("row", "step", "block", F.transform("w", lambda x: x["word"]).alias("words"))


def _candidates(blocks: DataFrame, templates: list[tuple]) -> DataFrame:
    """(row, step, block, words, template) of blocks and templates that pass all three filters; each pair once."""
    prefixes = [(t, label, step, need, len(words), i, w) for t, label, step, need, words in templates for i, w in enumerate(words[: len(words) - need + 1])]
    prefixes = blocks.sparkSession.createDataFrame(prefixes, "template int, label string, step int, need int, n int, i int, word string")  # constant
    met = blocks.select("*", F.size("words").alias("m"), F.posexplode("words").alias("j", "word")).join(F.broadcast(prefixes), ["step", "word"])
    length = F.col("m") >= F.col("need")
    prefix = F.col("j") <= F.col("m") - F.col("need")
    positional = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= F.col("need")
    return met.where(length & prefix & positional).groupBy("row", "step", "block", "template", "label", "need", "n").agg(F.first("words").alias("words"))


def _matches(rows: DataFrame, templates: list[tuple], frequency: dict[str, int]) -> DataFrame:
    """row, label, containment of every (block, template) that meets the threshold."""
    full = rows.sparkSession.createDataFrame([(t, words) for t, *_, words in templates], "template int, all array<string>")  # constant
    pairs = _candidates(_blocks(rows, templates, frequency), templates).join(F.broadcast(full), "template")
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("words", "all")))
    return pairs.where("overlap >= need").select("row", "label", (F.col("overlap") / F.col("n")).alias("containment"))


def license_places(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    frequency = frequencies(_spaced(docs))
    templates = ranked_templates(frequency, threshold)
    rows = keep(_places(docs, templates), "words")
    starts = {p: _starts(p) for p in PHRASES}
    base = rows.select(
        "row",
        "doc_id",
        "n_words",
        F.concat(*starts.values()).alias("starts"),
        F.array_compact(F.array(*(F.when(F.size(s) > 0, F.lit(PHRASES[p])) for p, s in starts.items()))).alias("base"),
    )
    found = _matches(rows, templates, frequency).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", empty)))
    return base.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.when(F.size("starts") > 0, F.lit(1.0)), "containment", F.lit(0.0)).alias("score"),
    )
