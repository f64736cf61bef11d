"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Native: built-in SQL functions and joins only.

The join finds every block of text whose words contain at least ``containment`` of a template's distinct words.
A template of up to L words (L a power of two) is sought in blocks of 2 L words that begin every L words, so
that any stretch of L words lies whole in one of them. Words are ordered by their frequency over all texts, the
rarest first. For a template of n words, o = ceil(containment n) of them have to meet:

- prefix filter: one of the first n − o + 1 words of the template is among the first m − o + 1 of the block;
- length filter: a block has at least o words of templates;
- positional filter: where the first word they share is number i of the template and j of the block, at most
  1 + min(n − i − 1, m − j − 1) words can meet, which must reach o.

What is left is verified by the size of the intersection. Words that no template has cannot meet, so a block's set
holds only words of templates, m of them.

Rows: a null text is empty. Every row of the table gives one row, also one whose doc_id is null or repeated, and
texts of any length are cut into stretches of bounded size before blocks are compared. No rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import stored

# Phrases whose places are counted, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Opening sentences of well-known license notices, and the labels they stand for.
TEMPLATES = [
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "gpl"),
    ("You should have received a copy of the GNU Lesser General Public License along with this library", "lgpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "cc0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
]

CONTAINMENT = 0.8
#: Longest template in words, and the words of a stretch (a multiple of it) that is searched in one piece.
MOST_WORDS = 64
STRETCH = 4096
#: The vocabulary of all templates is a literal of the plan; more than this is refused.
MOST_TOKENS = 10_000

# ASCII letters and digits and everything beyond ASCII; texts are matched before A-Z are lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# lower() turns this letter, the only one beyond ASCII, into one of ASCII
_KELVIN, _STAND_IN = "K", "ĸ"


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    tokens: tuple[str, ...]
    words: int
    needed: int

    @property
    def block(self) -> int:
        """Blocks begin every so many words and are twice as long."""
        return max(4, 1 << (self.words - 1).bit_length())

    @property
    def prefix(self) -> int:
        return len(self.tokens) - self.needed + 1


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def compiled(templates: Sequence[tuple[str, str]], containment: float) -> list[Template]:
    out = []
    for number, (text, label) in enumerate(templates):
        words = _words(text)
        if not 0 < len(words) <= MOST_WORDS:
            raise ValueError(f"a template has 1 to {MOST_WORDS} words: {text!r}")
        tokens = tuple(dict.fromkeys(words))
        out.append(Template(number, label, tokens, len(words), max(1, math.ceil(round(containment * len(tokens), 9)))))
    if len({t for x in out for t in x.tokens}) > MOST_TOKENS:
        raise ValueError(f"templates have more than {MOST_TOKENS} different words")
    return out


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other; looked for only where its rarest word occurs at all."""
    parts = phrase.split(" ")
    here = lambda i: F.coalesce(_all([F.get(words, i + k) == p for k, p in enumerate(parts)]), F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    held = _all([F.array_contains(words, p) for p in reversed(parts)])
    return F.when(held, found).otherwise(F.array().cast("array<int>"))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _narrow(docs: DataFrame, phrases: Sequence[tuple[str, str]], vocabulary: Sequence[str]) -> DataFrame:
    """One row for each document without its text: a row key, base columns, and the stretches with the places of
    template words."""
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit(_KELVIN), F.lit(_STAND_IN)))
    cut = docs.select("doc_id", F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"))
    spots = lambda k: F.filter(
        F.transform(F.slice("words", k * STRETCH + 1, STRETCH + 2 * MOST_WORDS), lambda w, i: F.struct(i.alias("p"), w.alias("t"))),
        lambda s: s["t"].isin(list(vocabulary)),
    )
    last = F.greatest(F.expr(f"(size(words) - 1) div {STRETCH}"), F.lit(0).cast("long")).cast("int")
    places = {f"_p{k}": _places(F.col("words"), phrase) for k, (phrase, _) in enumerate(phrases)}
    found = cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.transform(F.sequence(F.lit(0), last), spots).alias("_stretches"),
        *[p.alias(name) for name, p in places.items()],
    )
    # rows get a number that is written with them, so later reads agree on it
    return found.select(F.monotonically_increasing_id().alias("_row"), "*")


def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(F.broadcast(right), list(on))


def matches(narrow: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(_row, label, share) of every block that contains enough of a template."""
    spark = narrow.sparkSession
    stretches = narrow.select("_row", F.posexplode("_stretches").alias("_stretch", "spots")).filter(F.size("spots") > 0)
    # the overlap of two stretches counts once
    own = stretches.select(F.explode(F.filter("spots", lambda s: s["p"] < STRETCH)).alias("s")).groupBy(F.col("s.t").alias("t")).agg(F.count("*").alias("n"))
    frequency = {r.t: r.n for r in own.collect()}  # one row for each word of the vocabulary at most
    vocabulary = sorted({t for x in templates for t in x.tokens}, key=lambda t: (frequency.get(t, 0), t))
    rank = {t: k for k, t in enumerate(vocabulary)}
    order = _literals(vocabulary)

    by_block: dict[int, list[Template]] = {}
    for x in templates:
        by_block.setdefault(x.block, []).append(x)
    found = None
    for length, some in sorted(by_block.items()):
        part = _blocks(stretches, length, some, rank, order)
        postings = _postings(spark, some, rank)
        hits = _join(part.select("_row", "ranks", F.posexplode("ranks").alias("j", "token")), postings, ["token"])
        size = F.size("ranks")
        prefix = F.col("j") <= size - F.col("needed")
        reach = 1 + F.least(F.size("tokens") - F.col("i") - 1, size - F.col("j") - 1) >= F.col("needed")
        shared = F.array_intersect("ranks", "tokens")
        # each pair is verified at its first shared word only
        part = hits.filter(prefix & reach).withColumn("_shared", shared).filter((F.get("_shared", F.lit(0)) == F.col("token")) & (F.size("_shared") >= F.col("needed")))
        part = part.select("_row", "label", (F.size("_shared") / F.size("tokens")).alias("share"))
        found = part if found is None else found.unionByName(part)
    return found


def _blocks(stretches: DataFrame, length: int, templates: Sequence[Template], rank: Mapping[str, int], order: Column) -> DataFrame:
    """(_row, ranks): the ordered word sets of the blocks that hold a prefix word of a template."""
    first = {t for x in templates for t in sorted(x.tokens, key=rank.__getitem__)[: x.prefix]}
    least = min(x.needed for x in templates)
    begins = lambda s: F.array(F.floor(s["p"] / length) - 1, F.floor(s["p"] / length))
    numbers = F.array_distinct(F.flatten(F.transform(F.filter("spots", lambda s: s["t"].isin(sorted(first))), begins)))
    # blocks that begin in the stretch; the first of a text may also begin before it, which adds nothing
    own = F.filter(numbers, lambda b: (b >= 0) & (b < STRETCH // length))
    inside = F.filter("spots", lambda s: (s["p"] >= F.col("block") * length) & (s["p"] < (F.col("block") + 2) * length))
    ranks = F.array_sort(F.transform(F.array_distinct(F.transform(inside, lambda s: s["t"])), lambda t: F.array_position(order, t).cast("int") - 1))
    return stretches.select("_row", "spots", F.explode(own).alias("block")).select("_row", ranks.alias("ranks")).filter(F.size("ranks") >= least)


def _postings(spark: SparkSession, templates: Sequence[Template], rank: Mapping[str, int]) -> DataFrame:
    """The prefix words of the templates: one row for each, so never more than their words."""
    rows = []
    for x in templates:
        tokens = sorted(rank[t] for t in x.tokens)
        listed = f"array({', '.join(map(str, tokens))})"
        label = x.label.replace("\\", "\\\\").replace("'", "\\'")
        rows += [f"struct({token} AS token, {i} AS i, {listed} AS tokens, {x.needed} AS needed, '{label}' AS label)" for i, token in enumerate(tokens[: x.prefix])]
    return spark.range(1).select(F.expr(f"inline(array({', '.join(rows)}))"))


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = tuple(PHRASES),
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Licenses named in each document.

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): the words of the text, all
    places of the phrases, the first and last word at which one begins, their labels, these and the labels of all
    templates found (sorted, joined by commas), and a score: 1 with a phrase, else the largest share of a
    template that a block contains, 0 without one.
    """
    chosen = compiled(templates, containment)
    vocabulary = sorted({t for x in chosen for t in x.tokens})
    narrow = stored(_narrow(docs, phrases, vocabulary))
    found = matches(narrow, chosen).groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_share"))
    places = [F.col(f"_p{k}") for k in range(len(phrases))]
    named = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, phrases, strict=True)]))
    base = F.array_distinct(named)
    every = F.array_distinct(F.concat(base, F.coalesce("_labels", F.array().cast("array<string>"))))
    return narrow.drop("_stretches").join(found, "_row", "left").select(
        "doc_id",
        "n_words",
        sum((F.size(p) for p in places), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.concat(*places)).cast("long").alias("first_word"),
        F.array_max(F.concat(*places)).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
