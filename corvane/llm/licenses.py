"""License scans by an exact set-similarity join. Built-in functions only."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, tune, whole_text

#: Phrases whose places are counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: License texts that blocks of words are held against, with their
#: labels: lines that name a license, notices, and bodies of short licenses.
TEXTS = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    ),
]
#: Everything that is not part of a word, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Templates and their different words, at most: they are part of the plan and are broadcast.
MOST_TEMPLATES, MOST_WORDS = 200, 20_000


def words_of(text: str) -> list[str]:
    """The words of a text, as the scan sees them."""
    return re.sub(BETWEEN, " ", text.translate(str.maketrans(UPPER, LOWER))).split()


TEMPLATES = [(label, " ".join(words_of(text))) for label, text in TEXTS]


def spaced(text: Column) -> Column:
    """The words of a text, each with a space before it and the last with one after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def base_columns(words: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """Places where a phrase's words stand consecutively, from spaced words.

    The text is cut before each place; what stands before the first one and from
    the last one on tells their word numbers.
    """
    n_words = F.when(words == "  ", F.lit(0)).otherwise(_spaces(words) - 1).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        cut = F.split(words, f"(?<= )(?={re.escape(phrase)} )", -1)
        there = F.contains(words, F.lit(f" {phrase} "))
        counts.append(F.when(there, F.size(cut) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(there, _spaces(F.element_at(cut, 1)) - 1))
        lasts.append(F.when(there, n_words - _spaces(F.element_at(cut, -1))))
        labels.append(F.when(there, F.lit(label)))
    one = len(phrases) == 1
    return {
        "n_words": n_words,
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": (firsts[0] if one else F.least(*firsts)).cast("long"),
        "last_word": (lasts[0] if one else F.greatest(*lasts)).cast("long"),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


@dataclass(frozen=True)
class Template:
    """A license text as a set of words, and the blocks it is held against.

    A block is a quarter longer than the text, and blocks begin so densely that
    any run of the text's length lies in one of them. ``must`` are the words
    that set the text apart from similar ones of other labels, ``without`` the
    words that would make it one of them, and ``own`` words that no other text
    of another label has, of which one must stand.
    """

    label: str
    tokens: frozenset[str]
    need: int
    length: int
    step: int
    must: frozenset[str]
    without: frozenset[str]
    own: frozenset[str]


def prepared(templates: list[tuple[str, str]], threshold: float) -> list[Template]:
    """Templates from labels and spaced lower-case words."""
    if not templates or len(templates) > MOST_TEMPLATES or len({w for _, t in templates for w in t.split()}) > MOST_WORDS:
        raise ValueError(f"a scan takes 1 to {MOST_TEMPLATES} templates with at most {MOST_WORDS} words")
    out = []
    for label, text in templates:
        words = text.split()
        tokens = frozenset(words)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        must, without, own = set(), set(), set(tokens)
        for other_label, other in templates:
            others = set(other.split())
            if other_label != label and len(tokens & others) >= need:
                must |= tokens - others
                if len(others - tokens) <= len(tokens) // 2:
                    without |= others - tokens
            elif other_label != label:
                own -= others
        length = math.ceil(1.25 * len(words))
        out.append(Template(label, tokens, need, length, length - len(words) + 1, frozenset(must), frozenset(without), frozenset(own)))
    return out


def containments(held: DataFrame, templates: list[Template], vocabulary: list[str], frequency: dict[int, int]) -> DataFrame:
    """Rows (row, start, template, label, containment) of every block of words
    that contains a template.

    ``held`` has ``row``, ``pairs`` (places and numbers of known words) and
    ``lengths`` (the block lengths to look into). Words outside all templates
    change no overlap and are left out of the blocks' sets; the others are
    numbered by how many documents of the whole corpus have them, rarest first.
    Two sets that overlap enough share a word among their rarest ones (prefix
    filter); the block must have as many words as are needed (length filter),
    and the words from the shared one onward must suffice (positional filter).
    The pairs left are counted exactly.
    """
    spark = held.sparkSession
    order = sorted(range(len(vocabulary)), key=lambda i: (frequency.get(i, 0), vocabulary[i]))
    rank = {word: place for place, word in enumerate(order)}
    number = {vocabulary[i]: rank[i] for i in range(len(vocabulary))}
    numbers = lambda words: sorted(number[w] for w in words)
    rows = []
    for k, t in enumerate(templates):
        tokens = numbers(t.tokens)
        for place, token in enumerate(tokens[: len(tokens) - t.need + 1]):
            rows.append((t.length, token, k, t.label, place, len(tokens), t.need, tokens, numbers(t.must), numbers(t.without), numbers(t.own)))
    index = spark.createDataFrame(rows, "of int, token int, template int, label string, place int, tokens_t int, need int, all_t array<int>, must array<int>, without array<int>, own array<int>")

    ranks = F.array(*[F.lit(rank[i]) for i in range(len(vocabulary))])
    steps = {t.length: t.step for t in templates}
    least = {length: min(t.need for t in templates if t.length == length) for length in steps}
    by_length = lambda of, of_length: F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), of_length)
    placed = held.select("row", "pairs", F.explode("lengths").alias("length")).select("row", "length", by_length(steps, F.col("length")).alias("step"), F.inline("pairs"))
    first = F.greatest(F.ceil((F.col("at") - F.col("length") + 1) / F.col("step")), F.lit(0)).cast("long")
    blocks = placed.select("row", "length", "token", "step", F.explode(F.sequence(first, F.floor(F.col("at") / F.col("step")).cast("long"))).alias("block"))
    blocks = blocks.select("row", "length", "token", (F.col("block") * F.col("step")).alias("start"))
    # a block has at most as many words as its length
    sets = blocks.groupBy("row", "length", "start").agg(F.array_sort(F.collect_set(F.element_at(ranks, F.col("token") + 1))).alias("all_b"))
    sets = sets.where(F.size("all_b") >= by_length(least, F.col("length")))
    prefixes = sets.select("row", "length", "start", "all_b", F.posexplode(F.slice("all_b", F.lit(1), F.size("all_b") - by_length(least, F.col("length")) + 1)).alias("at", "token"))
    pairs = prefixes.join(F.broadcast(index), (F.col("length") == F.col("of")) & (prefixes["token"] == index["token"])).where(
        (F.size("all_b") >= F.col("need")) & (F.least(F.col("tokens_t") - F.col("place"), F.size("all_b") - F.col("at")) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("all_b", "all_t"))
    right = (overlap >= F.col("need")) & (F.size(F.array_except("must", "all_b")) == 0) & ~F.arrays_overlap("without", "all_b") & ((F.size("own") == 0) | F.arrays_overlap("own", "all_b"))
    return pairs.where(right).select("row", "start", "template", "label", (overlap / F.col("tokens_t")).alias("containment")).distinct()


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """License phrases and license-like blocks of every text.

    Returns ``doc_id``, ``n_words``, ``n_base`` (places where a phrase's words
    stand consecutively, overlapping ones too), ``first_word`` and ``last_word``
    (smallest and largest start of those, or null), ``base_labels``, ``labels``
    (those and the labels of all templates that a block of about their length
    contains at ``threshold``, with the words that set them apart from other
    labels) and ``score`` (1 where a phrase stands, else the best containment,
    else 0), one row for each row of ``docs``.

    The texts are read once: base columns, the known words of each text, and,
    where those suffice for a template, their places are written to the shared
    folder, and everything else is joined there by row.

    A null text counts as empty and has no words; a null id stays null; rows
    that share an id keep their own labels; texts are taken whole however long;
    columns beside ``doc_id`` and ``text`` are ignored; an empty table gives an
    empty result. More than 200 templates or 20,000 different words in them are
    refused.
    """
    tune(docs.sparkSession)
    ready = prepared(templates or TEMPLATES, threshold)
    vocabulary = sorted({w for t in ready for w in t.tokens})
    number = {w: i for i, w in enumerate(vocabulary)}
    known = F.array(*[F.lit(w) for w in vocabulary])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(whole_text()).alias("words"))
    split = texts.select("*", F.split("words", " ").alias("list")).select("*", F.array_intersect("list", known).alias("some"))
    enough = F.array_compact(
        F.array(*[F.when(F.size(F.array_intersect("some", F.array(*[F.lit(w) for w in sorted(t.tokens)]))) >= t.need, F.lit(t.length)) for t in ready])
    )
    numbered = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    # the first and the last element of the list stand outside the spaces and are empty
    places = F.filter(F.transform("list", lambda w, i: F.struct((i - 1).alias("at"), F.when(F.array_contains("some", w), numbered[w]).alias("token"))), lambda p: p["token"].isNotNull())
    nothing = F.array().cast("array<struct<at:int,token:int>>")
    scanned = split.select("*", F.array_distinct(enough).alias("lengths")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *[c.alias(k) for k, c in base_columns(F.col("words"), phrases or PHRASES).items()],
        F.transform("some", lambda w: numbered[w]).alias("known"), "lengths", F.when(F.size("lengths") > 0, places).otherwise(nothing).alias("pairs"),
    )
    scanned = stash(scanned, "words")
    counted = scanned.select(F.explode("known").alias("word")).groupBy("word").count().collect()  # a row a template word
    found = containments(scanned.where(F.size("lengths") > 0), ready, vocabulary, {r["word"]: r["count"] for r in counted})
    found = stash(found.groupBy(F.col("row").alias("of")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")), "licenses")
    joined = scanned.join(found, F.col("row") == F.col("of"), "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
