"""License scans: phrases, and an exact containment join of text blocks with license templates. Native throughout.

A template of L words is sought in blocks of 2 L consecutive words, one block beginning at every L-th word; so a notice
is found whole in a block wherever it begins and however its lines are wrapped. A block matches if it holds at least
THRESHOLD percent of the template's distinct words. Template words are ordered by the number of documents that hold them,
rarest first. A matching block holds one of the template's first size - need + 1 words (prefix filter), has `need`
words or more (length filter; first of all the document must hold as many), and what follows its first common word is long
enough (positional filter). Only what passes is counted. The templates are a small table that doesn't grow with the data,
so it travels in the plan, and no row is ever shuffled. Texts are read once: what the blocks need is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, narrow

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices as their publishers word them, in lower case and without signs, with their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "copyright all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
THRESHOLD = 80

#: Everything ASCII that is neither letter nor digit parts words (upper-case letters are gone by then).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() is faster, and differs from that for words and counts only where it makes ASCII letters of
    others, which it does of the Kelvin sign and of the capital I with a dot."""
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def normal(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(lowered(text), GAP, " "))


def need(words: list[str], threshold: int) -> int:
    return -(-len(words) * threshold // 100)


def strings(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def template_order(slim: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each template word stands: one row for each word of the templates."""
    held = slim.select(F.explode("hits").alias("word"))
    return dict.fromkeys(vocabulary, 0) | {r.word: r["count"] for r in held.groupBy("word").count().collect()}


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place where a base phrase's words stand consecutively; first_word and last_word are the smallest
    and largest of their starts, in words from 0, or null. labels has the base labels and those of matching templates.
    score is the largest share of a matching template's words in one block, or 1 for a base phrase, or 0.
    One row out for each row in, in any order; rows that repeat a doc_id or a text are scanned each. A null text is an
    empty one (no words, labels '', score 0), a null doc_id stays null, an empty table gives an empty result. Texts of any
    length are scanned whole. Words that are equally frequent come in alphabetical order. Other columns are ignored.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    rows = narrow(docs, "doc_id", "text").select("doc_id", normal(F.coalesce("text", F.lit(""))).alias("norm"))
    rows = rows.select("doc_id", "norm", F.split("norm", " ").alias("words"))
    distinct = [sorted(set(t.split())) for _, t in templates]
    enough = " or ".join(f"size(array_intersect({strings(ws)}, hits)) >= {need(ws, threshold)}" for ws in distinct)
    has_phrase = " or ".join(f"contains(norm, '{p}')" for p in PHRASES)
    slim = rows.select(
        "doc_id", F.expr("if(norm = '', 0L, cast(size(words) as bigint))").alias("n_words"), F.expr(f"array_intersect(words, {strings(vocabulary)})").alias("hits"), "words", F.expr(has_phrase).alias("phrase")
    )
    slim = checkpoint(slim.select("doc_id", "n_words", "hits", "phrase", F.expr(f"if(phrase or {enough}, words, cast(null as array<string>))").alias("words")))
    common = template_order(slim, vocabulary)

    index = []
    for label, t in templates:
        ordered = sorted(set(t.split()), key=lambda w: (common[w], w))
        least = need(ordered, threshold)
        index.append(f"named_struct('label', '{label}', 'words', {strings(ordered)}, 'prefix', {strings(ordered[: len(ordered) - least + 1])}, 'need', {least}, 'step', {len(t.split())})")
    places = [f"if(phrase, filter(transform(words, (w, k) -> if({' and '.join(f'get(words, k + {j}) = {chr(39)}{w}{chr(39)}' for j, w in enumerate(p.split()))}, cast(k as bigint), null)), k -> k is not null), cast(array() as array<bigint>))" for p in PHRASES]
    # the first common word is at place p of the ordered words: no more than size - p + 1 of them can follow
    place = "array_position(t.words, get(filter(t.prefix, w -> array_contains(b, w)), 0))"
    counted = f"if(size(b) >= t.need and arrays_overlap(b, t.prefix) and size(t.words) - {place} + 1 >= t.need, size(array_intersect(t.words, b)), 0)"
    blocks = "transform(sequence(0, size(words) - 1, t.step), i -> slice(words, i + 1, 2 * t.step))"
    share = f"array_max(transform(transform({blocks}, b -> {counted}), n -> if(n >= t.need, cast(n as double) / size(t.words), 0D)))"
    asked = f"filter(array({', '.join(index)}), t -> size(array_intersect(t.words, hits)) >= t.need)"
    found = f"if(words is null, cast(array() as array<struct<label: string, share: double>>), filter(transform({asked}, t -> named_struct('label', t.label, 'share', {share})), x -> x.share > 0))"

    out = slim.select("doc_id", "n_words", *[F.expr(e).alias(f"p{k}") for k, e in enumerate(places)], F.expr(found).alias("found"))
    every = f"concat({', '.join(f'p{k}' for k in range(len(PHRASES)))})"
    base = "array_compact(array(" + ", ".join(f"if(size(p{k}) > 0, '{label}', null)" for k, label in enumerate(PHRASES.values())) + "))"
    return out.select(
        "doc_id", "n_words", F.expr(f"cast(size({every}) as bigint)").alias("n_base"), F.expr(f"array_min({every})").alias("first_word"), F.expr(f"array_max({every})").alias("last_word"),
        F.expr(f"array_join(array_sort({base}), ',')").alias("base_labels"), F.expr(f"array_join(array_sort(array_distinct(concat({base}, found.label))), ',')").alias("labels"),
        F.expr(f"greatest(if(size({every}) > 0, 1D, 0D), coalesce(array_max(found.share), 0D))").alias("score"),
    )
