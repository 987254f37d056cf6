"""License scans: a trained paragraph classifier, with DataFrame functions only on the data.

A multinomial logistic regression over sparse word uni- and bigrams tells licence families,
`unknown` (statements of other licences) and `none` apart. It is trained on the templates below,
on variants of them (words lost, words around them), on statements of licences that aren't told by
name as `unknown`, and on plain sentences and a bounded sample of the corpus' own lines as `none`.
On a part of the examples that it wasn't trained on its scores are calibrated: a temperature, and
for each class the least probability that keeps false alarms below a rate. A paragraph of a family
is `unknown` with less than that, and where it doesn't hold enough of the n-grams of its family's
nearest template; one of the class `unknown` with less than that is none.

Paragraphs are lines, those of over WINDOW words in half-overlapping windows. For statements that
are wrapped over lines, half-overlapping windows also run over all words of a text, across its line
ends; of these, what is confirmed counts, unless a line within confirms the same template. It has
the line of its first anchor as paragraph and parts from -1 down, and unsure findings of its family
in lines within it are left out as pieces of it. Distinct paragraphs are scored once; n-grams meet the weights, whose number is bounded by the templates, in a
broadcast join. A paragraph without any anchor of a template (enough of its words that a match
can't lack them all) can't be confirmed, and isn't scored unless it has one of LEGAL, the words
of statements in general. Unknown statements are found line by line, not across lines.

Defined cases: a null or empty text has no paragraph; repeated rows give their findings each; an
empty table gives an empty result (and is trained with the templates alone); other columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import cut

#: Short statements and openings of well-known licences, by family.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "mit": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 2.1"],
    "agpl": ["licensed under the GNU Affero General Public License, version 3"],
    "bsd": ["Released under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["dedicated to the public domain under CC0 1.0 Universal"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "boost": ["Distributed under the Boost Software License, Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "proprietary": ["Copyright. All rights reserved. No part may be reproduced or distributed without prior written permission"],
}
#: Statements of other licences, from which the class `unknown` is learned.
OTHERS = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "Licensed under the EUPL, Version 1.2 or later, as soon they will be approved by the European Commission",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document",
    "You may redistribute this package under the terms of the Artistic License 2.0",
    "This software is provided under the Microsoft Public License",
    "This database is made available under the Open Database License",
    "Licensed under the Open Software License version 3.0",
    "Use of this source code is governed by a license that can be found in the license file",
    "This material may be copied and modified freely provided that this copyright notice is kept",
    "Permission to use this data for research is granted under the license agreement of the owner",
    "The license granted to you under this agreement is not exclusive and not transferable",
    "You may not sublicense, rent or lease the product except as the license permits",
    "Published under the terms of the Free Art License",
    "Dual licensed under the terms of either of the licenses above",
    "These images are licensed for personal use only",
    "This text is available under the GNU Free Documentation License, version 1.3",
]
#: Sentences that use words of licences and state none.
PLAIN = [
    "The driver had a license to drive in the city",
    "She lost her driving license on the way home",
    "He asked for permission to leave the table early",
    "The shop gives a two year warranty on every lamp",
    "A fishing license is sold at the harbour in spring",
    "The teacher gave permission for the trip to the lake",
    "They renewed the pub licence after a long dispute",
    "Copyright was a subject of the lecture last week",
    "Smoking is not permitted in the hall or on the stairs",
    "The terms of the peace were harsh for both sides",
    "A licensed nurse looked after the old man at night",
    "The museum owns the copyright of the painting",
]
NONE, UNKNOWN = "none", "unknown"
#: Words by which statements that no template covers are looked at.
LEGAL = ["copyright", "licence", "license", "licensed", "licenses", "permission", "permitted", "redistribute", "redistribution", "sublicense"]
COMMON = frozenset("a an and any are as at be by can either for from in is it may no not of on or part that the this to under use with without you".split())
WINDOW = 60
#: The share of a template's n-grams that a paragraph must hold.
CONFIRM = 0.8


def grams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


@dataclass(frozen=True)
class Training:
    """The bounds of what is trained on: lines of the corpus, lines of one text, characters of a line, and words that stand around statements."""

    corpus_lines: int = 1500
    lines_of_text: int = 40
    line_chars: int = 2000
    noise_words: int = 20_000
    variants: int = 40
    steps: int = 250
    false_alarms: float = 0.002
    seed: int = 5


@dataclass
class Model:
    classes: list[str]
    features: list[str]
    weights: np.ndarray  # (features, classes), divided by the temperature
    bias: np.ndarray
    least: list[float]  # probability by class
    templates: list[tuple[str, list[str]]]  # family, n-grams
    anchors: list[str]


def corpus_lines(docs: DataFrame, training: Training) -> list[str]:
    """A bounded sample of lines, by hash from all over the texts, that share no rare word with a template; of a long line, a piece from anywhere."""
    n = training.corpus_lines // 5
    h = F.pmod(F.xxhash64("doc_id", F.lit(training.seed)), F.lit(1 << 30))
    # the hash leaves about twice as many rows as are wanted, so that no task is sent a part of every partition
    share = min(1.0, 2 * n / max(1, docs.count()))
    lines = docs.select("doc_id", "text", h.alias("h")).filter(F.col("text").isNotNull() & (F.col("h") < int(share * (1 << 30)))).orderBy("h", "doc_id").limit(n)
    rare = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t) if w not in COMMON and len(w) > 3} | {*LEGAL})
    of_text = F.transform(F.split("text", "\n"), lambda line, i: F.struct(F.xxhash64("doc_id", i, F.lit(training.seed)).alias("h"), line.alias("line")))
    each = lines.select(F.explode(F.slice(F.array_sort(of_text), 1, training.lines_of_text)).alias("x")).select("x.h", "x.line")
    start = F.pmod(F.col("h"), F.greatest(F.length("line") - training.line_chars, F.lit(0)) + 1).cast("int") + 1
    picked = each.filter(~F.lower("line").rlike(r"\b(" + "|".join(rare) + r")\b")).select(F.substring(F.col("line"), start, F.lit(training.line_chars)).alias("line"))
    return [r["line"] for r in picked.limit(training.corpus_lines).collect()]


def train(lines: list[str], training: Training = Training(), known: dict[str, list[str]] = TEMPLATES) -> Model:
    """lines: what is none. known: statements by family; others can be left out, to see that they come out as unknown."""
    rng = np.random.default_rng(training.seed)
    classes = [*known, UNKNOWN, NONE]
    templates = [(family, grams(words_of(t))) for family, ts in known.items() for t in ts]
    features = sorted({g for _, gs in templates for g in gs} | {g for t in [*OTHERS, *PLAIN] for g in grams(words_of(t))})
    index = {g: i for i, g in enumerate(features)}
    noise = [w for line in lines for w in words_of(line)][: training.noise_words] or ["lorem", "ipsum", "dolor", "amet"]
    vocabulary = sorted({w for w in index if " " not in w})
    examples: list[tuple[list[str], int]] = []
    for c, statements in enumerate([*known.values(), OTHERS, PLAIN]):
        for text in statements:
            own = words_of(text)
            for _ in range(training.variants):
                kept = [w for w in own if rng.random() > 0.06 * rng.random()]
                around = [[noise[i] for i in rng.integers(0, len(noise), int(rng.integers(0, 12)))] for _ in range(2)]
                examples.append(([*around[0], *kept, *around[1]], c))
    none = len(classes) - 1
    examples += [(words_of(line)[i : i + WINDOW], none) for line in lines for i in range(0, max(1, len(words_of(line))), WINDOW)]
    for _ in range(10 * training.variants):  # the words of templates in no order, and a few of them among others
        some = [vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(1, 14)))]
        examples.append((some + [noise[i] for i in rng.integers(0, len(noise), int(rng.integers(0, 12)))], none))
    x = np.zeros((len(examples), len(features)), np.float32)
    y = np.zeros((len(examples), len(classes)), np.float32)
    for i, (words, c) in enumerate(examples):
        x[i, [index[g] for g in grams(words) if g in index]] = 1
        y[i, c] = 1
    held = rng.random(len(examples)) < 0.3
    w, b = np.zeros((len(features), len(classes))), np.zeros(len(classes))
    sw, sb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    xt, yt = x[~held], y[~held]

    def probabilities(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(training.steps):
        d = (probabilities(xt @ w + b) - yt) / len(xt)
        gw, gb = xt.T @ d + 1e-4 * w, d.sum(0)
        sw += gw**2
        sb += gb**2
        w -= 0.3 * gw / np.sqrt(sw)
        b -= 0.3 * gb / np.sqrt(sb)
    z, truth = x[held] @ w + b, y[held].argmax(1)
    if len(truth):
        losses = {t: -np.log(np.maximum(1e-12, probabilities(z / t)[np.arange(len(truth)), truth])).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
        heat = min(losses, key=losses.get)
    else:
        heat = 1.0
    p = probabilities(z / heat)
    least = []
    for c in range(len(classes)):
        others = np.sort(p[truth != c, c])[::-1]
        allowed = int(training.false_alarms * len(others))
        least.append(float(min(0.95, max(0.5, others[allowed] if allowed < len(others) else 0.5))))
    anchors = set()
    anchors.update(LEGAL)
    for _, gs in templates:
        own = sorted((g for g in gs if " " not in g), key=lambda g: (g in COMMON, -len(g), g))
        anchors.update(own[: len(own) // 4 + 1])
    return Model(classes, features, w / heat, b / heat, least, templates, sorted(anchors))


def _windows(words: Column) -> Column:
    """Half-overlapping windows; a run of WINDOW // 2 + 1 words is whole in one of them."""
    n = F.size(words)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)) + WINDOW // 2 - 1, F.lit(WINDOW // 2)), lambda i: F.slice(words, i + 1, WINDOW))


def _across(texts: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, paragraph, part, words, first, last): windows with an anchor that hold words of several lines, first to last."""
    of_line = lambda line, i: F.transform(F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.struct(w.alias("w"), i.alias("line")))
    words = texts.filter(F.instr("text", "\n") > 0).select("row", "doc_id", F.flatten(F.transform(F.split("text", "\n"), of_line)).alias("all"))
    anchors = F.array(*[F.lit(a) for a in model.anchors])
    each = words.select("row", "doc_id", F.posexplode(_windows(F.col("all"))).alias("n", "own"))
    ends = each.select("row", "doc_id", (-1 - F.col("n")).alias("part"), "own", F.try_element_at("own", F.lit(1))["line"].alias("first"), F.try_element_at("own", F.lit(-1))["line"].alias("last")).filter("first < last")
    held = F.filter("own", lambda x: F.array_contains(anchors, x["w"]))
    return ends.withColumn("held", held).filter(F.size("held") > 0).select("row", "doc_id", F.col("held")[0]["line"].alias("paragraph"), "part", F.col("own.w").alias("words"), "first", "last")


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraph, part, family, predicted, probability, template, held): paragraphs that a family claims.

    family is `unknown` where the claim isn't sure or not confirmed; held is the share of the template's n-grams.
    """
    anchor = r"(?i)\b(" + "|".join(model.anchors) + r")\b"
    texts = docs.filter(F.col("text").rlike(anchor)).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    texts = cut(texts)  # with numbers that stay: rows may repeat
    lines = texts.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).filter(F.col("line").rlike(anchor))
    words = F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), F.lit(0))
    windows = F.when(F.size("words") <= WINDOW, F.array(F.col("words"))).otherwise(_windows(F.col("words")))
    parts = lines.select("row", "doc_id", "paragraph", words.alias("words")).select("row", "doc_id", "paragraph", F.posexplode(windows).alias("part", "words")).withColumns({"first": F.col("paragraph"), "last": F.col("paragraph")})
    parts = parts.unionByName(_across(texts, model)).withColumn("key", F.array_join("words", " "))
    parts = cut(parts)  # paragraphs with an anchor: few, and costly to find twice
    each = parts.select("key", "words").dropDuplicates(["key"])
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), lambda i: F.concat(F.element_at("words", i), F.lit(" "), F.coalesce(F.try_element_at("words", i + 1), F.lit(""))))
    found = each.select("key", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    spark = docs.sparkSession
    of = {g: [j for j, (_, gs) in enumerate(model.templates) if g in gs] for g in model.features}
    table = spark.createDataFrame([(g, [float(v) for v in model.weights[i]], of[g]) for i, g in enumerate(model.features)], "gram string, w array<double>, held_by array<int>")
    hits = found.join(F.broadcast(table), "gram")
    k = range(len(model.classes))
    sums = hits.groupBy("key").agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in k], *[F.sum(F.array_contains("held_by", j).cast("int")).alias(f"t{j}") for j in range(len(model.templates))])
    z = F.array(*[F.col(f"z{i}") + float(model.bias[i]) for i in k])
    shares = F.array(*[F.col(f"t{j}") / len(gs) for j, (_, gs) in enumerate(model.templates)])
    scored = sums.select("key", z.alias("z"), shares.alias("shares"))
    scored = scored.withColumn("best", F.array_max(F.transform("z", lambda x, i: F.struct(x.alias("z"), (-i).alias("i")))))
    total = F.aggregate("z", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("best.z")))
    scored = scored.select("key", "shares", (1 / total).alias("p"), (-F.col("best.i")).alias("cls")).filter(F.col("cls") != len(model.classes) - 1)
    of_family = F.array(*[F.lit(model.classes.index(family)) for family, _ in model.templates])
    other = F.col("cls") == model.classes.index(UNKNOWN)  # has no templates: the nearest of all is named
    own = F.filter(F.transform("shares", lambda x, j: F.struct(x.alias("held"), (-j).alias("j"), F.element_at(of_family, j + 1).alias("cls"))), lambda x: other | (x["cls"] == F.col("cls")))
    likely = F.col("p") >= F.element_at(F.array(*[F.lit(x) for x in model.least]), F.col("cls") + 1)
    scored = scored.withColumn("near", F.array_max(own)).filter(likely | ~other)
    name = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("cls") + 1)
    sure = likely & ~other & (F.col("near.held") >= CONFIRM)
    verdicts = scored.select("key", F.when(sure, name).otherwise(F.lit(UNKNOWN)).alias("family"), name.alias("predicted"), F.round("p", 6).alias("probability"), (-F.col("near.j")).alias("template"), F.round("near.held", 6).alias("held"))
    found = cut(parts.drop("words").join(verdicts, "key").drop("key"))
    said = found.filter("part >= 0")
    confirmed = said.filter(F.col("family") != UNKNOWN).select(F.col("row").alias("r"), F.col("paragraph").alias("line"), F.col("template").alias("t"))
    wrapped = found.filter((F.col("part") < 0) & (F.col("family") != UNKNOWN))
    wrapped = wrapped.join(confirmed, (F.col("row") == F.col("r")) & (F.col("template") == F.col("t")) & F.col("line").between(F.col("first"), F.col("last")), "left_anti")
    whole = wrapped.select(F.col("row").alias("r"), F.col("family").alias("f"), F.col("first").alias("since"), F.col("last").alias("until"))
    said = said.join(whole, (F.col("family") == UNKNOWN) & (F.col("row") == F.col("r")) & F.col("predicted").isin(F.col("f"), F.lit(UNKNOWN)) & F.col("paragraph").between(F.col("since"), F.col("until")), "left_anti")
    return said.unionByName(wrapped).drop("row", "first", "last")


def scan_corpus(docs: DataFrame, training: Training = Training()) -> DataFrame:
    return scan(docs, train(corpus_lines(docs, training), training))
