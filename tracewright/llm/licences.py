"""Licence scans by a trained paragraph classifier.

Paragraphs (lines, and runs of lines) are scored by a sparse multinomial
logistic regression on the presence of word n-grams (one to three words). Its
classes are the licence families and ``unknown``; it is trained here on
paragraphs made from public notice wordings and from ordinary prose about the
same things. A temperature and a least probability are calibrated on held-out
paragraphs so that at most ``FALSE_ACCEPT`` of the unknown ones pass. What
passes is confirmed by comparison with the family's templates: the share of a
template's word trigrams that the paragraph has must reach ``CONFIRM``.

A paragraph that shares no trigram with any template can't be confirmed, so it
is unknown whatever its scores; only the others are scored and reported. This
is looked up by hashes of word trigrams, first for whole texts.

Training happens once on the driver over a fixed training set (nothing of the
corpus is in it), and every n-gram with a weight is kept. Scoring uses only
DataFrame functions: n-grams meet a table of weights and one of template
trigrams, both of a size that the training set fixes.

Nulls and odd rows: null and empty texts and paragraphs without a template's
trigram give nothing; very long texts, lines and runs are scored whole; of
equally likely classes the first of ``CLASSES`` wins, of equally similar
templates the last by name; rows repeated in full (same id and text) are
reported once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, written

#: Training paragraphs that an n-gram of the model stands in, at least.
LEAST_SEEN = 3
FALSE_ACCEPT = 0.01
CONFIRM = 0.5
#: Comment marks around a line.
_MARKS = r"^[\s\x00]*(?:(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|>+)[\s\x00]*)+|[\s\x00]*(?:\*+/|-->|\*+)?[\s\x00]*$"

#: Public notice wordings of each family.
TEMPLATES = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License v3.0.", "SPDX-License-Identifier: GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    "gpl-2.0": ("Licensed under the GNU General Public License, version 2.", "Released under the GNU GPL v2.", "SPDX-License-Identifier: GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU Lesser General Public License v3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the GNU Affero General Public License v3.0.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": ("Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Content is available under CC-BY 4.0."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Content is available under CC-BY-NC 4.0."),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense."),
    "proprietary": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited. All rights reserved."),
}
CLASSES = (*TEMPLATES, "unknown")
#: Prose about licences and rights that is no licence.
_UNKNOWN = ("the driver had to renew a license before the trip", "a fishing license costs twenty dollars a year", "the police checked the license plate of the car", "she holds a medical license in three states", "the warranty covers parts and labour for two years", "the court decided the copyright case last week", "copyright law changes slowly", "the bar lost its liquor license", "the search warrant was signed by a judge", "the public domain name system was down", "they plan to redistribute the land among farmers", "our licensing team met the customers", "the license agreement was discussed at the meeting", "poetic license lets a writer bend the facts", "he was licensed as a pilot in the spring", "the permit was hereby granted to the mayor", "the software asked for a license key at startup", "warranted or not the claim was repeated", "a marriage license is issued by the county", "the copyright office opened at nine", "licensed under state law the broker sells houses", "the film was released under another title", "the prisoner was released under supervision", "the album was released under a new label")
_FILLER = "the of and a to in is was for on that with as by at from it an be are this have or had not but what all were when we there can said which do how if will each about up out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part".split()


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


def paragraphs(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """``n`` paragraphs of every family and six times as many unknown ones, with class numbers."""
    rng = random.Random(seed)

    def filler(k: int) -> str:
        made = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 9))) for _ in range(k)]
        return " ".join(w if rng.random() < 0.4 else rng.choice(_FILLER) for w in made)

    texts, labels = [], []
    for c, name in enumerate(CLASSES):
        for _ in range(n if name != "unknown" else 6 * n):
            if name == "unknown":
                if rng.random() < 0.6:
                    words = rng.choice(_UNKNOWN).split()
                    text = " ".join(w for w in words if rng.random() > 0.1)
                elif rng.random() < 0.5:
                    text = filler(rng.randint(4, 40)) + " " + rng.choice(("license", "copyright", "warranty", "licensed", "gpl", "released under", "redistribute", "public domain"))
                else:  # a licence that is none of the families
                    owner = "".join(rng.choices("bcdfghklmnprstv", k=2)) + rng.choice(("on", "ex", "ara", "im"))
                    text = rng.choice((f"Licensed under the {owner} License.", f"Released under the {owner} Public License, version {rng.randint(1, 9)}.", f"This work is licensed under {owner} terms.", f"SPDX-License-Identifier: {owner}-{rng.randint(1, 5)}.0"))
            else:
                words = rng.choice(TEMPLATES[name]).split()
                text = " ".join(w for w in words if rng.random() > 0.04 or len(words) < 9)
                if rng.random() < 0.3:
                    text = f"Copyright (c) {rng.randint(1990, 2026)} {filler(2)}. {text}"
            if rng.random() < 0.4:
                text = f"{filler(rng.randint(1, 30))}. {text}"
            if rng.random() < 0.3:
                text = f"{text} {filler(rng.randint(1, 20))}"
            texts.append(text if rng.random() < 0.85 else text.upper())
            labels.append(c)
    return texts, np.array(labels)


class Classifier:
    """Vocabulary, weights (n-grams by classes), biases, temperature and least probability."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias
        self.temperature, self.least = 1.0, 0.5

    def logits(self, texts: list[str]) -> np.ndarray:
        return np.array([self.bias + self.weights[[self.vocabulary[g] for g in grams(tokens(t)) if g in self.vocabulary]].sum(axis=0) for t in texts])

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def trained() -> Classifier:
    """The classifier, fitted on one set of made paragraphs and calibrated on another."""
    texts, y = paragraphs(40, seed=1)
    sets = [grams(tokens(t)) for t in texts]
    seen: dict[str, int] = {}
    for s in sets:
        for g in s:
            seen[g] = seen.get(g, 0) + 1
    vocabulary = {g: k for k, g in enumerate(sorted(g for g in seen if seen[g] >= LEAST_SEEN))}
    x = np.zeros((len(texts), len(vocabulary)), dtype=np.float32)
    for row, s in enumerate(sets):
        x[row, [vocabulary[g] for g in s if g in vocabulary]] = 1.0
    target = np.eye(len(CLASSES), dtype=np.float32)[y]
    balance = (len(y) / len(CLASSES) / np.bincount(y))[y].astype(np.float32)[:, None]
    w, b = np.zeros((len(vocabulary), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, 121):  # Adam on the whole set
        g = (softmax(x @ w + b) - target) * balance / len(y)
        gw, gb = x.T @ g + 2e-4 * w, g.sum(axis=0)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    w[np.abs(w) < 0.02] = 0.0  # sparse
    out = Classifier(vocabulary, np.round(w.astype(float), 3), np.round(b.astype(float), 3))
    held, labels = paragraphs(20, seed=2)
    z = out.logits(held)
    loss = {t: -np.log(softmax(z / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in np.arange(0.5, 3.01, 0.1)}
    out.temperature = round(float(min(loss, key=loss.get)), 2)
    p = softmax(z / out.temperature)
    unknown = len(CLASSES) - 1
    false = np.sort(np.where(p.argmax(axis=1) != unknown, p.max(axis=1), 0.0)[labels == unknown])
    out.least = round(min(0.95, max(0.5, float(false[int(np.ceil((1 - FALSE_ACCEPT) * len(false))) - 1]) + 1e-3)), 4)
    return out


def template_grams() -> list[dict]:
    """Trigrams of every template (all words where a template has fewer)."""
    out = []
    for family, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = tokens(text)
            n = min(3, len(words))
            own = sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})
            out += [{"gram": g, "family": family, "template": f"{family}/{k}", "of": len(own)} for g in own]
    return out


def _literal(spark: SparkSession, rows: list[dict], schema: str, label: str) -> DataFrame:
    """A small table from rows of ours, without Python on the executors."""
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")
    return written(made, label)


def _grams(words: Column) -> Column:
    def runs(bound: Column) -> Column:
        def of(k: int) -> Column:
            n = F.size(bound) - F.lit(k)
            at = F.when(n >= 0, F.sequence(F.lit(1), n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.concat_ws(" ", F.slice(bound, i, F.lit(k))))

        return F.concat(of(1), of(2), of(3))

    return F.element_at(F.transform(F.array(words), runs), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def trigram_hashes(words: Column) -> Column:
    """Hashes of all word trigrams."""

    def of(bound: Column) -> Column:
        n = F.size(bound) - F.lit(3)
        at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(bound, i + j) for j in range(3))))

    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of), 1)


def templated(spark: SparkSession):
    """A condition on a text: it has a trigram of some template (all templates have three words or more)."""
    grams = F.split(F.lit("|".join(sorted({r["gram"] for r in template_grams()}))), r"\|")
    known = spark.range(1).select(F.flatten(F.transform(grams, lambda g: trigram_hashes(F.split(g, " ")))).alias("h")).first()["h"]
    hashes = sorted(set(known))  # a few hundred
    values = F.from_json(F.lit(json.dumps(hashes)), "array<bigint>")
    return lambda text: F.arrays_overlap(trigram_hashes(words_of(text)), values)


def wrapped(text: Column) -> Column:
    """Paragraphs of several lines: ``first`` and ``last`` line and the ``line`` they make, without comment marks.

    A paragraph is a run of lines with more than white space and comment marks.
    """
    bare = F.transform(F.split(F.translate(text, "\x01\x02", "  "), "\n"), lambda x: F.trim(F.regexp_replace(x, _MARKS, "")))
    # every line carries its number through the split at blank lines
    marked = F.transform(bare, lambda x, i: F.when(x == "", F.lit("")).otherwise(F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02"), x)))
    runs = F.filter(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda x: F.regexp_like(x, F.lit("\x02[^\x01]*\x01")))
    number = "\x01([0-9]+)\x02"

    def of(x: Column) -> Column:
        line = F.btrim(F.regexp_replace(x, "\n?\x01[0-9]+\x02", " "), F.lit(" \n"))
        return F.struct(F.regexp_extract(x, number, 1).cast("int").alias("first"), F.regexp_extract(x, f"{number}[^\x01]*$", 1).cast("int").alias("last"), line.alias("line"))

    return F.transform(runs, of)


def scanned(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Every paragraph with a trigram of a template: ``doc_id, paragraph, length, family, predicted, probability, template, similarity``.

    ``family`` is ``unknown`` unless the classifier and a template agree. Each
    line is a paragraph, numbered from 0. A run of lines is one too, under the
    number of its first line, if it is found to be of a family that none of its
    lines alone is; it then stands for those of its lines that are unknown.
    """
    spark, model = docs.sparkSession, model or trained()
    n = len(CLASSES)
    inverse = sorted(model.vocabulary, key=model.vocabulary.get)
    weights = _literal(spark, [{"gram": g, "w": model.weights[k].tolist()} for k, g in enumerate(inverse) if model.weights[k].any()], "gram:string,w:array<double>", "licence-weights")
    templates = _literal(spark, template_grams(), "gram:string,family:string,template:string,of:int", "licence-templates")
    has = templated(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").filter(has(F.col("text")))
    texts = written(texts, "licence-texts")
    lines = texts.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    runs = texts.filter(F.col("text").contains("\n")).select("doc_id", "row", F.explode(wrapped(F.col("text"))).alias("run")).select("doc_id", "row", F.col("run.first").alias("paragraph"), F.col("run.last").alias("last"), "run.line")
    lines = lines.select("doc_id", "row", "paragraph", F.col("paragraph").alias("last"), "line")
    found = lines.unionByName(runs).filter(has(F.col("line"))).distinct()
    found = written(found, "licence-paragraphs")
    discard(texts)
    key = ["doc_id", "row", "paragraph", "last"]
    each = found.select(*key, F.explode(F.array_distinct(_grams(words_of(F.col("line"))))).alias("gram"))
    # a few thousand and len(template_grams()) rows: fixed by the training set, not by the corpus
    logits = each.join(F.broadcast(weights), "gram").groupBy(*key).agg(*(F.sum(F.col("w")[c]).alias(f"z{c}") for c in range(n)))
    scaled = F.array(*((F.coalesce(F.col(f"z{c}"), F.lit(0.0)) + F.lit(float(model.bias[c]))) / F.lit(model.temperature) for c in range(n)))
    logits = logits.withColumnsRenamed({k: f"l_{k}" for k in key})

    def same(left: DataFrame, right: DataFrame, prefix: str) -> Column:
        return left["doc_id"].eqNullSafe(right[f"{prefix}_doc_id"]) & (left["row"] == right[f"{prefix}_row"]) & (left["paragraph"] == right[f"{prefix}_paragraph"]) & (left["last"] == right[f"{prefix}_last"])

    scored = found.join(logits, same(found, logits, "l"), "left").select(*key, F.char_length("line").alias("length"), scaled.alias("z"))
    top = F.array_max("z")
    scored = scored.withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda s, z: s + F.exp(z - top)))
    scored = scored.withColumn("best", F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("z", top).cast("int")))
    met = each.join(F.broadcast(templates), "gram").groupBy(*key, "family", "template", "of").agg((F.count("*") / F.col("of")).alias("share"))
    closest = met.groupBy(*key, "family").agg(F.max(F.struct("share", "template")).alias("t"))
    closest = closest.select(*(F.col(k).alias(f"k_{k}") for k in key), "family", "t.share", "t.template")
    out = scored.join(closest, same(scored, closest, "k") & (scored["best"] == closest["family"]), "left")
    sure = (F.col("best") != "unknown") & (F.col("probability") >= model.least) & (F.coalesce("share", F.lit(0.0)) >= CONFIRM)
    out = out.select(*key, "length", F.when(sure, F.col("best")).otherwise(F.lit("unknown")).alias("family"), F.col("best").alias("predicted"), F.round("probability", 6).alias("probability"), "template", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("similarity"))
    out = written(out, "licence-scores")
    discard(found, weights, templates)
    one, known = out.filter("paragraph = last"), F.col("family") != "unknown"

    def inside(line: str, run: str) -> Column:
        return F.col(f"{line}.doc_id").eqNullSafe(F.col(f"{run}.doc_id")) & (F.col(f"{line}.row") == F.col(f"{run}.row")) & F.col(f"{line}.paragraph").between(F.col(f"{run}.paragraph"), F.col(f"{run}.last"))

    several = out.filter("paragraph < last").filter(known).alias("run").join(one.filter(known).alias("line"), inside("line", "run") & (F.col("line.family") == F.col("run.family")), "left_anti")
    several = written(several, "licence-runs")
    covered = one.filter(~known).select(*key).alias("line").join(several.alias("run"), inside("line", "run"), "left_semi").select(*(F.col(k).alias(f"c_{k}") for k in key))
    rest = one.join(covered, same(one, covered, "c"), "left_anti")
    return rest.unionByName(several).drop("row", "last")
