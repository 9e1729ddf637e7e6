"""Licence scans by a trained paragraph classifier.

A sparse logistic regression over words and word pairs, trained on the driver from the templates below
and variations of them, tells licence families and an unknown class apart; its temperature is calibrated
on templates left out of the training, a third at a time. A predicted family is only reported if the paragraph
also shares enough word pairs with one of the family's templates: all of a short one, 60 % of a longer one. The scan itself runs on DataFrame functions alone:
the weights are a constant map of bounded size, looked up for the few paragraphs that hold a word pair
without which no template can be reached.

Defined results: a line that is a notice for itself is a paragraph. Of other lines, those up to a blank line
or a notice are read on, 24 words on each side of a line break, until they make a notice, which ends there;
so a wrapped notice counts once. Null and empty texts have none; every row is judged for itself, so repeated rows
get equal results; columns but doc_id and text are not looked at. Texts and lines of any length are read whole.
"""

from __future__ import annotations

import json
import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of each licence's text and of the notices that refer to it, none longer than AROUND words, and its names.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.", "This software is licensed under the MIT License.", "SPDX-License-Identifier: MIT", "MIT License", "MIT licence", "Licence MIT", "License: MIT", "MIT licensed", "The Expat licence",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "isc": ["ISC License", "ISC licence", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0 license", "Apache licence 2.0", "Apache 2 licence",
        "you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "gpl-2.0": ["GNU General Public License v2", "GNU General Public License, version 2", "GNU GPL version 2", "GPL version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License v3", "GNU General Public License, version 3", "GNU GPL version 3", "GPL version 3",
    ],
    "gpl": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty", "You should have received a copy of the GNU General Public License along with this program", "released under the GPL"],
    "lgpl": ["Licensed under the GNU Lesser General Public License.", "GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-3.0-only", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty"],
    "agpl-3.0": ["GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "BSD License", "BSD licence", "BSD 3-Clause", "BSD 2-Clause", "3-Clause BSD", "2-Clause BSD",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License", "If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "epl-2.0": ["Eclipse Public License", "SPDX-License-Identifier: EPL-2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "CC0 1.0 Universal", "CC0 1.0", "SPDX-License-Identifier: CC0-1.0", "dedicated to the public domain"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike"],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.", "Unauthorized copying of this file, via any medium, is strictly prohibited", "Proprietary and confidential"],
}
#: Templates of a family are dealt over so many folds for the calibration.
FOLDS = 3
OTHER = [
    "The licence to fish in this river is free of charge for any person.", "You may obtain a copy of the book at the library.", "This work is about the general public and its use of free time.",
    "The source of the river and its binary stars, with or without names.", "A driving licence of version 3 has been released.", "The rights of man and of the citizen are reserved for all.",
    "Drivers licensed under the old law may keep their papers.", "The university MIT and the Apache people are known.", "Public transport in the city is subject to change.",
    "the of and to in is it that was for on as with be by", "der die und in den von zu das mit sich", "le la les de des et en un une du", "el la los de que y en un una con",
]
COMMON = set("the of and to in is it that was for on as with be by a an or this at any are you can may its from under all der die und den von zu das mit sich le la les de des et en un une du el los que y una con".split())
LEAST_OVERLAP, LEAST_PROBABILITY, SHORT = 0.6, 0.5, 6
#: Words on each side of a line break: more than the longest template has.
AROUND = 24


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _grams(tokens: list[str]) -> list[str]:
    return [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))]


def needed(n: int) -> int:
    """How many of a template's n word pairs a paragraph has to hold: all of a name's, so that versions and families
    keep apart, and of a longer one LEAST_OVERLAP."""
    return n if n < SHORT else math.ceil(LEAST_OVERLAP * n - 1e-9)


def _gate(pairs: dict[str, list[list[str]]]) -> list[str]:
    """Word pairs of which a paragraph holds one at least if it overlaps enough with any template: of each template, so
    many of its pairs that not all can be missing, those without common words first."""
    gate: set[str] = set()
    for t in (t for family in pairs.values() for t in family):
        gate |= set(sorted(t, key=lambda g: (sum(w in COMMON or w.isdigit() for w in g.split()), g))[: len(t) - needed(len(t)) + 1])
    return sorted(gate)


def train(templates: dict[str, list[str]] | None = None, seed: int = 0) -> dict:
    """families, weights (gram to a weight for each family and the unknown class, last), bias, and the word pairs of each template."""
    templates = templates or TEMPLATES
    rng, families = random.Random(seed), sorted(templates)
    filler = [w for line in OTHER for w in _tokens(line)]
    rows: list[tuple[list[str], int, int]] = []  # words, family, fold
    for label, texts in [*((k, templates[f]) for k, f in enumerate(families)), (len(families), OTHER)]:
        for fold, text in enumerate(texts):
            t = _tokens(text)
            rows.append((t, label, fold % FOLDS))
            for _ in range(6):  # words go missing, others stand around
                kept = [w for w in t if len(t) < SHORT or rng.random() > 0.12] or t
                rows.append(([*rng.choices(filler, k=rng.randint(0, 4)), *kept, *rng.choices(filler, k=rng.randint(0, 4))], label, fold % FOLDS))
    known = [w for f in families for x in templates[f] for w in _tokens(x)]
    for k in range(150):  # licence words out of order, and filler, are unknown
        rows.append((rng.choices(known if rng.random() < 0.4 else filler, k=rng.randint(2, 12)), len(families), k % FOLDS))
    rng.shuffle(rows)
    names = sorted({g for texts in (*templates.values(), OTHER) for x in texts for g in _grams(_tokens(x))})
    at, classes = {g: i for i, g in enumerate(names)}, len(families) + 1
    x = np.zeros((len(rows), len(names)), dtype=np.float32)
    for r, (t, *_) in zip(x, rows):
        r[[at[g] for g in _grams(t) if g in at]] = 1
    y, fold = np.eye(classes, dtype=np.float32)[[label for _, label, _ in rows]], np.array([k for *_, k in rows])
    soft = lambda z: np.exp(z - z.max(axis=1, keepdims=True)) / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)

    def fitted(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xs, ys = x[use], y[use]
        w, b = np.zeros((len(names), classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
        for _ in range(150):
            g = (soft(xs @ w + b) - ys) / np.float32(len(xs))
            w, b = w - 8 * (xs.T @ g), b - 8 * g.sum(axis=0)
            w = np.sign(w) * np.maximum(np.abs(w) - np.float32(2e-4), 0)  # a sparse model
        return w, b

    # the temperature that suits templates which the classifier hasn't seen
    apart = [(k, *fitted(fold != k)) for k in range(FOLDS)]
    loss = lambda t: sum(-np.log(np.maximum((soft((x[fold == k] @ w + b) * t) * y[fold == k]).sum(axis=1), 1e-12)).sum() for k, w, b in apart)
    t = float(min(np.arange(0.3, 2.01, 0.05), key=loss))
    w, b = fitted(fold >= 0)
    weights = {g: [round(float(v), 5) for v in w[i] * t] for g, i in at.items() if np.abs(w[i]).max() > 0}
    pairs = {f: [sorted({f"{a} {b}" for a, b in zip(q, q[1:])}) for q in map(_tokens, templates[f])] for f in families}
    return {"families": families, "weights": weights, "bias": [float(v) for v in b * t], "pairs": pairs, "gate": _gate(pairs)}


def _constant(value, kind: str) -> Column:
    """A foldable column of a Python value."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scored(paragraph: Column, model: dict) -> Column:
    """family (null: unknown) and probability of a paragraph."""
    families, classes = model["families"], len(model["families"]) + 1
    once = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))  # noqa: E731  evaluates a once
    weights = _constant(model["weights"], "map<string, array<double>>")
    tokens = F.regexp_extract_all(F.lower(paragraph), F.lit("([a-z0-9]+)"), F.lit(1))
    pairs = lambda t: F.array_distinct(F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    add = lambda acc, g: once(F.try_element_at(weights, g), lambda w: F.when(w.isNull(), acc).otherwise(F.zip_with(acc, w, lambda p, q: p + q)))
    logits = lambda t: F.aggregate(F.concat(F.array_distinct(t), pairs(t)), _constant(model["bias"], "array<double>"), add)

    def verdict(z: Column, own: Column) -> Column:
        top = F.array_max(z)
        p = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        name = F.get(F.array(*map(F.lit, families), F.lit(None).cast("string")), F.array_position(z, top).cast("int") - 1)
        templates = F.try_element_at(_constant(model["pairs"], "map<string, array<array<string>>>"), name)
        close = F.exists(templates, lambda t: F.size(F.array_intersect(own, t)) >= F.when(F.size(t) < SHORT, F.size(t)).otherwise(F.ceil(F.size(t) * LEAST_OVERLAP - 1e-9)))
        sure = F.coalesce(close & (p >= LEAST_PROBABILITY), F.lit(False))
        return F.struct(F.when(sure, name).alias("family"), p.alias("probability"))

    assert classes == len(model["bias"])
    return once(tokens, lambda t: once(logits(t), lambda z: verdict(z, pairs(t))))


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, n_licences (paragraphs), families (sorted, joined by commas) and probability (the best) of each row of docs."""
    model = model or train()
    gate = rf"(?<![a-z0-9])(?:{'|'.join(g.replace(' ', '[^a-z0-9]+') for g in model['gate'])})(?![a-z0-9])"
    once = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))  # noqa: E731  evaluates a once
    verdict = lambda p: F.when(p.rlike(gate), scored(p, model))
    last = lambda p: F.substring_index(p, " ", -AROUND)
    none = F.array().cast("array<struct<family: string, probability: double>>")

    def step(acc: Column, line: Column) -> Column:
        """tail (words read since the last notice or blank line) and found, after one more line."""
        joined = F.when(acc["tail"] != "", F.concat(acc["tail"], F.lit(" "), F.substring_index(line, " ", AROUND)))
        sure = lambda v: F.when(v["family"].isNotNull(), v)
        hit = F.coalesce(sure(verdict(line)), sure(verdict(joined)))
        tail = F.when(line == "", F.lit("")).otherwise(F.trim(last(F.concat(acc["tail"], F.lit(" "), line))))
        return once(hit, lambda h: F.when(h.isNull(), F.struct(tail.alias("tail"), acc["found"].alias("found"))).otherwise(F.struct(F.lit("").alias("tail"), F.concat(acc["found"], F.array(h)).alias("found"))))

    text = F.lower(F.col("text").cast("string"))
    lines = lambda t: F.transform(F.split(t, "\r\n|\r|\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    read = lambda t: F.aggregate(lines(t), F.struct(F.lit("").alias("tail"), none.alias("found")), step)["found"]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), once(text, lambda t: F.when(t.rlike(gate), read(t)).otherwise(none)).alias("found"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ",").alias("families"),
        F.array_max("found.probability").alias("probability"),
    )
