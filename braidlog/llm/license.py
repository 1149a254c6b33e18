"""Licence scan: a trained paragraph classifier, in DataFrame functions only.

A paragraph ends at a line without letters and digits, or where a line ends a sentence:
lines that a notice was wrapped into belong together. Its word uni- and bigrams are hashed
into a fixed number of places, and a sparse multinomial logistic regression scores the
licence families and an ``unknown`` class. The model is trained here from the templates
below and ordinary prose; it is a few thousand numbers, so it travels as a literal. A
temperature fitted on held-out paragraphs calibrates the probabilities, and a prediction
counts only if it is likely enough and the word pairs of the paragraph also match a template
of the predicted family.

Only paragraphs with one of the ``gate`` pairs are scored. No other can be confirmed: a
match needs more of a template's pairs than the gate leaves out.

Scoring happens inside each row: no shuffle, no key that can be hot.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.llm.columns import free, quoted

PLACES = 4096
UNKNOWN = "unknown"
#: Least calibrated probability; least share of a template's word pairs found in the paragraph, or of the
#: paragraph's found in the template, which then must be so many at least.
LEAST_PROBABILITY, LEAST_MATCH, LEAST_PAIRS = 0.5, 0.5, 6
#: Where a paragraph ends.
BOUNDARY = r"\n(?:[^\p{L}\p{N}\n]*+\n)++|(?<=[.!?:][\"')\]]?[ \t\r]{0,2})\n"
#: Ordinary lines taken as training rows of the unknown class: at most in all, and of one document.
MOST_LINES, LINES_EACH = 600, 5
SPLIT = r"[^\p{L}\p{N}.]+"

#: Fixed texts: grant and notice paragraphs of the licence families.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("CC0 1.0 Universal Public Domain Dedication.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "gpl-2": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "either version 2 of the License, or (at your option) any later version.",
        "Released under the GPLv2.",
        "Licensed under GPLv2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "gpl-3": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GPLv3.",
        "Licensed under GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example Company. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: Fixed texts: ordinary sentences with words that licences use.
ORDINARY = (
    "You need a driving licence to rent a car.", "The version of the story he told was different.", "The public was free to enter the work area.",
    "A permission slip must be signed by a parent.", "She reserved a table for two.", "The license plate was covered with mud.", "General knowledge is tested under time pressure.",
    "Source and binary are words of computing.", "The Apache helicopter landed at the base.", "He studied physics at MIT for four years.", "The bear is a free animal under the law.",
    "The terms of the treaty were published.", "All the seats were reserved in advance.", "The foundation granted money to any person.", "Creative work is common here.",
    "They redistribute food to the poor.", "The license was revoked by the office.", "Released last week, the film did well.", "The software crashed again.", "Copying homework is not allowed.",
)
#: What stands in for the parts of a notice that vary.
_FILL = ("", "Copyright 2019 Jane Doe.", "Copyright (c) 2021 The Authors.", "This project:", "Notice.")


def tokens(text: str) -> list[str]:
    """Lower-case words of a paragraph, dots at the ends removed."""
    words = (w.strip(".") for w in re.split(r"[^\w.]+|_+", text.lower()))
    return [w for w in words if w]


def place(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram.encode(), seed=42) % PLACES


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _row(text: str) -> np.ndarray:
    x = np.zeros(PLACES)
    for g in grams(tokens(text)):
        x[place(g)] = 1.0
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Model:
    """Weights, biases and temperature; ``classes`` ends with the unknown class."""

    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.classes, self.weights, self.bias, self.temperature = classes, weights, bias, temperature

    def probabilities(self, text: str) -> np.ndarray:
        return _softmax((self.weights @ _row(text) + self.bias)[None] / self.temperature)[0]


def labelled(lines: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Training paragraphs with their families."""
    rows = [(f"{fill} {text}".strip(), family) for family, texts in TEMPLATES.items() for text in texts for fill in _FILL]
    return rows + [(text, UNKNOWN) for text in (*ORDINARY, *lines, "") for _ in range(2 if text in ORDINARY else 1)]


@cache
def train(lines: tuple[str, ...] = (), rounds: int = 300, rate: float = 0.5, decay: float = 1e-3, sparsity: float = 2e-4) -> Model:
    """Proximal gradient descent with an L1 term; every fifth row is held out for the temperature."""
    rows = labelled(lines)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    x = np.stack([_row(text) for text, _ in rows])
    used = np.flatnonzero(x.any(0))
    x, y = x[:, used], np.array([classes.index(c) for _, c in rows])
    held = np.arange(len(rows)) % 5 == 4
    target = np.eye(len(classes))[y]
    share = (1.0 / np.bincount(y, minlength=len(classes)))[y]
    share = np.where(held, 0.0, 1.0) * share / share.sum() * len(rows)
    w, b = np.zeros((len(classes), len(used))), np.zeros(len(classes))
    for _ in range(rounds):
        gap = (_softmax(x @ w.T + b) - target) * share[:, None]
        w -= rate * (gap.T @ x / len(rows) * len(classes) + decay * w)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0.0)
        b -= rate * gap.mean(0)
    z = x[held] @ w.T + b

    def loss(t: float) -> float:
        return float(-np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean())

    temperature = min((0.25 * 1.2**k for k in range(16)), key=loss)
    full = np.zeros((len(classes), PLACES))
    full[:, used] = w
    return Model(classes, full, b, temperature)


def sample_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int = MOST_LINES) -> tuple[str, ...]:
    """At most ``most`` short lines that the scan would not score, as rows of the unknown class.

    The first lines, in order, of the documents of smallest id: the same ones however the
    table is split, and the driver gets at most ``most`` lines of 400 characters.
    """
    line = F.filter(F.split(F.coalesce(quoted(text_col), F.lit("")), "\n"), lambda x: F.length(x).between(1, 400) & ~_candidate(x))
    ids = [r[0] for r in docs.select(quoted(id_col).alias("id")).where("id is not null").distinct().orderBy("id").limit(-(-most // LINES_EACH)).collect()]
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias(text_col)).where(F.col("id").isin(ids))
    picked = rows.groupBy("id").agg(F.min(F.slice(line, 1, LINES_EACH)).alias("lines")).orderBy("id").collect()
    return tuple(x for r in picked for x in r.lines)[:most]


def _numbers(values: np.ndarray) -> Column:
    """A literal array of doubles, folded when the query is planned."""
    return F.split(F.lit(" ".join(f"{v:.6g}" for v in values)), " ").cast("array<double>")


#: A paragraph with one of these words speaks of licences, and is counted as unknown if no family is confirmed.
ANCHORS = r"licen[sc]e|copyright|creative commons|\bcc[ -]?(?:by|0)|\b[al]?gpl|redistribut|permission is hereby|rights reserved|public domain|waived all|unauthorized copying|any later version"


def word_pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


@cache
def gate() -> str:
    """Pattern of word pairs one of which every paragraph has that a template matches.

    A template's commonest words' pairs are left out, fewer than ``LEAST_PAIRS`` and than
    the least part of the template that a match needs.
    """
    texts = [tokens(text) for family in TEMPLATES.values() for text in family]
    often = Counter(w for words in texts for w in set(words))
    tree: dict[str, set[str]] = {}
    for words in texts:
        pairs = sorted(word_pairs(words), key=lambda p: -min(len(w) if often[w] < 8 else 0 for w in p.split(" ")))
        spared = min(LEAST_PAIRS, math.ceil(LEAST_MATCH * len(pairs))) - 1
        for pair in pairs[: len(pairs) - spared] if spared > 0 else pairs:
            a, b = pair.split(" ")
            tree.setdefault(a, set()).add(b)
    initials: dict[str, list[str]] = {}
    for a in sorted(tree):
        initials.setdefault(a[0], []).append(re.escape(a[1:]) + r"[^\p{L}\p{N}]+(?:" + "|".join(re.escape(b) for b in sorted(tree[a])) + ")")
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in initials.items()) + r")(?![\p{L}\p{N}])"


def _candidate(text: Column) -> Column:
    return text.rlike(f"(?i){ANCHORS}|{gate()}")


def _tokens(line: Column) -> Column:
    words = F.transform(F.split(F.lower(line), r"[^\p{L}\p{N}.]+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(words, lambda w: w != "")


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def _adder(weights: Column):
    return lambda total, at: total + F.get(weights, at)


def _classify(line: Column, model: Model) -> Column:
    """Struct of the confirmed family (or unknown), its probability and the template match."""

    def score(words: Column) -> Column:
        spots = F.array_distinct(F.transform(F.concat(words, _pairs(words)), lambda g: F.pmod(F.xxhash64(g), F.lit(PLACES)).cast("int")))

        def all_scores(spots: Column) -> Column:
            each = [
                F.aggregate(spots, F.lit(float(b)), _adder(_numbers(w))) / float(model.temperature)
                for w, b in zip(model.weights, model.bias, strict=True)
            ]
            return F.array(*[F.struct(s.alias("s"), F.lit(c).alias("family")) for s, c in zip(each, model.classes, strict=True)])

        def likeliest(scores: Column) -> Column:
            top = F.array_max(scores)
            total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x["s"] - top["s"]))
            return F.struct(top["family"].alias("family"), (1.0 / total).alias("probability"))

        return _let(spots, lambda p: _let(all_scores(p), likeliest))

    def match(words: Column, family: Column) -> Column:
        def best(pairs: Column) -> Column:
            out = F.lit(0.0)
            for name, texts in TEMPLATES.items():
                each = []
                for text in texts:
                    known = word_pairs(tokens(text))
                    common = F.size(F.array_intersect(pairs, F.array(*[F.lit(k) for k in known])))
                    each += [common / F.lit(float(len(known))), F.when(common >= LEAST_PAIRS, common / F.size(pairs)).otherwise(0.0)]
                out = F.when(family == name, F.greatest(*each)).otherwise(out)
            return out

        return _let(_pairs(words), best)

    def decide(words: Column) -> Column:
        def confirm(p: Column) -> Column:
            fit = F.when(p["family"] == UNKNOWN, 0.0).otherwise(match(words, p["family"]))
            good = lambda m: (p["family"] != UNKNOWN) & (p["probability"] >= LEAST_PROBABILITY) & (m >= LEAST_MATCH)
            return _let(fit, lambda m: F.struct(F.when(good(m), p["family"]).otherwise(UNKNOWN).alias("family"), p["probability"].alias("probability"), m.alias("match")))

        return _let(score(words), confirm)

    return _let(_tokens(line), decide)


def scan(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``license_families`` (sorted array), ``license_paragraphs`` and ``license_unknown`` (counts).

    ``license_unknown`` counts paragraphs that speak of licences but belong to no family
    with enough certainty. Texts are read whole; a null or empty text has none; rows are
    independent, so null ids and repeated rows are rows like others, and an empty table gives
    an empty result. Columns of these three names are replaced, all others pass through.
    """
    model = model or train()
    text, parts, found = quoted(text_col), free("parts", docs.columns), free("found", docs.columns)
    df = docs.withColumn(parts, F.when(_candidate(text), F.filter(F.split(text, BOUNDARY), _candidate)))
    none = F.array().cast("array<string>")
    named = lambda x, family: F.when((family != UNKNOWN) | x.rlike(f"(?i){ANCHORS}"), family).otherwise("")
    df = df.withColumn(found, F.transform(parts, lambda x: _let(_classify(x, model)["family"], lambda family: named(x, family))))
    known = F.coalesce(F.filter(found, lambda f: ~f.isin(UNKNOWN, "")), none)
    return df.withColumns(
        {
            "license_families": F.sort_array(F.array_distinct(known)),
            "license_paragraphs": F.size(known).cast("long"),
            "license_unknown": F.size(F.coalesce(F.filter(found, lambda f: f == UNKNOWN), none)).cast("long"),
        }
    ).drop(parts, found)


def held_out_accuracy(model: Model) -> float:
    """Share of unseen variants of the templates and ordinary sentences that the model labels right."""
    rows = [(f"{text} Copyright 2007 A. Person", family) for family, texts in TEMPLATES.items() for text in texts]
    rows += [(f"In short: {text}", UNKNOWN) for text in ORDINARY]
    right = sum(model.classes[int(np.argmax(model.probabilities(text)))] == family for text, family in rows)
    return right / len(rows) if rows else math.nan
