"""Licence notices in documents (DataFrame functions only).

A paragraph is a line of the text, or neighbouring lines that together, and without any one
at their ends, hold ``CONFIRM`` of a template's words: a notice may be wrapped anywhere, and
comment signs are no words. Paragraphs are classified by multinomial logistic regression
over the presence of word 1- to 3-grams, and a family is believed if its probability reaches
the threshold calibrated for it. A template comparison then confirms the prediction:
``CONFIRM`` of a template's distinct words occur in the paragraph, or one of the family's
names stands in it word for word. Lines that hold none of ``ANCHORS`` are not scored: every
name holds one of them, and templates have their own search, so nothing else could be
confirmed.

The model is trained here, in plain Python on the driver, from wordings: the templates and
names below inside sentences that state a licence, and sentences about other things. The
sentences are dealt into three parts: one trains the model, one (with other names of unknown
licences and other distances from the template) calibrates the thresholds, and the last,
seen by neither, measures it (``evaluate``). The model is small and of fixed size, and
scoring is a broadcast join of the proposals' n-grams with its weights.

Defined results: a null or empty text has no proposals, its licence is `none`; a text whose
proposals are all of the unknown class is `unknown`; ties of probability go to the family
first in the alphabet; repeated rows are scanned each by itself (rows are told apart by id
and text); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, lines

UNKNOWN = "unknown"
#: The notices of each family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed to the Apache Software Foundation under one or more contributor license agreements.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": (
        "Licensed under CC0 1.0.", "To the extent possible under law, the author has dedicated this work to the public domain.", "This work is in the public domain.",
        "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "This program is free software under the terms of the GNU GPL version 2 or later.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software under the terms of the GNU GPL version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": (
        "All rights reserved.", "Copyright, all rights reserved. No part may be reproduced without written permission.",
        "This software is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
#: Names of each family, as words; "licence" is read as "license".
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "agplv3", "agpl v3", "agpl version 3", "affero general public license", "affero gpl"),
    "Apache-2.0": ("apache-2.0", "apache 2.0", "apache license 2.0", "apache license version 2.0", "apache license v2.0", "apache software license 2.0", "apache 2 license", "asl 2.0"),
    "BSD": ("bsd license", "bsd-2-clause", "bsd-3-clause", "2-clause bsd", "3-clause bsd", "new bsd", "simplified bsd", "modified bsd", "bsd-style license", "bsd terms"),
    "CC-BY-4.0": ("cc by 4.0", "cc-by 4.0", "cc-by-4.0", "creative commons attribution 4.0"),
    "CC-BY-NC-4.0": ("cc by-nc 4.0", "cc by nc 4.0", "cc-by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0"),
    "CC-BY-SA-4.0": ("cc by-sa 4.0", "cc by sa 4.0", "cc-by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0"),
    "CC0-1.0": ("cc0 1.0", "cc0-1.0", "cc0", "creative commons zero", "public domain dedication"),
    "GPL-2.0": ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gplv2", "gpl v2", "gpl version 2", "gpl 2.0", "general public license version 2", "general public license v2"),
    "GPL-3.0": ("gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gplv3", "gpl v3", "gpl version 3", "gpl 3.0", "general public license version 3", "general public license v3"),
    "ISC": ("isc license", "isc-style license", "isc terms", "spdx-license-identifier isc"),
    "LGPL": ("lgpl", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "lgplv2.1", "lgplv3", "lesser general public license"),
    "MIT": ("mit license", "mit-license", "mit-licensed", "mit terms", "spdx-license-identifier mit", "license mit", "under mit", "expat license", "x11 license"),
    "MPL-2.0": ("mpl-2.0", "mpl 2.0", "mplv2", "mozilla public license 2.0", "mozilla public license version 2.0", "mozilla public license v2.0"),
    "Proprietary": ("all rights reserved", "proprietary license", "proprietary and confidential"),
}
#: Sentences that state a licence by its name, and sentences near the subject
#: that state none; place k of a list is for training, calibration or the last measure by k mod 3.
STATEMENTS = (
    "Licensed under the {}.", "Released under {}.", "This file is free software under the {}.", "SPDX-License-Identifier: {}", "License: {}", "Distributed under the {} terms.", "{}",
    "Published under the terms of the {}.", "You may use it under the {}.", "This project uses the {}.", "The code is available under {} only.", "Covered by the {}; see the file for details.",
    "Made available under the {} by its authors.", "This package is {} software.", "Its licence is the {}.",
)
OTHERS = (
    "The driver must hold a valid license to drive a car.", "Fishing requires a license from the county.", "The licence fee rose again.",
    "Her license plate was found on the road.", "The pub lost its licence to sell beer last year.", "She renewed her licence at the town hall.",
    "He was granted permission to leave the room early.", "No permission was needed to enter.", "They asked for permission to build a house.",
    "The author has the right to publish the work in print.", "The copyright law of the country was changed last year.", "A lawyer explained copyright to the class.",
    "A public general meeting of the work council takes place in version two of the plan.", "The library is open to the general public.", "The public library has a new version of the map.",
    "They have reserved all rooms for the conference.", "All seats were reserved for members.", "The rights of workers were debated in public.",
    "The Apache people lived in the southwest.", "She studied at MIT for four years.", "Students of the MIT built a small robot.",
    "Terms and conditions were discussed at length.", "This paragraph reports on software that anyone may redistribute or sell.", "The wealth was redistributed under the new terms.",
    "The Mozilla team met in the spring.", "An Apache helicopter crossed the valley.", "The gnu is an antelope of the open plains.",
    "Creative people share common rooms in the old town.", "The commons were open to all creative minds.", "A creative work may be in common use without attribution.",
    "He holds a pilot license and a master of science.", "The company was licensed to run the ferry.", "Doctors are licensed by the state.",
)
#: What a line must hold to be a paragraph by itself; every name holds one.
ANCHORS = (
    "licen", "rights reserved", "public domain", "permission", "redistribut", "gpl", "copyright", "apache", "bsd", "cc by", "cc-by", "cc0", "creative commons", "mozilla",
    "mpl", "spdx", "asl 2", "proprietary", "isc terms", "mit terms", "under mit", "warrant",
)
#: Words of the templates that many texts hold; a search for templates starts from others.
FREQUENT = frozenset(
    "a all an and any are as at be by for from in is it its may of on one or that the this to was were which with you under work use used file free public general "
    "above law writing source code list rights author person time possible extent condition conditions subject form either without software program received along "
    "later option terms following part made provided fee purpose copy copies sell not no mit version have your must above notice can more".split()
)
#: Unigrams that say nothing.
STOP = frozenset("a all an and any are as at be by for from in is it its may of on one or that the this to was were which with you".split())
SPREAD, EPOCHS, RATE, DECAY, LEAST_WEIGHT = 14, 6, 0.5, 1e-3, 0.25
CONFIRM, SURE = 0.8, 0.97
N_GRAMS = 3
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_JAVA_WORD = r"([a-z0-9]+(?:[.-][a-z0-9]+)*)"
TRAIN, CALIBRATE, MEASURE = range(3)


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("licence", "license"))


def n_grams(words: list[str]) -> set[str]:
    grams = {" ".join(words[i : i + n]) for n in range(1, N_GRAMS + 1) for i in range(len(words) - n + 1)}
    return grams - STOP


@functools.cache
def _common(word: str) -> bool:
    """Whether the word stands in templates of several families, or in none; numbers do not count."""
    held = [any(w in word_list(t) for t in ts) for ts in TEMPLATES.values() for w in word_list(word)]
    return not any(map(str.isdigit, word)) and sum(held) != 1


def _made_up(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3))


def _around(text: str, rng: random.Random, lost: float) -> str:
    """``text`` inside other words; a long one loses a share of the words that several
    families have."""
    words = text.split()
    own = [w for w in words if not _common(w) or rng.random() > lost * (len(words) > 12)]
    fill = [w for t in OTHERS for w in t.split()]
    before, after = ([rng.choice(fill) if rng.random() < 0.4 else _made_up(rng) for _ in range(rng.choice((0, 0, 3, 12)))] for _ in range(2))
    return " ".join([*before, *own, *after])


def wordings(part: int, seed: int = 5) -> list[tuple[str, str]]:
    """(text, family) of one part: no sentence around a name, no unknown licence and no
    sentence about other things is in two parts."""
    rng = random.Random(seed + part)
    frames, others = STATEMENTS[part::3], OTHERS[part::3]
    out = []
    for family, names in NAMES.items():
        out += [(_around(frame.format(name), rng, 0), family) for name in names for frame in frames for _ in range(2)]
        if part != MEASURE:  # templates are known to the comparison, so they measure nothing
            out += [(_around(t, rng, (0.1, 0.15)[part]), family) for t in TEMPLATES[family] for _ in range(SPREAD)]
    out += [(_around(t, rng, 0), UNKNOWN) for t in others for _ in range(2 * SPREAD)]
    for frame in frames:
        for _ in range(3 * SPREAD):
            name = rng.choice(("{} License", "{} Public License", "{} Licence, version {}", "{} General License {}")).format(_made_up(rng).title(), rng.randint(1, 9))
            out.append((_around(frame.format(name), rng, 0), UNKNOWN))
    return out


class Model:
    """Weights by n-gram and family, biases, and each family's probability threshold."""

    def __init__(self, seed: int = 5):
        rng = random.Random(seed)
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        rows = wordings(TRAIN, seed)
        texts = [*(t for ts in TEMPLATES.values() for t in ts), *(n for ns in NAMES.values() for n in ns), *(f.format("") for f in STATEMENTS[TRAIN::3]), *OTHERS[TRAIN::3]]
        vocabulary = sorted(set().union(*(n_grams(word_list(t)) for t in texts)))
        self.grams = {g: i for i, g in enumerate(vocabulary)}
        used = [(self.features(t), self.families.index(y)) for t, y in rows]
        m = len(self.families)
        self.weights = [[0.0] * m for _ in vocabulary]
        self.bias = [0.0] * m
        square = [[1e-8] * m for _ in vocabulary]
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for x, y in used:
                p = self.probabilities(x)
                for k in range(m):
                    d = p[k] - (k == y)
                    if abs(d) < 1e-4:
                        continue
                    self.bias[k] -= 0.02 * d
                    for i in x:
                        g = d + DECAY * self.weights[i][k]
                        square[i][k] += g * g
                        self.weights[i][k] -= RATE * g / math.sqrt(square[i][k])
        # Four decimals, and no n-gram that moves nothing: the weights travel in the plan.
        self.weights = [[round(v, 4) for v in w] for w in self.weights]
        live = [g for g in vocabulary if max(map(abs, self.weights[self.grams[g]])) >= LEAST_WEIGHT]
        self.weights = [self.weights[self.grams[g]] for g in live]
        self.grams = {g: i for i, g in enumerate(live)}
        self.thresholds = self._calibrated(wordings(CALIBRATE, seed))

    def features(self, text: str) -> list[int]:
        return sorted(self.grams[g] for g in n_grams(word_list(text)) if g in self.grams)

    def probabilities(self, x: list[int]) -> list[float]:
        z = list(self.bias)
        for i in x:
            w = self.weights[i]
            for k in range(len(z)):
                z[k] += w[k]
        top = max(z)
        e = [math.exp(v - top) for v in z]
        total = sum(e)
        return [v / total for v in e]

    def _calibrated(self, held: list[tuple[str, str]]) -> list[float]:
        """For each family the least threshold, from 0.3, at which ``SURE`` of the calibration
        wordings that reach it and are confirmed are of the family; 1 if there is none."""
        hits: list[list[tuple[float, bool]]] = [[] for _ in self.families]
        for text, family in held:
            p = self.probabilities(self.features(text))
            k = max(range(len(p)), key=lambda k: (p[k], -k))
            if confirmed(self.families[k], text):
                hits[k].append((p[k], self.families[k] == family))
        out = []
        for k in range(len(self.families) - 1):
            least, right = 1.0, 0
            for n, (p, is_right) in enumerate(sorted(hits[k], reverse=True), 1):
                right += is_right
                if p >= 0.3 and right >= SURE * n:
                    least = p
            out.append(least)
        return out

    def classify(self, text: str) -> tuple[str, float]:
        """Family and probability of one paragraph, before the template comparison."""
        p = self.probabilities(self.features(text))
        k = max(range(len(p)), key=lambda k: (p[k], -k))
        return (self.families[k] if k == len(p) - 1 or p[k] >= self.thresholds[k] else UNKNOWN), p[k]


def confirmed(family: str, text: str) -> bool:
    words = word_list(text)
    if family == UNKNOWN:
        return False
    share = max(len({*word_list(t)} & {*words}) / len({*word_list(t)}) for t in TEMPLATES[family])
    return share >= CONFIRM or any(f" {name} " in f" {' '.join(words)} " for name in NAMES[family])


def evaluate(m: Model, part: int = MEASURE) -> tuple[float, float]:
    """Precision and recall of confirmed families over the wordings of a part."""
    right = found = there = 0
    for text, family in wordings(part):
        got = m.classify(text)[0]
        got = got if confirmed(got, text) else UNKNOWN
        there += family != UNKNOWN
        found += got != UNKNOWN
        right += got == family != UNKNOWN
    return right / max(found, 1), right / max(there, 1)


@functools.cache
def model() -> Model:
    return Model()


def _any_of(text: Column, parts: list[str] | tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def _table(rows: list[dict], schema: str) -> Column:
    """A constant array of structs; it is folded into one value of the plan."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


@dataclass(frozen=True)
class Template:
    """A template's words, its distinct ones, how many of those make it held, and words of
    which at least one is there if it is held: any len - need + 1 of them."""

    family: str
    all: list[str]
    words: list[str]
    need: int
    some: list[str]


@functools.cache
def templates() -> tuple[Template, ...]:
    out, chosen = [], set()
    for family, texts in TEMPLATES.items():
        for words in map(word_list, texts):
            distinct = list(dict.fromkeys(words))
            need = next(m for m in range(len(distinct) + 1) if m / len(distinct) >= CONFIRM)
            # Rare words first, and those that other templates have chosen: few are looked up.
            some = sorted(distinct, key=lambda w: (w in FREQUENT or len(w) < 3, w not in chosen, -len(w)))[: len(distinct) - need + 1]
            chosen.update(some)
            out.append(Template(family, words, distinct, need, some))
    return tuple(out)


def proposals(docs: DataFrame) -> DataFrame:
    """(row, paragraph, words) of the lines that hold an anchor and of joined lines, once for a repeated row;
    ``docs`` has ``row`` and ``text``."""

    def anchored(x: Column) -> Column:
        return _any_of(x, ANCHORS)

    # Texts are lowered once, and the few that hold an anchor are cut into lines.
    some = docs.where(let(F.lower(F.coalesce("text", F.lit(""))), anchored))
    each = some.select("row", F.posexplode(lines(F.lower("text"))).alias("paragraph", "line"))
    found = each.where(let(F.col("line"), anchored)).dropDuplicates(["row", "paragraph"])
    single = found.select("row", F.col("paragraph").cast("long").alias("paragraph"), _words(F.col("line")).alias("words"))
    return single.unionByName(_joined(docs))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(text, F.lit("licence"), F.lit("license")), F.lit(_JAVA_WORD), F.lit(1))


def _joined(docs: DataFrame) -> DataFrame:
    """(row, paragraph, words) of neighbouring lines that hold CONFIRM of a template's words
    and lose that without their first or last line; lines without words do not count. The
    last one begins within the template's length from the first one's end. ``paragraph``
    is below 0."""
    some = sorted({w for t in templates() for w in t.some})
    table = _table([{"ws": t.words, "need": t.need, "most": len(t.all), "some": t.some} for t in templates()], "ws: array<string>, need: int, most: int, some: array<string>")
    # Texts that hold enough of a template's words anywhere are cut into lines of words.
    lowered = F.replace(F.lower("text"), F.lit("licence"), F.lit("license"))
    wrapped = docs.where(F.col("text").contains("\n")).select("row", lowered.alias("text"))
    wrapped = wrapped.where(let(F.col("text"), lambda x: _any_of(x, some)))

    def held(x: Column, t: Column) -> Column:
        return F.exists(t["some"], lambda w: x.contains(w)) & (F.size(F.filter(t["ws"], lambda w: x.contains(w))) >= t["need"])

    wrapped = wrapped.select("row", "text", let(F.col("text"), lambda x: F.filter(table, lambda t: held(x, t))).alias("ts"))
    cut = wrapped.where(F.size("ts") > 0).dropDuplicates(["row"]).select(
        "row", F.filter(F.transform(lines(F.col("text")), _words), lambda ws: F.size(ws) > 0).alias("ls"), "ts"
    )
    of = cut.where(F.size("ls") > 1).select("row", "ls", F.explode("ts").alias("t"))
    ls, n = F.col("ls"), F.size("ls")

    def part(i: Column, count: Column) -> Column:
        return F.flatten(F.slice(ls, i + 1, count))

    def holds(ws: Column) -> Column:
        return F.size(F.array_intersect(F.col("t.ws"), ws)) >= F.col("t.need")

    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.arrays_overlap(F.col("t.ws"), F.get(ls, i)))
    at = of.where(holds(F.flatten(ls))).select("row", "ls", "t", F.explode(starts).alias("i"))
    i, j = F.col("i"), F.col("j")
    last = F.sequence(i, F.least(i + F.col("t.most"), n - 1))
    ends = at.withColumn("j", F.get(F.filter(last, lambda e: holds(part(i, e - i + 1))), 0)).where(j > i)
    whole = ends.where((F.size(part(i + 1, j - i - 1)) < F.col("t.most")) & ~holds(part(i + 1, j - i)))
    return whole.select("row", (-(i.cast("long") * (1 << 31) + j) - 1).alias("paragraph"), part(i, j - i + 1).alias("words")).dropDuplicates(["row", "paragraph"])


def classify(found: DataFrame) -> DataFrame:
    """(row, paragraph, family, probability, containment, confirmed) of the proposals."""
    spark, m = found.sparkSession, model()
    grams = sorted(m.grams, key=m.grams.get)
    # The model's weights, a few hundred rows, as a literal relation.
    held = json.dumps([{"gram": g, "w": m.weights[i]} for i, g in enumerate(grams)])
    weights = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(held), "array<struct<gram: string, w: array<double>>>"))))

    def joined(w: Column) -> Column:
        n = F.size(w)
        of = lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
        return F.array_distinct(F.flatten(F.array(*[F.when(n >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(1, N_GRAMS + 1)])))

    each = found.select("row", "paragraph", F.explode(let(F.col("words"), joined)).alias("gram")).join(weights, "gram")
    # Sums are of the model's own n-grams only, a bounded number for each paragraph.
    sums = each.groupBy("row", "paragraph").agg(*[(F.sum(F.get("w", k)) + F.lit(m.bias[k])).alias(f"z{k}") for k in range(len(m.families))])
    z = F.array(*[F.col(f"z{k}") for k in range(len(m.families))])
    e = let(z, lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda v: F.exp(v - top))))
    shares = let(e, lambda a: let(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), lambda total: F.transform(a, lambda v: v / total)))
    best = sums.select("row", "paragraph", F.array_max(F.transform(shares, lambda p, i: F.struct(p.alias("p"), (-i).alias("k")))).alias("b"))
    family, least = (F.get(F.array(*map(F.lit, x)), -F.col("b.k")) for x in (m.families, [*map(float, m.thresholds), 0.0]))
    scored = found.join(best, ["row", "paragraph"], "left").withColumn(
        "family", F.when(F.col("b.p") >= least, family).otherwise(F.lit(UNKNOWN))
    ).withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    held = _table([{"family": t.family, "ws": t.words} for t in templates()], "family: string, ws: array<string>")
    names = _table([{"family": f, "name": f" {n} "} for f, ns in NAMES.items() for n in ns], "family: string, name: string")

    def share(family: Column, words: Column) -> Column:
        own = F.filter(held, lambda t: t["family"] == family)
        return F.array_max(F.transform(own, lambda t: F.size(F.array_intersect(words, t["ws"])) / F.size(t["ws"])))

    contained = let(F.struct("family", "words"), lambda x: share(x["family"], x["words"]))
    named = let(F.struct("family", "joined"), lambda x: F.exists(names, lambda n: (n["family"] == x["family"]) & x["joined"].contains(n["name"])))
    return scored.select(
        "row", "paragraph", "family", F.coalesce("b.p", F.lit(0.0)).alias("probability"), contained.alias("containment"),
        ((F.col("family") != UNKNOWN) & (F.coalesce(contained >= F.lit(CONFIRM), F.lit(False)) | named)).alias("confirmed"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: its best confirmed family, and what was found."""
    row = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = docs.select(row.alias("row"), "text")
    found = classify(proposals(rows))
    best = F.struct("confirmed", F.col("probability").alias("p"), F.col("family").alias("f"), F.col("containment").alias("c"))
    of_row = found.where(F.col("family") != UNKNOWN).groupBy("row").agg(
        F.max(best).alias("best"), F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"), F.count("*").alias("n_notices")
    )
    tried = found.groupBy("row").agg(F.count("*").alias("n_proposals"))
    out = rows.select("row").join(tried.join(of_row, "row", "left"), "row", "left")
    sure = F.coalesce(F.col("best.confirmed"), F.lit(False))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        F.when(F.col("n_proposals").isNull(), "none").when(sure, F.col("best.f")).otherwise(UNKNOWN).alias("license"),
        F.when(sure, F.round("best.p", 6)).alias("probability"),
        F.when(sure, F.round("best.c", 6)).alias("containment"),
        F.coalesce("n_proposals", F.lit(0)).cast("long").alias("n_proposals"),
        F.coalesce(F.size("families"), F.lit(0)).cast("long").alias("n_families"),
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
    )
