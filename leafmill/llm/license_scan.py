"""Licence notices by a trained paragraph classifier, scored with built-in functions alone.

A paragraph is a bag of its different words and neighbouring word pairs. A softmax regression over
these, fitted on the driver from the wordings below, has a class for each licence family, one for
licences of any other family (`unknown`) and one for everything else. A predicted family is compared with its
templates: of the paragraph's word pairs that are features, the share that the family's wordings contain has to
reach a least value for the prediction to be confirmed. A family that isn't sure or isn't confirmed, in a paragraph that is
likely some licence, is `unknown` too.

Calibration is on what was not trained on: first weights are fitted without some sentence frames,
some longer wordings of each family, and some unknown families altogether; the temperature that makes these likeliest
is kept, and the weights are then fitted on everything. `held_out_report` gives the figures of the first fit.

Every line of every text is scored, and so is every paragraph (blank lines end one) as a whole, where more than one of its lines has a word of the vocabulary; what has no word of the vocabulary
weighs nothing, and is the same `none` whatever it says. For notices that are wrapped and stand amid other lines, two more things are scored: each run of
neighbouring lines with an anchor word and a word of the vocabulary, and in paragraphs with several runs all from the first of them to the last. A run that is not
confirmed as one notice counts by its lines. A paragraph, or what lies between its first and last run, counts as one notice where it is confirmed and
at most one of its parts is, as the same family; else its parts count. The weights are a table of fixed size, whatever the corpus; sums of weights
are shuffled, and texts are not.

Contract for odd input: a null or empty text has no paragraph and the family `none`; equal scores
go to the first family by name; rows that repeat (same doc_id and text) each get the same result;
an empty table gives an empty result; a null doc_id is kept; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
LEAST_PROBABILITY, LEAST_OVERLAP = 0.6, 0.4

# Names of licences by family, as they stand in a sentence and as identifiers.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU Affero GPL", "AGPL", "AGPLv3", "GNU AGPL v3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache": ("Apache License", "Apache License, Version 2.0", "Apache Software License", "Apache 2.0", "Apache-2.0", "Apache License 2.0", "ASL 2.0"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "2-clause BSD license", "3-clause BSD license", "New BSD License", "Simplified BSD License", "BSD-3-Clause", "BSD-2-Clause", "modified BSD license"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "Creative Commons Attribution-ShareAlike 3.0 License", "CC BY 4.0", "CC BY-SA 4.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC BY 3.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 3.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License v2", "GNU General Public License, version 2 or later", "GPL", "GPL version 2", "GNU GPL", "GNU GPL v3", "GPLv2", "GPLv3", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "LGPL", "LGPL v3", "LGPLv2.1", "GNU LGPL", "LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0-only"),
    "mit": ("MIT License", "MIT license (MIT)", "MIT", "Expat License", "MIT/X11 License", "X11 License"),
    "mpl": ("Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL", "MPL 2.0", "MPL-2.0", "MPL-1.1"),
    "public-domain": ("Unlicense", "CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero", "public domain dedication"),
}
# Licences of other families. Those after the bar are held out whole for calibration.
OTHER_NAMES = (
    "Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0", "zlib License", "Zlib", "Artistic License", "Artistic License 2.0", "Artistic-2.0", "Boost Software License 1.0", "BSL-1.0",
    "PostgreSQL License", "Microsoft Public License", "MS-PL", "Python Software Foundation License", "PSF License", "SIL Open Font License 1.1", "OFL-1.1", "Common Public License", "Academic Free License 3.0",
    "Open Database License", "ODbL-1.0", "Business Source License 1.1", "Server Side Public License", "Elastic License", "custom license", "license agreement", "terms of the license agreement", "company license", "commercial license", "following license",
)
HELD_OTHER_NAMES = ("ISC License", "ISC", "European Union Public Licence 1.2", "EUPL-1.2", "Open Software License 3.0", "OSL-3.0", "Common Development and Distribution License", "CDDL-1.0")
# Sentences around a name. The last ones are held out for calibration.
FRAMES = (
    "Licensed under the {}.", "Released under the {}.", "Released under the {} license.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.",
    "This program is licensed under the {}.", "SPDX-License-Identifier: {}", "License: {}", "{}", "Distributed under the {}.", "This software is licensed under the {}, see the file LICENSE.",
    "The source code is available under the {}.", "Licensed under {}.", "Released under {}, see LICENSE for details.", "You may use this file under the terms of the {}.",
)
HELD_FRAMES = ("This library is made available under the {}.", "Code in this repository is covered by the {}.", "All files are subject to the {}.")
# Longer wordings by family; the last one of each is held out for calibration.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "If your software can interact with users remotely through a computer network, you should also make sure that it provides a way for users to get its source under the GNU Affero General Public License.",
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by": (
        "You are free to share and adapt the material for any purpose, even commercially, under the Creative Commons Attribution terms: you must give appropriate credit.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
    "cc-by-nc": (
        "You may not use the material for commercial purposes: Creative Commons Attribution-NonCommercial terms apply.",
        "Released under CC BY-NC-SA 4.0, for non-commercial use only.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; see the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "The MIT License (MIT) Copyright (c) 2015 The Authors",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the MPL.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) 2020 by the author. All rights reserved.",
        "Copyright 2018 The Company, Inc. All Rights Reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "This software is proprietary and confidential; unauthorized use or copying is strictly prohibited.",
        "Copyright (c) The Company. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain.",
        "This file has been placed in the public domain by its author.",
    ),
}
# Paragraphs that speak of such things and grant nothing. Every fourth is held out for calibration.
OTHERS = (
    "He lost his driving license and had to take the bus to work.",
    "The license plate of the car was covered with mud.",
    "The restaurant applied for a license to sell wine in the city.",
    "The author published a version of the story in a public library.",
    "Permission to enter the building is given by the guard at the gate.",
    "The software of the machine was old and the source of the error unknown.",
    "Copyright law protects the work of writers and painters.",
    "The general said the public was free to use the road.",
    "She compared four versions of the form and chose the second.",
    "A creative child needs common sense and some attribution of success.",
    "The foundation of the house was modified under the terms of the contract.",
    "This project was released last year by the company.",
    "All visitors have the right to see a copy of the file.",
    "We met the conditions and the list was published without restriction.",
    "The apache helicopter landed near the village.",
    "A student of MIT wrote the first version of the program.",
    "The terms of the GNU treaty were made public in general.",
    "Use of this product requires the license number on the back of the box.",
    "The warranty of the washing machine ends in March.",
    "His poetic license went too far for the public of that time.",
    "The court asked whether the copyright notice had been removed.",
    "They reserved all rooms of the hotel for the guests of the wedding.",
    "The gnu is a large animal of the public parks in Africa.",
    "A wide public domain of the river was open to fishing.",
    "The software was released, and the public source of the money found.",
    "The pilot holds a commercial license since last year.",
    "The mozilla engineers met at the general meeting.",
    "No permission was granted to the press, the general said.",
    "He got his license renewed at the office in town.",
    "Her fishing license had expired the week before.",
    "The doctor lost the license to practise for two years.",
    "Without a license nobody may drive the bus.",
    "The software crashed when the file was opened.",
    "Er kam mit dem Auto und ging mit dem Bus nach Hause.",
    "Three people from MIT were at the table.",
    "New software was installed on all machines of the school.",
)
# How the words begin without one of which a line is no notice.
ANCHORS = (
    "licen", "unlicen", "sublicen", "spdx", "copyright", "copyleft", "rights reserved", "redistribut", "warrant", "merchantab", "permission", "public domain", "unencumbered", "creative ?commons", "cc0",
    "cc.by", "a?gpl", "lgpl", "gnu", "mozilla", "mpl", "bsd", "apache", "(?-i:MIT)", "proprietary", "confidential", "software", "expat",
)
# Words that are no features.
COMMON = frozenset("a an and any are as at be by for from has he her his i in is it its may not of on or such that the this to under was were which with you".split())
_ANCHOR = r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + ")"
_TOKEN = r"[^a-z0-9+.]+"
#: The same words as by `tokens`: what is between them, with the dots that words begin and end with. A few of the texts between are empty.
_BETWEEN = r"(?:(?<!\.)\.+)?[^a-z0-9+.]+\.*|^\.+|(?<!\.)\.+$"
#: Lines of nothing but white space, which are made empty, and empty lines, which are between paragraphs.
_BLANK = r"(?md)^[ \t\x0b\f\r]+$"
_GAP = r"\n\n+"


def tokens(text: str) -> list[str]:
    return [t for t in (x.strip(".") for x in re.split(_TOKEN, text.lower())) if t]


def pairs_of(words: list[str], vocabulary: frozenset[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:]) if a in vocabulary or b in vocabulary}


def grams(words: list[str], vocabulary: frozenset[str]) -> set[str]:
    return {w for w in words if w in vocabulary} | pairs_of(words, vocabulary)


@dataclass(frozen=True)
class Model:
    """weights: gram -> a weight per class (families by name, `unknown`, `none`); notices: pair -> families that have it."""

    families: tuple[str, ...]
    words: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    notices: dict[str, tuple[int, ...]]


def _wordings() -> list[tuple[list[str], str, bool, bool]]:
    """(words, class, held out, whether copies with words left out are made)."""
    out = []
    for family, names in NAMES.items():
        out += [(tokens(f.format(n)), family, held, False) for frames, held in ((FRAMES, False), (HELD_FRAMES, True)) for f in frames for n in names]
    for family, notices in NOTICES.items():
        out += [(tokens(x), family, i == len(notices) - 1, True) for i, x in enumerate(notices)]
    for names, held in ((OTHER_NAMES, False), (HELD_OTHER_NAMES, True)):
        out += [(tokens(f.format(n)), UNKNOWN, held, False) for f in (HELD_FRAMES if held else ()) + FRAMES for n in names]
    out += [(tokens(x), NONE, i % 4 == 3, True) for i, x in enumerate(OTHERS)]
    return out


@lru_cache(maxsize=2)
def _fitted(seed: int = 11, copies: int = 6) -> tuple[Model, dict[str, tuple[int, int, int]]]:
    rng = np.random.default_rng(seed)
    families = tuple(sorted(NOTICES))
    classes = (*families, UNKNOWN, NONE)
    named = _wordings()
    words = frozenset(w for ws, c, _, _ in named if c in families for w in ws if w not in COMMON)
    rows: list[tuple[set[str], int, bool]] = [(set(), len(classes) - 1, False)] * 20
    for ws, c, held, more in named:
        rows.append((grams(ws, words), classes.index(c), held))
        for n in range(copies * more):
            keep = [w for w in ws if rng.random() > 0.12] or ws
            if n % 2 and len(keep) > 10:  # a notice that begins or ends within
                a = int(rng.integers(len(keep) // 2))
                keep = keep[a : a + max(8, len(keep) // 2)]
            rows.append((grams(keep, words), classes.index(c), held))
    # noise: single feature words are no notice, nor are a few common to all notices
    every = sorted(words)
    rows += [({every[i] for i in rng.integers(len(every), size=int(rng.integers(1, 3)))}, len(classes) - 1, bool(n % 5 == 4)) for n in range(300)]
    held = np.array([h for _, _, h in rows])
    names = sorted({g for gs, _, _ in rows for g in gs})
    number = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (gs, _, _) in enumerate(rows):
        x[i, [number[g] for g in gs]] = 1
    label = np.array([c for _, c, _ in rows])
    y = np.eye(len(classes), dtype=np.float32)[label]
    w, b = _regression(x[~held], y[~held])
    z = x[held] @ w + b
    losses = {t: -np.log(np.maximum((softmax(z / t) * y[held]).sum(1), 1e-12)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)}
    best = min(losses, key=losses.get)
    said, true = softmax(z / best).argmax(1), label[held]
    report = {c: (int(((said == i) & (true == i)).sum()), int((true == i).sum()), int((said == i).sum())) for i, c in enumerate(classes)}
    w, b = _regression(x, y)
    of: dict[str, set[int]] = {}
    for ws, c, _, _ in named:
        if c in families:
            for p in pairs_of(ws, words):
                of.setdefault(p, set()).add(families.index(c))
    weights = {g: tuple(w[i].astype(float).round(4).tolist()) for g, i in number.items()}
    return Model(families, tuple(every), weights, tuple(b.astype(float).round(4).tolist()), best, {g: tuple(sorted(c)) for g, c in of.items()}), report


def _regression(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression with equal weight for each class."""
    of_row = (y / (y.sum(0) * y.shape[1])).sum(1, keepdims=True)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(steps):
        d = (y - softmax(x @ w + b)) * of_row
        sw, sb = x.T @ d - 1e-4 * w, d.sum(0)
        gw += sw**2
        gb += sb**2
        w += 0.3 * sw / np.sqrt(gw)
        b += 0.3 * sb / np.sqrt(gb)
    return w, b


def train() -> Model:
    """The model of the wordings above; the same one each time."""
    return _fitted()[0]


def held_out_report() -> dict[str, tuple[int, int, int]]:
    """Of each class: held-out wordings that got it rightly, all of it, and all that got it, with weights that saw none of them."""
    return _fitted()[1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _units() -> Column:
    """What is scored of a paragraph, whose lines are (a: has an anchor word, w: words, k: one of them is in the vocabulary) and whose runs start and end at given lines: an array of
    (run, part, n_lines, words). Runs have the number of their first line, their whole is part 0 and their lines follow; lines without an anchor word are runs of their own.
    -2 is what lies between the first and the last run, -1 is the paragraph."""
    lines, starts, ends = F.col("lines"), F.col("starts"), F.col("ends")
    unit = lambda run, part, n, w: F.struct(run.cast("int").alias("run"), part.cast("int").alias("part"), n.cast("int").alias("n_lines"), w.alias("words"))
    whole = lambda a, b: F.flatten(F.transform(F.slice(lines, a + 1, b - a + 1), lambda x: x["w"]))
    none = F.array().cast("array<struct<run:int,part:int,n_lines:int,words:array<string>>>")

    def of_run(a, b):
        n = b - a + 1
        each = F.transform(F.slice(lines, a + 1, n), lambda x, j: unit(a, j + 1, n, x["w"]))
        return F.when(b > a, F.concat(F.array(unit(a, F.lit(0), n, whole(a, b))), each)).otherwise(each)

    runs = F.when(F.size(starts) > 0, F.flatten(F.zip_with(starts, ends, of_run))).otherwise(none)
    others = F.filter(F.transform(lines, lambda x, i: F.when(x["k"] & ~x["a"], unit(i, F.lit(1), F.lit(1), x["w"]))), lambda u: u.isNotNull())
    first, last = F.get(starts, F.lit(0)), F.get(ends, F.size(ends) - 1)
    between = F.when(F.size(starts) > 1, F.array(unit(F.lit(-2), F.lit(0), last - first + 1, whole(first, last)))).otherwise(none)
    all_of_it = F.when(F.size(F.filter(lines, lambda x: x["k"])) > 1, F.array(unit(F.lit(-1), F.lit(0), F.size(lines), whole(F.lit(0), F.size(lines) - 1)))).otherwise(none)
    return F.concat(runs, others, between, all_of_it)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per document: doc_id, license (family, `unknown` or `none`), probability (of the family; of any licence, if unknown),
    overlap, n_notices (paragraphs that are notices), licenses (all of them, by name)."""
    spark = docs.sparkSession
    m = model or train()
    k = len(m.families)
    grams_of = sorted(m.weights.keys() | m.notices.keys())
    kinds = [("gram", pa.string()), ("weights", pa.list_(pa.float64())), ("notices", pa.list_(pa.int32())), ("pair", pa.bool_())]
    values = [grams_of, [m.weights.get(g, (0.0,) * (k + 2)) for g in grams_of], [m.notices.get(g, ()) for g in grams_of], [" " in g for g in grams_of]]
    table = spark.createDataFrame(pa.table([pa.array(v, t) for v, (_, t) in zip(values, kinds)], [n for n, _ in kinds]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("__h"), "text")

    paragraphs = F.posexplode(F.split(F.regexp_replace("text", _BLANK, ""), _GAP)).alias("paragraph", "whole")
    some = rows.withColumn("__r", F.monotonically_increasing_id()).select("doc_id", "__h", "__r", paragraphs)
    known = lambda w: w.isin(list(m.words))
    lines = F.transform(F.split("whole", "\n"), lambda x: F.struct(x.alias("x"), F.array_remove(F.split(F.lower(x), _BETWEEN), "").alias("w")))
    lines = F.transform(lines, lambda x: F.struct(x["x"].alias("x"), x["w"].alias("w"), F.exists(x["w"], known).alias("k")))
    lines = F.transform(lines, lambda x: F.struct(x["w"].alias("w"), x["k"].alias("k"), (x["k"] & x["x"].rlike(_ANCHOR)).alias("a")))
    at = ["doc_id", "__h", "__r", "paragraph"]
    some = some.select(*at, lines.alias("lines"))
    anchored = lambda i: F.coalesce(F.get("lines", i)["a"], F.lit(False))
    every = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), anchored)
    some = some.withColumn("every", every).select(*at, "lines", F.filter("every", lambda i: ~anchored(i - 1)).alias("starts"), F.filter("every", lambda i: ~anchored(i + 1)).alias("ends"))
    unit = [*at, "run", "part", "n_lines"]
    parts = some.select(*at, F.explode(_units()).alias("u")).select(*at, "u.*")
    # pairs count where one of their words is a feature
    parts = parts.withColumn("hits", F.filter(F.sequence(F.lit(0), F.greatest(F.size("words"), F.lit(1)) - 1), lambda i: known(F.get("words", i))))
    pair = lambda a, b: F.concat(F.get("words", a), F.lit(" "), F.get("words", b))
    pairs = F.array_distinct(F.filter(F.flatten(F.transform("hits", lambda i: F.array(pair(i - 1, i), pair(i, i + 1)))), lambda x: x.isNotNull()))
    each = parts.select(*unit, F.array_distinct(F.transform("hits", lambda i: F.get("words", i))).alias("singles"), pairs.alias("pairs"))
    each = each.select(*unit, F.size("pairs").alias("n_pairs"), F.explode(F.concat("singles", "pairs")).alias("gram"))
    sums = [F.coalesce(F.sum(F.col("weights")[c]), F.lit(0.0)).alias(f"z{c}") for c in range(k + 2)] + [F.count_if(F.col("pair") & F.array_contains("notices", c)).alias(f"o{c}") for c in range(k)]
    by_part = each.join(F.broadcast(table), "gram").groupBy(*unit, "n_pairs").agg(*sums)
    by_class = [(F.col(f"z{c}") + m.bias[c]) / m.temperature for c in range(k + 2)]
    # what can't be likely, whatever the other licences add to the likeliest, goes before any probability is taken
    by_part = by_part.filter(F.greatest(*by_class[:-1]) - by_class[-1] >= math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY) / (k + 1)) - 1e-6)
    likeliest, top = F.greatest(*by_class[:-2]), F.greatest(*by_class)
    by_part = by_part.withColumns({"c": (F.array_position(F.array(*by_class[:-2]), likeliest) - 1).cast("int"), "total": sum(F.exp(z - top) for z in by_class), "likeliest": F.exp(likeliest - top), "none": F.exp(by_class[-1] - top)})
    by_part = by_part.withColumn("probability", F.col("likeliest") / F.col("total"))
    by_part = by_part.withColumn("overlap", F.get(F.array(*[F.col(f"o{c}") for c in range(k)]), F.col("c")) / F.greatest("n_pairs", F.lit(1)))
    by_part = by_part.withColumn("sure", (F.col("probability") >= LEAST_PROBABILITY) & (F.col("overlap") >= LEAST_OVERLAP)).withColumn("any", 1 - F.col("none") / F.col("total"))
    notices = by_part.filter(F.col("sure") | (F.col("any") >= LEAST_PROBABILITY))
    # a run that is one sure notice is that; else its lines count, and itself only where none of them does
    of_paragraph = Window.partitionBy("doc_id", "__h", "__r", "paragraph")
    of_run = Window.partitionBy("doc_id", "__h", "__r", "paragraph", "run")
    notices = notices.withColumns({"whole_sure": F.max(F.col("sure") & (F.col("part") == 0)).over(of_run), "n": F.count("*").over(of_run)})
    notices = notices.filter((F.col("run") < 0) | F.when(F.col("whole_sure"), F.col("part") == 0).otherwise((F.col("part") > 0) | (F.col("n_lines") == 1) | (F.col("n") == 1)))
    # what is wider than a run counts where it is sure and at most one of the others is, as the same family, or where there are no others
    narrow = F.col("run") >= 0
    notices = notices.withColumns({"n_narrow": F.count_if(narrow).over(of_paragraph), "n_sure": F.count_if(narrow & F.col("sure")).over(of_paragraph), "sure_c": F.max(F.when(narrow & F.col("sure"), F.col("c"))).over(of_paragraph)})
    fits = ~narrow & F.when(F.col("sure"), (F.col("n_sure") == 0) | ((F.col("n_sure") == 1) & (F.col("sure_c") == F.col("c")))).otherwise(F.col("n_narrow") == 0)
    # of two of them the sure one, then the narrower one
    notices = notices.withColumn("first", F.min(F.when(fits, F.struct((~F.col("sure")).alias("unsure"), "run"))).over(of_paragraph))
    notices = notices.filter(F.when(F.col("first").isNull(), narrow).otherwise(~narrow & (F.col("run") == F.col("first.run"))))
    named = F.when(F.col("sure"), F.element_at(F.lit(list(m.families)), F.col("c") + 1)).otherwise(UNKNOWN)
    notices = notices.select(*unit, named.alias("family"), F.when(F.col("sure"), F.col("probability")).otherwise(F.col("any")).alias("probability"), F.when(F.col("sure"), F.col("overlap")).otherwise(0.0).alias("overlap"), "sure", "c")
    best = notices.groupBy("doc_id", "__h").agg(
        F.max(F.struct("sure", F.round("probability", 9).alias("probability"), "overlap", (-F.col("c")).alias("c"), "family")).alias("best"), F.size(F.collect_set(F.struct("paragraph", "run", "part"))).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licenses")
    )
    best = best.withColumnsRenamed({"doc_id": "__d", "__h": "__g"})
    joined = rows.drop("text").join(best, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g")), "left")
    return joined.select(
        "doc_id",
        F.coalesce("best.family", F.lit(NONE)).alias("license"),
        F.coalesce("best.probability", F.lit(0.0)).alias("probability"),
        F.coalesce("best.overlap", F.lit(0.0)).alias("overlap"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )


def judge_paragraph(text: str, m: Model) -> tuple[bool, float, float, int, str] | None:
    """(sure, probability, overlap, minus the family's number, family) of a paragraph; None if it is no notice."""
    ws, k = tokens(text), len(m.families)
    z = np.array(m.bias) + sum((np.array(m.weights[g]) for g in set(ws) | {f"{a} {b}" for a, b in zip(ws, ws[1:])} if g in m.weights), np.zeros(k + 2))
    p = softmax(z / m.temperature)
    c = int(p[:k].argmax())
    pairs = pairs_of(ws, frozenset(m.words))
    overlap = sum(c in m.notices.get(g, ()) for g in pairs) / max(1, len(pairs))
    if p[c] >= LEAST_PROBABILITY and overlap >= LEAST_OVERLAP:
        return True, round(float(p[c]), 9), overlap, -c, m.families[c]
    return (False, round(float(1 - p[k + 1]), 9), 0.0, -c, UNKNOWN) if 1 - p[k + 1] >= LEAST_PROBABILITY else None


def scan_text(text: str | None, model: Model | None = None) -> tuple[str, int]:
    """The plain definition: best family and number of notices of one text."""
    m = model or train()
    found, vocabulary = [], frozenset(m.words)
    for paragraph in re.split(_GAP, re.sub(_BLANK.replace("(?md)", "(?m)"), "", text or "")):
        lines = paragraph.split("\n")
        has = [not vocabulary.isdisjoint(tokens(x)) for x in lines]
        anchored = [h and bool(re.search(_ANCHOR, x)) for h, x in zip(has, lines)]
        starts = [i for i, x in enumerate(anchored) if x and not (i and anchored[i - 1])]
        ends = [i + 1 for i, x in enumerate(anchored) if x and not (i + 1 < len(lines) and anchored[i + 1])]
        narrow = []
        for a, b in [*zip(starts, ends), *((i, i + 1) for i, x in enumerate(anchored) if not x)]:
            whole, each = judge_paragraph("\n".join(lines[a:b]), m), [y for x in lines[a:b] if (y := judge_paragraph(x, m))]
            narrow += [whole] if whole and (whole[0] or b - a == 1 or not each) else each
        wide = [judge_paragraph("\n".join(lines[a:b]), m) for a, b in ([(starts[0], ends[-1])] if len(starts) > 1 else []) + [(0, len(lines))] * (sum(has) > 1)]
        sure = [x[3] for x in narrow if x[0]]
        fits = [x for x in wide if x and (sure in ([], [x[3]]) if x[0] else not narrow)]
        found += [max(fits, key=lambda x: x[0])] if fits else narrow
    return (max(found)[4], len(found)) if found else (NONE, 0)
