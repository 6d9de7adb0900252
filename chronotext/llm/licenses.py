"""Operator 6, licence scans by a trained paragraph classifier, with DataFrame functions only.

A paragraph is what stands between lines without a letter or digit, so wrapped and commented notices are whole. Runs
of RUN words of it, STEP apart, are scored by a multinomial logistic regression on word unigrams and bigrams (those of
common words alone have no weight); its class "unknown" has a bias calibrated on held-out text that names no family.
A prediction is confirmed when the run holds enough of the n-grams of one of the family's templates. The model is fitted
on the driver from the templates below and made text, so it depends on no data and is the same everywhere.

Every run of every text is looked at, but most of them only by a bound: no run scores above "unknown" unless the
largest weights that its words can bring outweigh the bias, and only such runs get all their scores. All of it is a
projection of one row: no join, no shuffle, and memory in proportion to the longest text.

Null and empty texts have no paragraphs; null and repeated ids give rows as they come; an empty table gives no
rows; columns other than the id and the text are not read. Very long paragraphs are scored in runs like any other.
Of runs that tie, the first counts.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

UNKNOWN = "unknown"
#: Words of a run, and from one run's start to the next.
RUN, STEP = 96, 48
#: Share of a template's n-grams that confirms it, and of held-out unknown text that must stay unknown.
CONFIRM, CALIBRATED = 0.6, 0.999
#: Slots of the table in which n-grams' weights are found, and made texts that an n-gram with weights is in, at least.
SLOTS, LEAST_TEXTS = 1 << 15, 6

# Notices of each family as they are commonly written.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ],
    "mit": [
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Use of this source code is governed by an MIT-style license.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "Licensed under the GPLv3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Licensed under the GPLv2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "lgpl-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the LGPL 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the AGPLv3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the Simplified BSD License, two clauses."],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "isc": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", "SPDX-License-Identifier: BSL-1.0"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
# Sentences in the words of licences that name no family.
OTHERS = [
    "The driver's license was renewed in the city office.", "All copyright belongs to its owners.", "She asked for permission to leave early.", "The redistribution of land went on for years.",
    "His license to practise was withdrawn.", "The song is in the public domain.", "A license plate was found near the road.", "See the license file for details.", "Copyright all rights reserved by the authors.",
    "No permission is needed to enter the park.", "The licence fee rises every year.", "Without written permission nothing may be copied.", "Fishing licenses are sold at the gate, version two of the form.",
    "The general public was asked to apply for a license.", "Released under the stars, the doves needed no permission.", "This work is licensed to nobody.", "No part of this publication may be reproduced, stored or transmitted in any form or by any means without the prior written permission of the publisher.",
    "The software is sold as it is and the company gives no warranty of any kind beyond what the law requires.", "By using this site you agree to the terms of service and to the privacy policy.", "The foundation published the third version of its report, with free copies for any person who asked.",
    "Version 2 of the file was modified and distributed to the members of the committee.", "The source of the river and the binary star were both found by the same person.", "The apache helicopter was licensed for export under the new law.", "He studied at MIT and was released under bail.",
    "Creative people at the commons share their work with attribution.", "The public library has a lesser known general collection.", "The Mozilla office moved, and the terms of the lease are subject to change.", "A boost of funds was distributed to schools.",
]
# How the families are called in running text.
NAMES: dict[str, list[str]] = {
    "apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license"],
    "mit": ["MIT License", "MIT license", "Expat (MIT) license"],
    "gpl-3.0": ["GNU General Public License v3.0", "GPL version 3", "GNU GPLv3", "GPL-3.0"],
    "gpl-2.0": ["GNU General Public License v2.0", "GPL version 2", "GNU GPLv2", "GPL-2.0"],
    "lgpl-2.1": ["GNU Lesser General Public License v2.1", "LGPL version 2.1", "GNU LGPL 2.1"],
    "agpl-3.0": ["GNU Affero General Public License v3.0", "AGPL version 3", "GNU AGPLv3"],
    "bsd-3-clause": ["BSD 3-Clause License", "three-clause BSD license", "new BSD license"],
    "bsd-2-clause": ["BSD 2-Clause License", "two-clause BSD license", "simplified BSD license"],
    "mpl-2.0": ["Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License, version 2.0"],
    "isc": ["ISC License", "ISC license"],
    "bsl-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "cc-by-4.0": ["CC BY 4.0 license", "Creative Commons Attribution 4.0 license"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 license"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 license"],
    "cc0-1.0": ["CC0 1.0 Universal dedication", "Creative Commons Zero (CC0)"],
    "unlicense": ["Unlicense", "Unlicense public domain dedication"],
}
#: Sentences in which the model learns the names, and others in which only the tests use them.
FORMS = ("Released under the {}.", "Licensed under the {}.", "This project is licensed under the terms of the {}, see the file.", "License: {}", "{} applies to this file.")
HELD_FORMS = ("Everything here is made available under the {}.", "You may use this code under the {} only.", "Distributed according to the {}", "The authors chose the {} for this package.")
# Common words of some languages, which surround notices in made text.
FILLER = "the of and a to in is it that for on as with was at by be this are from or not have you we they his her its all an which one can there their if will more other some any no use file work copy free der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an la le de et les des en un du une que est pour qui dans par plus pas au sur el los las por con una su para como del se lo".split()


#: Words of the texts above that are not common ones; every n-gram with weights holds one.
VOCABULARY = tuple(sorted({w for ts in (*TEMPLATES.values(), *NAMES.values(), FORMS, OTHERS) for t in ts for w in re.findall("[a-z0-9]+", t.lower())} - set(FILLER)))


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams(own: list[str]) -> list[tuple[str, ...]]:
    """Distinct unigrams and bigrams."""
    return list(dict.fromkeys([*zip(own), *zip(own, own[1:], strict=False)]))


def code(gram: tuple[str, ...]) -> int:
    """A gram's hash as Spark's xxhash64 makes it (the next word's seed is the hash so far), signed."""
    h = 42
    for w in gram:
        h = xxhash.xxh64_intdigest(w, h)
    return h - (1 << 64) if h >= 1 << 63 else h


def made_text(rng: random.Random, text: str) -> list[str]:
    """A notice with dropped words among common words; some of what surrounds it is a stray word of a licence."""
    noise = lambda n: [rng.choice(FILLER) for _ in range(rng.randint(0, n))]
    n = rng.choice((4, 12, 36))
    return noise(n) + [w for w in words(text) if rng.random() > 0.06] + noise(n)


def examples(rng: random.Random, copies: int) -> list[tuple[list[str], int]]:
    """(words, class) of made text; the last class is the unknown one."""
    out = [(made_text(rng, t), k) for k, ts in enumerate(TEMPLATES.values()) for t in ts for _ in range(copies)]
    out += [(made_text(rng, rng.choice(FORMS).format(n)), k) for k, c in enumerate(TEMPLATES) for n in NAMES[c] for _ in range(copies)]
    shuffled = lambda t: " ".join(rng.sample(w := t.split(), len(w)))
    out += [(made_text(rng, f(t)), len(TEMPLATES)) for t in OTHERS for f in (str, shuffled) for _ in range(copies)]
    families = [w for c in TEMPLATES for w in {w for t in TEMPLATES[c] + NAMES[c] for w in words(t)}]
    every = sorted({w for w in families if families.count(w) > 2})  # no family's own words
    stray = [[rng.choice(every) if rng.random() < 0.08 else rng.choice(FILLER) for _ in range(rng.randint(1, RUN))] for _ in range(copies * 30)]
    return out + [(w, len(TEMPLATES)) for w in stray]


@lru_cache(1)
def trained(seed: int = 3, copies: int = 16, steps: int = 220) -> tuple[tuple[str, ...], dict[tuple[str, ...], np.ndarray], np.ndarray]:
    """(classes, weights of each n-gram by class, biases). N-grams have a slot each: of several in one, vocabulary first,
    the most frequent stays."""
    rng = random.Random(seed)
    data = examples(rng, copies)
    rng.shuffle(data)
    held, data = data[: len(data) // 5], data[len(data) // 5 :]
    common, vocabulary = set(FILLER), {(w,) for w in VOCABULARY}
    sets = [[g for g in grams(own) if not common.issuperset(g)] for own, _ in data]
    often = Counter(g for own in sets for g in own)
    slot: dict[int, tuple[str, ...]] = {}
    for g in sorted(vocabulary | {g for g, n in often.items() if n >= LEAST_TEXTS}, key=lambda g: (g not in vocabulary, -often[g], g)):
        slot.setdefault(code(g) % SLOTS, g)
    at = {g: k for k, g in enumerate(sorted(slot.values()))}
    if missing := vocabulary - at.keys():
        raise ValueError(f"words share a slot: {missing}")
    x = np.zeros((len(data), len(at)), np.float32)
    for i, own in enumerate(sets):
        x[i, [at[g] for g in own if g in at]] = 1
    y = np.eye(len(TEMPLATES) + 1, dtype=np.float32)[[k for _, k in data]]
    w, b = np.zeros((len(at), y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    short = 1 / np.sqrt(x.sum(1, keepdims=True) + 1)  # long texts make short steps
    for step in range(steps):
        s = x @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        off = short * (y - p / p.sum(1, keepdims=True))
        rate = 40 / (1 + step / 40)
        w += rate * (x.T @ off / len(data) - 2e-5 * w)
        b += rate * 0.02 * off.mean(0)
    weights = {g: np.round(w[k].astype(float), 3) for g, k in at.items()}
    bias = np.round(b.astype(float), 3)
    # the unknown class: raised until enough held-out unknown text stays so
    margins = sorted(max(s[:-1]) - s[-1] for own, k in held if k == len(TEMPLATES) for s in [scores(own, weights, bias)])
    bias[-1] = round(bias[-1] + max(0.0, margins[min(len(margins) - 1, int(CALIBRATED * len(margins)))]), 3)
    return (*TEMPLATES, UNKNOWN), weights, bias


def scores(own: list[str], weights: dict[tuple[str, ...], np.ndarray], bias: np.ndarray) -> np.ndarray:
    return bias + sum((weights[g] for g in grams(own) if g in weights), np.zeros(len(bias)))


def most(weights: dict[tuple[str, ...], np.ndarray]) -> dict[str, float]:
    """For each word of the vocabulary, no less than what a place with it adds to a family's margin over unknown: the word's own weight, and
    the largest of a bigram that begins with it and of one that ends with it after a common word."""
    margin = {g: max(0.0, float((w[:-1] - w[-1]).max())) for g, w in weights.items()}
    known = set(VOCABULARY)
    first, second = Counter(), Counter()
    for g, m in margin.items():
        if len(g) == 2 and g[0] in known:
            first[g[0]] = max(first[g[0]], m)
        elif len(g) == 2 and g[1] in known:
            second[g[1]] = max(second[g[1]], m)
    return {w: margin[w,] + first[w] + second[w] for w in VOCABULARY}


def _table(values: list, kind: str) -> Column:
    """A constant array, which Spark folds to one literal: element k is found at once."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, paragraph (from 0), first_word of the best run, family, probability, covered (of the best template) and
    confirmed, for each paragraph in which a run is likelier a family's than unknown; confirmed runs come before others,
    then the largest margin over unknown."""
    classes, weights, bias = trained()
    last, caps = len(classes) - 1, most(weights)
    needed = float((bias[last] - bias[:last]).min())
    short = lambda a: [int(v) if v == int(v) else round(float(v), 4) for v in a]
    order = sorted(weights)
    row = [-1] * SLOTS
    for k, g in enumerate(order):
        row[code(g) % SLOTS] = k
    rows, keys = _table(row, "array<int>"), _table(list(map(code, order)), "array<bigint>")
    weight_of = _table([short(weights[g]) for g in order], "array<array<double>>")
    cap_of = _table(short([caps[g[0]] and caps[g[0]] + 1e-3 if len(g) == 1 else 0 for g in order]), "array<double>")
    known = _table([{"k": k, "n": len(h), "h": h} for k, ts in enumerate(TEMPLATES.values()) for t in ts for h in [list(map(code, grams(words(t))))]], "array<struct<k:int,n:int,h:array<bigint>>>")
    place = lambda h: F.get(rows, F.pmod(h, F.lit(SLOTS)).cast("int"))

    def scored(w: Column, s: Column) -> Column:
        """Of the run that starts at s: confirmed, margin, -s, covered, class, probability."""

        def verdict(u: Column, r: Column) -> Column:
            total = F.transform(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(b)).alias("b")) for k, b in enumerate(bias))), lambda c: F.aggregate(r, c["b"], lambda a, x: a + F.get(F.get(weight_of, x), c["k"])))

            def best(t: Column) -> Column:
                top = F.array_max(F.slice(t, 1, last))
                k = (F.array_position(t, top) - 1).cast("int")
                share = F.coalesce(F.array_max(F.transform(F.filter(known, lambda x: x["k"] == k), lambda x: F.size(F.array_intersect(u, x["h"])) / x["n"])), F.lit(0.0))
                exp = F.aggregate(t, F.lit(0.0), lambda a, x: a + F.exp(x - top))
                return let(share, lambda c: F.struct((c >= CONFIRM).alias("confirmed"), (top - F.get(t, F.lit(last))).alias("margin"), (-s).alias("at"), c.alias("covered"), k.alias("k"), (1 / exp).alias("p")))

            return let(total, best)

        def of(v: Column) -> Column:
            pairs = F.zip_with(v, F.slice(v, 2, F.lit(RUN)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
            own = F.array_distinct(F.array_compact(F.concat(F.transform(v, lambda x: F.xxhash64(x)), pairs)))
            weighted = lambda u: F.transform(F.filter(u, lambda h: F.get(keys, place(h)) == h), place)
            return let(own, lambda u: let(weighted(u), lambda r: verdict(u, r)))

        return let(F.slice(w, s + 1, F.lit(RUN)), of)

    def best_run(w: Column) -> Column:
        # the last run ends with the paragraph
        starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.size(w) - RUN, F.lit(0)) / STEP).cast("int") * STEP, F.lit(STEP))
        caps = F.transform(w, lambda x: F.when(x.isin(*VOCABULARY), F.get(cap_of, place(F.xxhash64(x)))).otherwise(F.lit(0.0)))
        enough = lambda m: F.filter(starts, lambda s: F.aggregate(F.slice(m, s + 1, F.lit(RUN)), F.lit(0.0), lambda a, x: a + x) > needed)
        likely = let(caps, lambda m: F.when(F.exists(m, lambda x: x > 0), enough(m)))
        return let(likely, lambda a: F.array_max(F.filter(F.transform(a, lambda s: scored(w, s)), lambda r: r["margin"] > 0)))

    paragraphs = F.split(F.lower(F.col(text_col)), r"\n(?:[^\p{L}\p{N}\n]*+\n)+")
    found = docs.select(F.col(id_col), F.posexplode(paragraphs).alias("paragraph", "_p"))
    # behind explode, so that no filter or column of it is worked out again
    best = F.array_compact(F.array(let(F.array_remove(F.split("_p", "[^a-z0-9]++"), ""), best_run)))
    found = found.select(id_col, "paragraph", F.explode(best).alias("_r"))
    family = F.element_at(F.array(*map(F.lit, classes)), F.col("_r.k") + 1)
    return found.select(id_col, "paragraph", (-F.col("_r.at")).alias("first_word"), family.alias("family"), F.round("_r.p", 6).alias("probability"), F.round("_r.covered", 6).alias("covered"), F.col("_r.confirmed").alias("confirmed"))


def op6_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
