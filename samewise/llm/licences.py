"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed by templates.

Paragraphs are blocks between blank lines, and the lines of each block. A multinomial logistic regression over word 1- and 2-grams, made
sparse by an L1 penalty, is fitted on labelled paragraphs: notices of each family, with variations, and as the
unknown class ordinary sentences and notices of other licences. A temperature, fitted on notices whose template the
fit did not see, calibrates its probabilities. A paragraph is given a family only if the family's probability is
`least_probability` or more and it shares `least_shared` of the words (but the most common ones) of the larger of
itself and one of the family's templates. Both must hold, so the cheaper is asked first: paragraphs that no template
of any family confirms need no score. The fit is small and made on the driver; texts are scanned and scored by built-in functions alone.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matches, quoted

_GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
_LESSER = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
_AFFERO = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
#: Notices by family; {x} is filled in with a kind of work. A family that starts another's name is that licence without its version.
TEMPLATES = {
    "agpl-3.0": [_AFFERO, "SPDX-License-Identifier: AGPL-3.0-or-later", "{x} is licensed under the GNU Affero General Public License version 3", "{x} is licensed under the AGPLv3"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "{x} is released under the terms of the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "Licensed under Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "apache-2.0 or mit": ["Dual licensed: Apache-2.0 OR MIT", "SPDX-License-Identifier: MIT OR Apache-2.0", "Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", "{x} is dual licensed under MIT or Apache-2.0"],
    "bsd-2-clause": ["{x} is released under the 2-clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause", "{x} is licensed under the simplified BSD license"],
    "bsd-3-clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD, "{x} is released under the 3-clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "{x} is available under the Creative Commons Attribution license CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "{x} is available under CC-BY-NC-4.0 for noncommercial use only"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "{x} is available under CC-BY-SA-4.0"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.", "{x} is dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "epl-2.0": ["Released to the public under the Eclipse Public License v2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": [
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation", "{x} is licensed under the GPL", "{x} is distributed under the GNU General Public License.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GPL.format(v=2), "SPDX-License-Identifier: GPL-2.0-only", "{x} is distributed under the terms of the GNU GPL version 2", "Use is under GPLv2", "Licensed under GPLv2", "{x} is released under the GNU GPL v2"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GPL.format(v=3), "SPDX-License-Identifier: GPL-3.0-or-later", "{x} is distributed under the terms of the GNU GPL version 3", "Use is under GPLv3", "Licensed under GPLv3", "{x} is released under the GNU GPL v3"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "{x} is licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "lgpl-2.1": [_LESSER.format(v="2.1"), "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "{x} is released under the LGPLv2.1"],
    "lgpl-3.0": [_LESSER.format(v=3), "This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later", "{x} is distributed under the GNU LGPL version 3"],
    "mit": [
        "Released under the MIT License.", "{x} is licensed under the MIT license", "SPDX-License-Identifier: MIT", "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "SPDX-License-Identifier: MPL-2.0", "{x} is available under the Mozilla Public License version 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "{x} is released under the Unlicense", "SPDX-License-Identifier: Unlicense"],
}
#: Paragraphs of no family, notices of other licences among them.
UNKNOWN = [
    "You need a driving license to rent a car in version 2.0 of the programme.", "The licensed engineer signed the work under the general terms.", "All rights reserved.", "See the LICENSE file for details.", "Copyright (c) 2020 the authors", "Their license was revoked by the public office.",
    "The software was released in the spring and sold in three versions.", "He gave permission to use the house for the summer.", "A creative person is common in this public place.", "The foundation published a free report on source material.", "Licensed premises must close at eleven.",
    "This file is subject to change.", "General conditions of the public library apply.", "Subject to the terms of the agreement between the two parties", "The Apache helicopter landed near the river.", "She studied at MIT before the war.", "MIT", "Attribution of the painting is disputed.", "Redistribution of wealth was the subject of the speech.",
    "No license is granted by implication.", "The dog license costs four euros.", "The following conditions are met in most gardens.", "Version 3 of the manual is out.", "They obtained a copy of the document free of charge.", "The work is in the public eye.", "The license plate was found on the road.",
    "Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0", "This code is distributed under the zlib license.", "SPDX-License-Identifier: Zlib", "Licensed under the Microsoft Public License.", "Released under the Do What The Fuck You Want To Public License", "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the EUPL, Version 1.2", "The contents of this file are subject to the terms of the Common Development and Distribution License", "This product is licensed under the Python Software Foundation License", "Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This is proprietary software; use is governed by the end user license agreement.", "Use of this product requires a commercial license from the vendor.", "Licensed to the customer under a non-exclusive, non-transferable license.", "Distributed under the terms of the PostgreSQL License", "Released under the Apache Software License, Version 1.1.",
    "The MIT campus has a licensed cafe.", "The general public was free to modify the program of the evening.", "The author waived the fee for the concert in the domain.", "Software engineers work under general conditions in this country.", "Permission to enter is granted to any person with a ticket.", "The public library has a copy of the source in binary form.",
]
WORKS = ["This project", "The software", "This repository", "The code", "This document", "The data set", "This work", "Use"]
#: Words that say nothing when paragraphs are compared; nor do years.
STOP = "c copyright author authors all rights reserved a an and any are as at be been by can for from has have he if in into is it its may more not of on or other she should such that the their they this to under was were which who will with you your".split()
#: Least probability: the calibrated one is of notices with words the fit never saw, so low even where a template then confirms it.
LEAST = 0.25
YEAR = "^[12][0-9]{3}$"
WORD = "[a-z0-9](?:[a-z0-9.+-]*[a-z0-9])?"
#: What lies between words, for split(); and between blocks, and between paragraphs of one notice.
BETWEEN, BLANK, GAP = "[.+-]*+[^a-z0-9.+-][^a-z0-9]*+", r"\n[\x20\t\r]*\n\s*", r"^[\s*#/;%<>!-]*$"


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(text: str) -> list[str]:
    """Distinct word 1- and 2-grams of a paragraph, as the SQL gives them."""
    w = words(text)
    return list(dict.fromkeys([*w, *map(" ".join, zip(w, w[1:]))]))


def content(text: str) -> set[str]:
    return {w for w in words(text) if not re.search(YEAR, w)} - set(STOP)


def templates() -> list[tuple[str, list[str]]]:
    """(family, its words) of every notice."""
    return [(f, sorted(content(t.replace("{x}", "")))) for f, texts in TEMPLATES.items() for t in texts]


def labelled(copies: int = 6, seed: int = 3) -> list[tuple[str, str, int]]:
    """(paragraph, family or 'unknown', number of its template): the notices and ordinary sentences, varied by lost words, years, holders and other sentences around."""
    r = random.Random(seed)
    out = []
    every = [(f, t) for f, texts in [*TEMPLATES.items(), ("unknown", UNKNOWN)] for t in texts]
    for number, (family, t) in enumerate(every):
        for k in range(copies):
            own = t.format(x=r.choice(WORKS)).split()
            if k > 1 and len(own) > 8:
                own = [w for w in own if r.random() > 0.12 or w[:1].isdigit()]
            if k % 3 == 2:
                own = ["Copyright", "(c)", str(r.randint(1995, 2025)), "the", "authors."] + own
            if k == 4:
                own += r.choice(UNKNOWN[:26]).split() if family == "unknown" else ["All", "rights", "reserved."]
            out.append((" ".join(own), family, number))
    return out


@dataclass
class Model:
    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]

    def judged(self, text: str) -> tuple[str, float]:
        """Family and probability of a paragraph."""
        g = grams(text)
        sums = [0.0] * len(self.classes)
        for t in g:
            if t in self.weights:
                sums = [a + b for a, b in zip(sums, self.weights[t])]
        z = [a / math.sqrt(max(len(g), 1)) + b for a, b in zip(sums, self.bias)]
        return self.classes[z.index(max(z))], 1 / sum(math.exp(v - max(z)) for v in z)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, str, int]], rounds: int = 100, penalty: float = 2e-4, folds: int = 3) -> Model:
    """Multinomial logistic regression by accelerated proximal steps; weights are divided by the calibrating temperature.

    The temperature is the one of least loss on paragraphs whose templates (a fold of them at a time) were held out.
    """
    classes = [*sorted({f for _, f, _ in samples} - {"unknown"}), "unknown"]
    rows = [(grams(t), classes.index(f)) for t, f, _ in samples]
    often = Counter(g for own, _ in rows for g in own)
    names = sorted(g for g, n in often.items() if n > 1)
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (own, _) in enumerate(rows):
        x[i, [place[g] for g in own if g in place]] = 1 / np.sqrt(len(own))
    y = np.array([c for _, c in rows])
    goal = np.eye(len(classes), dtype=np.float32)[y]

    def train(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xs, gs, rate = x[own], goal[own], 2.0 * len(classes) / 4
        w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
        ahead, last, step = w, w, 1.0
        for _ in range(rounds):
            p = softmax(xs @ ahead + b) - gs
            w = ahead - rate * xs.T @ p / len(xs)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
            b = b - rate * p.mean(axis=0)
            after = (1 + math.sqrt(1 + 4 * step * step)) / 2
            ahead, last, step = w + (step - 1) / after * (w - last), w, after
        return w, b

    fold = np.array([n % folds for _, _, n in samples])
    heats, loss = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0], np.zeros(8)
    for k in range(folds):
        held = fold == k
        if held.any() and not held.all():
            w, b = train(~held)
            z = x[held] @ w + b
            loss += [-np.log(softmax(z / h)[np.arange(held.sum()), y[held]] + 1e-12).sum() for h in heats]
    heat = heats[int(np.argmin(loss))]
    w, b = train(np.ones(len(rows), bool))
    return Model(classes, {g: [round(float(v) / heat, 4) for v in w[i]] for i, g in enumerate(names) if w[i].any()}, [round(float(v) / heat, 4) for v in b])


@lru_cache(maxsize=1)
def standard() -> Model:
    return fit(labelled())


def shared(text: str, family: str) -> float:
    """The largest share of common words with a template of the family, of the larger side; no less than two words count."""
    v = content(text)
    return max((len(both) / max(len(v), len(t)) for f, t in templates() if f == family and len(both := v.intersection(t)) > 1), default=0.0)


def literal(value, kind: str) -> str:
    return f"from_json({quoted(json.dumps(value))}, '{kind}')"


def let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `value` computed once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def licences(docs: DataFrame, model: Model | None = None, least_probability: float = LEAST, least_shared: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, found): arrays of structs (start, end, family, probability, shared), one per notice, in order of place.

    Places are code points of the whole text. A block counts as one paragraph if it is confirmed, else its lines do.
    Neighbours of one family, but for white space and comment marks between, are one notice; of families with equal
    probability the first in alphabetical order wins. Null and empty texts have none; repeated rows stay; an empty table gives an empty
    one; other columns go, whatever their names. No shuffle: one narrow pass.
    """
    model = model or standard()
    known = [(f, t) for f, t in templates() if f in model.classes]
    every = sorted({w for _, t in known for w in t})
    names, grid = sorted(model.weights), literal([{"f": f, "t": t} for f, t in known], "array<struct<f: string, t: array<string>>>")
    split_up = f"split(lower(concat(' ', {{}}, ' ')), {quoted(BETWEEN)})"
    kind = "array<struct<start: int, end: int, family: string, probability: double, shared: double>>"
    none = f"cast(array() AS {kind})"
    enough = "greatest(2, ceil(t.size * {0}))".format(least_shared)
    sized = literal([{"size": len(t), "t": t} for t in sorted({tuple(t) for _, t in known})], "array<struct<size: int, t: array<string>>>")
    # a paragraph's words are the text's, so a text that has too few of every template has no notice
    some = let(f"array_intersect({split_up.format('_text')}, {literal(every, 'array<string>')})", "h", f"size(h) > 1 AND exists({sized}, t -> size(array_intersect(h, t.t)) >= {enough})")
    blocks = matches("_text", BLANK, gaps=True)
    lines = f"transform({matches('b.text', '[^\\n]+')}, l -> named_struct('start', b.start + l.start, 'end', b.start + l.end, 'text', l.text))"
    units = f"flatten(transform({blocks}, b -> CASE WHEN b.text LIKE '%\\n%' THEN concat(array(b), {lines}) ELSE array(b) END))"
    # words of each unit and the families whose templates confirm it
    share = "size(array_intersect(v, g.t)) / greatest(size(v), size(g.t))"
    confirm = f"filter(transform({grid}, g -> named_struct('f', g.f, 's', CASE WHEN size(array_intersect(v, g.t)) > 1 THEN {share} ELSE 0D END)), g -> g.s >= {least_shared})"
    content_of = f"filter(array_except(w, {literal(STOP, 'array<string>')}), t -> NOT t rlike '{YEAR}')"
    weighed = let(f"filter({split_up.format('u.text')}, t -> t <> '')", "w", f"named_struct('start', u.start, 'end', u.end, 'text', u.text, 'w', w, 'c', {let(content_of, 'v', confirm)})")
    likely = f"filter(transform({units}, u -> {weighed}), u -> size(u.c) > 0)"
    # scores
    both = "array_distinct(concat(u.w, CASE WHEN size(u.w) > 1 THEN transform(sequence(0, size(u.w) - 2), i -> concat(u.w[i], ' ', u.w[i + 1])) ELSE cast(array() AS array<string>) END))"
    vocabulary, table = literal(names, "array<string>"), literal([model.weights[g] for g in names], "array<array<double>>")
    sums = f"aggregate(array_intersect(g, {vocabulary}), array_repeat(0D, {len(model.classes)}), (a, t) -> zip_with(a, {table}[cast(array_position({vocabulary}, t) - 1 AS int)], (p, q) -> p + q))"
    logits = let(both, "g", f"zip_with({sums}, {literal(model.bias, 'array<double>')}, (p, q) -> p / sqrt(greatest(size(g), 1)) + q)")
    best = let(logits, "z", let("array_max(z)", "m", f"named_struct('family', {literal(model.classes, 'array<string>')}[cast(array_position(z, m) - 1 AS int)], 'probability', 1 / aggregate(z, 0D, (a, v) -> a + exp(v - m)))"))
    trim = "length(u.text) - length(regexp_replace(u.text, '^[\\\\s*#/;%<>!-]+', ''))"
    tail = "length(u.text) - length(regexp_replace(u.text, '\\\\s+\\\\z', ''))"
    spot = f"named_struct('start', cast(u.start + {trim} AS int), 'end', cast(u.end - ({tail}) AS int), 'family', p.family, 'probability', round(p.probability, 4), 'shared', round(array_max(transform(filter(u.c, c -> c.f = p.family), c -> c.s)), 4))"
    judged = f"transform({likely}, u -> {let(best, 'p', f"CASE WHEN p.probability >= {least_probability} AND p.family <> 'unknown' AND exists(u.c, c -> c.f = p.family) THEN {spot} END")})"
    # of a found block and its lines the block; then neighbours of one family
    kept = let(f"filter({judged}, x -> x IS NOT NULL)", "f", "filter(f, x -> NOT exists(f, y -> y.start <= x.start AND y.end >= x.end AND y.end - y.start > x.end - x.start))")
    last = "element_at(a, -1)"
    same = f"size(a) > 0 AND ({last}.family = x.family OR startswith({last}.family, concat(x.family, '-')) OR startswith(x.family, concat({last}.family, '-'))) AND substring(_text, {last}.end + 1, x.start - {last}.end) rlike {quoted(GAP)}"
    wider = f"named_struct('start', {last}.start, 'end', x.end, 'family', CASE WHEN length(x.family) > length({last}.family) THEN x.family ELSE {last}.family END, 'probability', least({last}.probability, x.probability), 'shared', least({last}.shared, x.shared))"
    merged = f"aggregate({kept}, {none}, (a, x) -> CASE WHEN size(a) = 0 THEN array(x) WHEN {same} THEN concat(slice(a, 1, size(a) - 1), array({wider})) ELSE concat(a, array(x)) END)"
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.select(id_col, F.expr(f"CASE WHEN {some} THEN {merged} ELSE {none} END").alias("found"))


def summary(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_licences, families (distinct, in order) and spans (family:start:end, in order of place), one row per document."""
    return rows.select(
        id_col,
        F.size("found").cast("long").alias("n_licences"),
        F.expr("array_join(array_sort(array_distinct(transform(found, x -> x.family))), ',')").alias("families"),
        F.expr("array_join(transform(found, x -> concat(x.family, ':', x.start, ':', x.end)), ',')").alias("spans"),
        F.expr("array_min(transform(found, x -> x.probability))").alias("least_probability"),
    )
