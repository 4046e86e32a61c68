"""License scans by a trained paragraph classifier, in DataFrame operations only.

Paragraphs become word n-grams of one to three words. They are the lines, and the runs of
lines between blank ones, joined without their comment marks, since licences are
wrapped; a joined paragraph adds nothing to a line of its own that has the same family. A sparse multinomial
logistic regression over the n-grams of the licence templates, trained on the driver
from short notices, the paragraphs of whole licences, their variants and ordinary sentences, gives each licence family
and `unknown` a probability; a temperature and a least probability, calibrated on
variants left out of training, decide what counts as unknown. A prediction is confirmed by comparing the
paragraph with the family's templates: the share of a template's distinct n-grams that
the paragraph holds.

Only n-grams with an anchor (a long word of a template, or a listed short one) have
weights, so a paragraph without anchors is unknown, and its n-grams are never made. The
others meet a broadcast table whose size the templates bound. Nothing is grouped by anything but a paragraph of a row.

Null and empty texts have no paragraph and no finding. Rows that repeat are scanned each,
by themselves, and so are rows without id. Texts of any length are read whole. Of
families of equal probability the first of the list counts. An empty table gives an empty
result; other columns are neither read nor returned.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

UNKNOWN = "unknown"
#: N-grams of up to so many words.
GRAMS = 3
#: Share of a template's weighted n-grams that confirms a paragraph.
CONFIRM = 0.6
#: Of variants left out of training, the share that must stay known, sets the least probability, from FLOOR up.
KEPT_SHARE, FLOOR = 0.98, 0.5

# Statements and first words of common licences, by family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT license", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "Released under the GNU GPL v2 or later", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "Released under the new BSD license", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under the Creative Commons Attribution license", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved.", "Copyright (c) 2024 the authors. All rights reserved. Unauthorized copying of this file is strictly prohibited", "This software is proprietary and confidential"],
}
# Paragraphs of licences in full, by family.
PARAGRAPHS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "SPDX-License-Identifier: ISC", "Released under the ISC License",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Apache-2.0": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ],
    "LGPL": [
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "MPL-2.0": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY": ["You are free to share, copy and redistribute the material in any medium or format, and adapt, remix, transform, and build upon the material for any purpose, even commercially, under the Creative Commons Attribution 4.0 terms."],
    "CC-BY-SA": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original, Creative Commons Attribution-ShareAlike."],
    "CC-BY-NC": ["You may not use the material for commercial purposes under Creative Commons Attribution-NonCommercial."],
    "CC0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
}
for _family, _texts in PARAGRAPHS.items():
    TEMPLATES[_family] = [*TEMPLATES.get(_family, ()), *_texts]
#: Letters of a word that is an anchor, and shorter words that are.
ANCHOR_LETTERS = 5
ANCHORS = ("gnu", "gpl", "lgpl", "agpl", "bsd", "cc", "cc0", "mpl")
# Ordinary sentences with words that licences also use.
ORDINARY = [
    "The library opens at nine and the public may use it free of charge.", "You need a driving license to rent the car.", "This version of the work was published in January 2004.", "The terms of the contract were discussed by the authors.", "He was granted permission to copy the file.",
    "The software is free and the source is open to any person.", "All the documentation files are in the folder.", "Version 2 of the program was released in June.", "She reserved the rights to the story.", "The general public was not informed of the conditions.",
    "Modern forms of distribution are used with or without a label.", "The foundation published its report.", "Please sign the form under the line.", "It is subject to change.", "The creative work of the commons is shared.", "A clause of the law applies to the following case.",
    "The domain of the function is public.", "Notice of the meeting was given.", "The MIT campus is in Cambridge.", "An apache helicopter landed.", "The new server is a BSD machine.", "to the extent possible we share alike", "they redistribute food to people in need", "the copy of the letter is strictly private", "wir gehen mit der Familie und mit dem Hund nach Hause", "el trabajo general de la licencia", "la version de la source est publique",
    "The notice on the door says that the office is closed.", "Her permission was not required for the use of the hall.", "The conditions in the following weeks were worse.", "The warranty of the car covers any damage in the first year.", "He is liable for the damages under the contract.",
    "In no event was the court open on Sunday.", "The particular purpose of the meeting was to agree on a price.", "Copies of the book were distributed in the villages.", "The name of the holder is written on the card.", "Contributors to the journal are paid by the line.",
    "All the rights of the author are described in the law.", "The original version of the story was published without the last chapter.", "You can obtain a copy at the counter.", "Anyone is free to use the commercial gate for any purpose.", "The distribution of water is subject to restrictions.",
    "The documentation of the case must be plainly marked.", "The library is distributed over two floors.", "This program is shown on television every week.", "You should have received a letter along with this parcel.", "The foundation will write to the general assembly.",
]


def _literal(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows as one literal of the plan, in JSON."""
    names = [c.split()[0] for c in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(c.replace(" ", ": ", 1) for c in ddl.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def words_of(paragraph: Column) -> Column:
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}.+-]+|[.](?=\s|$)"), "")


def grams_of(words: Column) -> Column:
    """The word n-grams, with repeats, of a column that is computed once."""
    n = F.size(words)
    out = [words]
    for k in range(2, GRAMS + 1):
        parts = reduce(lambda a, i, k=k: F.zip_with(a, F.slice(words, i + 1, F.greatest(n - k + 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y)), range(1, k), F.slice(words, 1, F.greatest(n - k + 1, F.lit(0))))
        out.append(F.when(n >= k, parts).otherwise(F.array().cast("array<string>")))
    return F.concat(*out)


class Classifier:
    """families: with unknown; weights: (gram, one weight for each family); bias; least: the least probability of a known family."""

    def __init__(self, families: list[str], grams: list[str], weights: list[list[float]], bias: list[float], temperature: float, least: float):
        self.families, self.grams, self.weights, self.bias, self.temperature, self.least = families, grams, weights, bias, temperature, least


def _variants(family: str, text: str) -> list[tuple[str, str, int]]:
    """(family, text, left out): a template as it stands, shortened, and among other words."""
    w = text.split()
    out = [(family, text, 0), (family, " ".join(w[: max(4, len(w) * 3 // 4)]), 0), (family, f"see the notes: {text} thank you", 0)]
    held = [(family, f"{text} and more about this can be read in the other file", 1), (family, " ".join(w[: max(4, len(w) * 2 // 3)]), 1)]
    return out + held


def sparse_softmax(x: np.ndarray, y: np.ndarray, k: int, penalty: float = 2e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of an L1-penalised multinomial logistic regression, by accelerated proximal gradient."""
    n, p = x.shape
    z, target = np.column_stack([np.ones(n), x]).astype(np.float64), np.eye(k)[y]
    w = v = np.zeros((p + 1, k))
    u = np.ones(p + 1)
    for _ in range(30):  # the largest eigenvalue bounds the curvature
        u = z.T @ (z @ u)
        u /= np.linalg.norm(u)
    step, t = 2 * n / (np.linalg.norm(z @ u) ** 2 * 1.05), 1.0
    for _ in range(rounds):
        e = np.exp((s := z @ v) - s.max(1, keepdims=True))
        new = v - step * (z.T @ (e / e.sum(1, keepdims=True) - target) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_ = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t_ * (new - w), new, t_
    return w[1:], w[0]


def anchored(gram: str) -> bool:
    return any(len(w) >= ANCHOR_LETTERS or w in ANCHORS for w in gram.split())


def train(spark: SparkSession) -> Classifier:
    rows = [v for f, ts in TEMPLATES.items() for t in ts for v in _variants(f, t)] + [(UNKNOWN, t, int(i % 4 == 0)) for i, t in enumerate(ORDINARY)]
    families = [UNKNOWN, *TEMPLATES]
    made = _literal(spark, [(i, t) for i, (_, t, _) in enumerate(rows)], "i int, text string").select("i", words_of(F.col("text")).alias("w"))
    grams = {r["i"]: {g for g in r["g"] if anchored(g)} for r in made.select("i", grams_of(F.col("w")).alias("g")).collect()}
    taught = [i for i, r in enumerate(rows) if not r[2]]
    vocabulary = sorted(set().union(*(grams[i] for i in taught if rows[i][0] != UNKNOWN)))
    number = {g: j for j, g in enumerate(vocabulary)}

    def bag(some: list[int]) -> np.ndarray:
        x = np.zeros((len(some), len(vocabulary)))
        for n, i in enumerate(some):
            x[n, [number[g] for g in grams[i] if g in number]] = 1
        return x

    label = np.array([families.index(r[0]) for r in rows])
    w, bias = sparse_softmax(bag(taught), label[taught], len(families))
    # calibration on what was left out: the temperature of least log loss, then the least probability
    held = [i for i, r in enumerate(rows) if r[2]]
    z = bag(held) @ w + bias

    def softmax(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return (e / e.sum(1, keepdims=True))[np.arange(len(held)), label[held]]

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(np.maximum(softmax(t), 1e-12)).sum())
    true = np.sort(softmax(temperature)[label[held] > 0])
    kept = np.flatnonzero(np.abs(w).max(1) > 1e-6)
    return Classifier(families, [vocabulary[j] for j in kept], w[kept].round(6).tolist(), bias.round(6).tolist(), float(temperature), max(FLOOR, float(true[int((1 - KEPT_SHARE) * len(true))])))


def logits(rows: DataFrame, keys: list[str], c: Classifier) -> DataFrame:
    """(keys, z, held): the families' logits of each row (keys, grams) that holds a gram of the classifier, and its grams."""
    spark = rows.sparkSession
    table = _literal(spark, list(zip(c.grams, c.weights, strict=True)), "gram string, weights array<double>")
    # the grams of the templates: a few hundred rows whatever the corpus
    hits = rows.select(*keys, F.explode(F.array_distinct("grams")).alias("gram")).join(F.broadcast(table), "gram")
    sums = [F.round(F.sum(F.col("weights")[i]), 9) + F.lit(float(b)) for i, b in enumerate(c.bias)]
    return hits.groupBy(*keys).agg(F.array(*sums).alias("z"), F.collect_set("gram").alias("held"))


#: What stands before the first word of a line.
COMMENT_MARKS = r"(?dmi)^[^\p{L}\p{N}\n]+(?:(?:dnl|rem)[ \t]+)?|^(?:dnl|rem)[ \t]+"


def _joined(lines: Column) -> Column:
    """(paragraph, last, line): of the runs of two or more lines that aren't empty, the numbers of their first and last, and the lines as one."""
    at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    first = F.filter(numbers, lambda i: (at(i) != "") & (at(i - 1) == ""))
    last = F.filter(numbers, lambda i: (at(i) != "") & (at(i + 1) == ""))
    runs = F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["a"] < r["b"])
    return F.transform(runs, lambda r: F.struct(r["a"].alias("paragraph"), r["b"].alias("last"), F.array_join(F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), " ").alias("line")))


def paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with paragraph, last (the numbers of its first and last line, from 0) and line: one row for each line and each joined paragraph."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(F.split(text, r"\n"), lambda x, i: F.struct(i.alias("paragraph"), i.alias("last"), x.alias("line")))
    joined = F.transform(F.array(F.split(F.regexp_replace(text, COMMENT_MARKS, ""), r"\n")), _joined)[0]
    return docs.select(*(c for c in docs.columns if c != text_col), F.inline(F.concat(lines, joined)))


def scan(docs: DataFrame, classifier: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, last, h, family, probability, confirmed) of each paragraph that is classified as a licence.

    paragraph and last number its lines, h is its hash. A joined paragraph that holds a confirmed line of its family has no row.
    """
    spark = docs.sparkSession
    c = classifier or train(spark)
    lines = paragraphs(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")))
    lines = lines.select("doc_id", "row", "paragraph", "last", F.xxhash64("line").alias("h"), words_of(F.col("line")).alias("w"))
    anchors = sorted({w for g in c.grams for w in g.split() if anchored(w)})
    lines = lines.where(F.arrays_overlap("w", F.array(*map(F.lit, anchors))))
    z = logits(lines.select("doc_id", "row", "paragraph", "last", "h", grams_of(F.col("w")).alias("grams")), ["doc_id", "row", "paragraph", "last", "h"], c)
    e = F.transform("z", lambda x: F.exp((x - F.array_max("z")) / c.temperature))
    p = z.withColumn("e", e).withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
    best = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    p = p.withColumn("probability", F.array_max("p")).withColumn("family", F.element_at(F.array(*map(F.lit, c.families)), best + 1))
    found = p.where((F.col("family") != UNKNOWN) & (F.col("probability") >= c.least))
    found = found.select("doc_id", "row", "paragraph", "last", "h", "family", "probability", _confirmed(spark, c).alias("confirmed"))
    own = F.max(F.when(F.col("confirmed") & (F.col("paragraph") == F.col("last")), F.col("paragraph")))
    upto = Window.partitionBy("doc_id", "row", "family").orderBy("last").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("own", F.coalesce(own.over(upto), F.lit(-1))).where((F.col("paragraph") == F.col("last")) | (F.col("own") < F.col("paragraph")))
    return found.drop("row", "own")


def _confirmed(spark: SparkSession, c: Classifier) -> Column:
    """Whether the paragraph's known grams hold CONFIRM of those of some template of its family."""
    known = set(c.grams)
    made = _literal(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, text string")
    sets = [(r["family"], sorted(set(r["g"]) & known)) for r in made.select("family", words_of(F.col("text")).alias("w")).select("family", grams_of(F.col("w")).alias("g")).collect()]
    some = [(F.col("family") == f) & (F.size(F.array_intersect("held", F.array(*map(F.lit, s)))) >= CONFIRM * len(s)) for f, s in sets if s]
    return reduce(lambda a, b: a | b, some, F.lit(False))


def documents_with_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, families): of each document, the paragraphs confirmed as licences, and their families, sorted.

    Rows of one id count as one document. A document without licence has 0 and an empty text.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    found = scratch.table(scan(docs, None, id_col, text_col).where("confirmed"), "found")
    by = found.groupBy("doc_id").agg(F.count_distinct("paragraph", "last", "h").alias("n_paragraphs"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("found_id"))
    out = ids.join(by.withColumnRenamed("doc_id", "found_id"), on, "left")
    return out.select("doc_id", F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"))
