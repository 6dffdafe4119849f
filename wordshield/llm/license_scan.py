"""Licence scans: a trained paragraph classifier names licence families, and templates confirm what it names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import inputs
from .kernels import LOWER, SPACES, RangeHash, chunks, joined, mix, sliced

# Notices of licence families, as their publishers word them or as projects commonly do.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This software is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
FAMILIES = [*TEMPLATES]
# Names that short mentions give to the families, and sentences that carry a name.
NAMES: dict[str, list[str]] = {
    "apache-2.0": ["Apache License", "Apache 2.0", "Apache License 2.0", "Apache-2.0", "Apache License, Version 2.0", "ASL 2.0"],
    "mit": ["MIT", "MIT License", "MIT/X11", "X11/MIT", "Expat"],
    "gpl": ["GPL", "GNU GPL", "GPLv2", "GPLv3", "GPL v2", "GPL v3", "GPL version 2", "GPL version 3", "GNU GPL version 3", "GNU General Public License", "General Public License version 2", "GPL-2.0"],
    "lgpl": ["LGPL", "GNU LGPL", "LGPLv3", "LGPL v2.1", "Lesser General Public License", "GNU Lesser General Public License", "GNU Lesser GPL"],
    "bsd": ["BSD", "BSD 3-Clause", "BSD 2-Clause", "3-clause BSD", "New BSD", "Simplified BSD", "modified BSD"],
    "mpl-2.0": ["MPL", "MPL 2.0", "MPLv2", "Mozilla Public License", "Mozilla Public License 2.0"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC 3.0", "CC-BY-NC 4.0", "Creative Commons BY-NC 4.0", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial 4.0"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA 3.0", "CC-BY-SA 4.0", "Creative Commons BY-SA 4.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 4.0"],
    "cc-by": ["CC BY", "CC BY 3.0", "CC-BY 4.0", "Creative Commons BY 4.0", "Creative Commons BY", "Creative Commons Attribution", "Creative Commons Attribution 4.0"],
    "cc0": ["CC0", "CC0 1.0", "Creative Commons Zero", "Creative Commons CC0"],
}
CARRIERS = [
    "licensed under {}", "licensed under the {}", "This code is licensed under {}", "This code is licensed under the {} license", "released under the {}",
    "released under {}", "available under the {}", "available under the {} licence", "published under {}", "published under the {} license",
    "distributed under the terms of the {}", "under the terms of the {}", "under the terms of the {} licence", "the {} terms apply", "covered by the {}",
    "License: {}", "see the {} licence for details", "may be used under {}", "{} licensed", "{} license", "{} licence",
]
#: What a licence of no known family may be called; the first blank takes an invented name.
OTHER_NAMES = ["{}", "{} License", "{} Public License", "{} Software License", "{} License, Version 2.0", "{} License 1.0", "{} v2", "{} version 3", "{} Public Licence 2.0", "{} Public License 2.0", "{} Public License, v. 1.0", "{} Source License", "{} Community License 4.0"]
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3B, 0x3F]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def paragraph_grams(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Words (lower-cased runs of letters and digits) of every paragraph, as hashes of words and of word pairs.

    A paragraph is a run of lines with words. text, start, end, block: of each line that has a word (bytes in its text, number
    of its paragraph); gram (64-bit), of_line, first, word, cross: each gram's hash, its line, whether it is a single word,
    the number of its first word, and whether it is a pair over a line's end. Single words come first, in order.
    A sentence ends at the end of its line, or at one of `.!?;` before white space; sentence: each gram's, -1 for a pair over
    a sentence's end; sentence_line: each sentence's line.
    """
    buf, at = joined(texts)
    raw, buf = buf, LOWER[buf]
    gap = ~_WORD[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    breaks = np.union1d(np.flatnonzero(raw == 0x0A), at[1:] - 1)
    line = np.searchsorted(breaks, start)
    lines, of_line = np.unique(line, return_inverse=True)
    hashes = RangeHash(buf).of(start, end)
    stops = np.flatnonzero(_STOP[raw[:-1]] & SPACES[raw[1:]])
    _, head, sentence = np.unique(np.searchsorted(np.union1d(breaks, stops), start), return_index=True, return_inverse=True)
    begin = np.where(lines > 0, breaks[lines - 1] + 1, 0)
    text = np.searchsorted(at, begin, "right") - 1
    block = np.cumsum(np.concatenate(([False], (np.diff(lines) > 1) | (np.diff(text) > 0)))[: len(lines)])
    pair = np.flatnonzero(block[of_line[1:]] == block[of_line[:-1]])
    word = np.concatenate((np.arange(len(hashes)), pair))
    cross = np.concatenate((np.zeros(len(hashes), bool), of_line[pair + 1] != of_line[pair]))
    sentence_of_pair = np.where(sentence[pair + 1] == sentence[pair], sentence[pair], -1)
    return {"sentence": np.concatenate((sentence, sentence_of_pair)), "sentence_line": of_line[head], "text": text, "start": begin - at[text], "end": breaks[lines] - at[text], "block": block, "gram": np.concatenate((hashes, pair_grams(hashes)[pair])), "of_line": of_line[word], "first": np.arange(len(word)) < len(hashes), "word": word, "cross": cross}


def pair_grams(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * np.uint64(3) + hashes[1:])


def windows(first: np.ndarray, last: np.ndarray, code: np.ndarray, need: int, most: float) -> list[tuple[int, int]]:
    """Shortest runs of words (first, last), from left to right, that hold `need` distinct codes within `most` words."""
    order = np.argsort(last, kind="stable")
    first, last, code = first[order].tolist(), last[order].tolist(), code[order].tolist()
    out, count, i = [], {}, 0
    for j, c in enumerate(code):
        count[c] = count.get(c, 0) + 1
        while count[code[i]] > 1 or last[j] - first[i] >= most and i < j:
            count[code[i]] -= 1
            if not count[code[i]]:
                del count[code[i]]
            i += 1
        if len(count) >= need:
            out.append((min(first[i : j + 1]), last[j]))
            count, i = {}, j + 1
    return out


@dataclass
class Model:
    """Sparse logistic regression over hashed word and pair n-grams; class 0 is no licence, the last a licence of no known family."""

    bits: int
    weights: np.ndarray  # [2**bits, 2 + families]
    bias: np.ndarray
    temperature: float
    unknown_below: float  # of a confirmed family's share among the families
    licence_from: float  # of the probability of any licence
    named_from: float  # of the probability of a family that no template confirms
    told: np.ndarray  # sorted hashes of the pairs of mentions and templates that the corpus sample lacks
    vocabulary: np.ndarray  # sorted hashes of the templates' telling pairs and words
    templates: list[tuple[int, np.ndarray]]  # family, sorted distinct grams

    def logits(self, gram: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        order = np.argsort(of, kind="stable")
        cell, of = (gram[order] >> np.uint64(64 - self.bits)).astype(np.int64), of[order]
        sums = np.zeros((n, len(self.bias)))
        if len(of):
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            sums[of[first]] = np.add.reduceat(self.weights[cell], first, axis=0)
        return (sums / np.sqrt(np.maximum(1, np.bincount(of, minlength=n)))[:, None] + self.bias) / self.temperature

    def probabilities(self, gram: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        z = self.logits(gram, of, n)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def confirmed(self, grams: np.ndarray, family: int, least: float) -> bool:
        """Whether the paragraph holds at least the share `least` of the grams of one of the family's templates."""
        return any(f == family and len(np.intersect1d(grams, t)) >= least * len(t) for f, t in self.templates)


def share_of(p: np.ndarray) -> np.ndarray:
    """Each family's probability among the families, from rows of all classes' probabilities."""
    return p[:, 1:-1] / np.maximum(1e-12, p[:, 1:-1].sum(1, keepdims=True))


def mentions(rng: np.random.Generator, corpus: list[str], copies: int = 150) -> list[tuple[str, int]]:
    """Short mentions with their classes: of each named family, of invented licences, and sentences that hold words of both by chance."""
    def invented() -> str:
        words = corpus[rng.integers(len(corpus))].split() if corpus else []
        if words and rng.random() < 0.5:
            return " ".join(str(w).strip(".,;!?").capitalize() for w in rng.choice(words, rng.integers(1, 3)))
        return "".join(chr(x) for x in rng.integers(65, 91, rng.integers(2, 7)))

    def around(text: str) -> str:
        words = corpus[rng.integers(len(corpus))].split()[: rng.integers(1, 7)] if corpus and rng.random() < 0.4 else []
        return " ".join([*words, text] if rng.random() < 0.5 else [text, *words])

    known = {n for names in NAMES.values() for n in names}
    out = []
    for family, names in NAMES.items():
        for k in range(copies):
            carrier = CARRIERS[rng.integers(len(CARRIERS))] if " " not in names[k % len(names)] or rng.random() < 0.85 else "{}"
            out.append((around(carrier.format(names[k % len(names)])), 1 + FAMILIES.index(family)))
    for _ in range(copies * 6):
        name = OTHER_NAMES[rng.integers(len(OTHER_NAMES))].format(invented())
        if name not in known:
            out.append((around(CARRIERS[rng.integers(len(CARRIERS))].format(name)), 1 + len(FAMILIES)))
    telling = sorted({w for t in [*CARRIERS, *known, *(x for ts in TEMPLATES.values() for x in ts)] for w in t.replace("{}", "").split()})
    for _ in range(copies * 6 if corpus else 0):
        words = corpus[rng.integers(len(corpus))].split()[:20]
        for w in rng.choice(telling, min(len(words), rng.integers(1, 4)), replace=False):
            words.insert(rng.integers(len(words) + 1), str(w))
        out.append((" ".join(words), 0))
    return out


def train(docs: DataFrame, text_col: str = "text", most_negatives: int = 3000, bits: int = 17, seed: int = 5, steps: int = 150) -> Model:
    """Fit on varied templates and mentions against corpus paragraphs that share no telling template pair.

    The last class is fitted on mentions of invented licences; corpus lines with single words of notices are no licence.

    At most most_negatives texts, by hash, give negatives; that bounds what comes to the driver (of each one line, by
    hash, of which the first 2,000 characters; only this bounded fit reads parts of texts).
    A quarter of the samples is held back. It sets the temperature, and unknown_below: 95 % of its template-free lines fall
    below that in their likeliest licence's share among the licences, unless over 2 % of its rightly classified notices
    would fall below it too; then the bound is where those 2 % end. It also sets licence_from, which 0.2 % of the corpus' own
    sentences reach, and named_from, which 1 % of all samples of no licence and of the invented licences reach with some family (both at least a half).
    """
    rng = np.random.default_rng(seed)
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    count = max(1, texts.count())
    picked = texts.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 30)) < int(min(1.0, most_negatives / count) * (1 << 30)))
    lines = F.split("text", "\n")
    line = F.element_at(lines, (F.pmod(F.xxhash64("text"), F.size(lines)) + 1).cast("int"))
    corpus = sorted(r[0] for r in picked.select(F.substring(line, 1, 2000)).limit(2 * most_negatives).collect())
    samples: list[bytes] = []
    labels: list[int] = []
    for k, family in enumerate(FAMILIES, 1):
        for template in TEMPLATES[family]:
            w = template.split()
            for _ in range(24):
                kept = [x for x in w if rng.random() > 0.06] or w
                around = corpus[rng.integers(len(corpus))].split()[:6] if corpus and rng.random() < 0.3 else []
                samples.append(" ".join([*around, *kept]).encode())
                labels.append(k)
    templates = [(k, np.unique(paragraph_grams([t.encode()])["gram"])) for k, f in enumerate(FAMILIES, 1) for t in TEMPLATES[f]]
    pairs = np.unique(np.concatenate([(g := paragraph_grams([t.encode()]))["gram"][~g["first"]] for f in FAMILIES for t in TEMPLATES[f]]))
    g = paragraph_grams([x.replace("\n", " ").encode() for x in corpus or [""]])
    hit = np.isin(g["gram"], pairs)
    shared = np.unique(np.stack((g["text"][g["of_line"][hit]].astype(np.uint64), g["gram"][hit])), axis=1)[0]
    for x in np.flatnonzero(np.bincount(shared.astype(np.int64), minlength=len(corpus)) < 2).tolist():
        sentences = re.split(r"(?<=[.!?;])\s", corpus[x])
        samples += [min(sentences, key=len).encode(), sentences[rng.integers(len(sentences))].encode()]
        labels += [0, 0]
    natural, common = len(samples), np.unique(g["gram"])
    for text, label in mentions(rng, [x for x in corpus if x.split()]):
        samples.append(text.encode())
        labels.append(label)
    told = paragraph_grams([c.format(x).encode() for c in [*CARRIERS, "{}"] for names in NAMES.values() for x in names])
    told = np.setdiff1d(np.union1d(told["gram"][~told["first"]], pairs), common)
    g = paragraph_grams([x.replace(b"\n", b" ") for x in samples])
    gram, row, y = g["gram"], g["text"][g["of_line"]], np.array(labels)
    classes, n = 2 + len(FAMILIES), len(samples)
    model = Model(bits, np.zeros((1 << bits, classes), np.float32), np.zeros(classes), 1.0, 0.5, 0.5, 0.5, told, pairs, templates)
    held = rng.random(n) < 0.25
    cell = (gram >> np.uint64(64 - bits)).astype(np.int64)
    used, cell = np.unique(cell, return_inverse=True)
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))[:, None]
    by_row, by_cell = np.argsort(row, kind="stable"), np.argsort(cell, kind="stable")
    filled, row_head = np.unique(row[by_row], return_index=True)
    cell_head = np.unique(cell[by_cell], return_index=True)[1]
    cell_of, row_of = cell[by_row], row[by_cell]
    w, square = np.zeros((len(used), classes), np.float32), np.full((len(used), classes), 1e-3)
    bias = np.zeros(classes)
    balance = (n / classes / np.maximum(1, np.bincount(y, minlength=classes)))[y] * ~held

    def outputs() -> np.ndarray:
        z = np.zeros((n, classes))
        if len(row):
            z[filled] = np.add.reduceat(w[cell_of], row_head, axis=0)
        return z * norm + bias

    for _ in range(steps):
        z = outputs()
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - np.eye(classes)[y]) * balance[:, None] / n
        slope = np.add.reduceat((d * norm).astype(np.float32)[row_of], cell_head, axis=0) + 1e-6 * w
        square += slope**2
        w -= 0.5 * slope / np.sqrt(square)
        bias -= 0.5 * d.sum(0)
    model.weights[used] = w
    model.bias = bias
    z = outputs()[held]
    if held.any():
        loss = lambda t: -np.mean((z / t - np.log(np.exp(z / t - (z / t).max(1, keepdims=True)).sum(1, keepdims=True)) - (z / t).max(1, keepdims=True))[np.arange(len(z)), y[held]])
        model.temperature = min(np.linspace(0.2, 3, 57), key=loss)
        z, y = z / model.temperature, y[held]
        model.unknown_below = unknown_bound(z[y <= len(FAMILIES), :-1], y[y <= len(FAMILIES)])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        none, other = p[(y == 0) & (np.flatnonzero(held) < natural)], p[(y == 0) | (y == classes - 1)]
        model.licence_from = max(0.5, float(np.quantile(1 - none[:, 0], 0.998))) if len(none) else 0.5
        model.named_from = max(0.5, float(np.quantile(other[:, 1:-1].max(1), 0.99))) if len(other) else 0.5
    return model


def unknown_bound(z: np.ndarray, y: np.ndarray, free_below: float = 0.95, notices_below: float = 0.02) -> float:
    """The bound on the likeliest licence's share among the licences, from held-back logits and classes, as train() says."""
    e = np.exp(z[:, 1:] - z[:, 1:].max(1, keepdims=True))
    share, best = (e / e.sum(1, keepdims=True)).max(1), 1 + np.argmax(e, 1)
    free, right = share[y == 0], share[(y > 0) & (best == y)]
    bounds = [np.quantile(x, q) for x, q in ((free, free_below), (right, notices_below)) if len(x)]
    return float(min(bounds, default=0.5))


def notices(model: Model, g: dict[str, np.ndarray], grams: np.ndarray, k: int, need: int) -> list[tuple[int, int, int, float]]:
    """(family, first line, last line, probability) where template k is confirmed in a paragraph and is the likeliest; grams: numbers of the paragraph's grams."""
    family, own = model.templates[k]
    code = np.minimum(np.searchsorted(own, g["gram"][grams]), len(own) - 1)
    hit = own[code] == g["gram"][grams]
    grams, code = grams[hit], code[hit]
    first, line = g["word"][grams], g["of_line"][grams]
    last = first + ~g["first"][grams]
    last_line = g["of_line"][last]
    whole, runs = [], []
    for x in np.unique(line).tolist():
        at = (line == x) & (last_line == x)
        if len(np.unique(code[at])) >= need:
            whole.append(x)
            runs += windows(first[at], last[at], code[at], need, np.inf)
    # wrapped ones: lie between the lines that hold one each, within about twice the template's words
    apart = ~np.isin(line, whole) & ~np.isin(last_line, whole)
    stretch = np.searchsorted(np.array(whole, np.int64), line)
    for x in np.unique(stretch[apart]).tolist():
        at = apart & (stretch == x)
        if len(np.unique(code[at])) >= need:
            runs += windows(first[at], last[at], code[at], need, len(own) + 1)
    # lengthen each by the template's words beside it, over a line's end only by its pairs
    out, hits, follows = [], {*first.tolist(), *last.tolist()}, set(first[last > first].tolist())
    for a, b in runs:
        while a - 1 in follows or a - 1 in hits and g["of_line"][a - 1] == g["of_line"][a]:
            a -= 1
        while b in follows or b + 1 in hits and g["of_line"][b + 1] == g["of_line"][b]:
            b += 1
        h = g["gram"][a : b + 1]
        p = model.probabilities(np.concatenate((h, pair_grams(h))), np.zeros(2 * len(h) - 1, np.int64), 1)[0]
        shares = share_of(p[None])[0]
        share = float(shares[family - 1])
        if family == 1 + int(np.argmax(shares)) and share >= model.unknown_below:
            out.append((family, int(g["of_line"][a]), int(g["of_line"][b]), share))
    return out


def scan_licenses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.75) -> DataFrame:
    """(id, n_paragraphs, n_lines, findings) for every row; findings: array of (family, start, end, probability, confirmed), spans in bytes.

    A paragraph is a run of lines up to one without words. The model judges every sentence of it with a word pair of a mention or
    template that the fitted corpus sample lacks, and a line by the sentence that is likeliest a licence; wrapped lines are read as
    one text as well. A finding is
    * a confirmed family: the share `confirm` of one of its templates' words and pairs is in one line, or within twice the template's
      words over several lines, and the words that do so have that family as likeliest, with at least unknown_below of the
      families' probability. A paragraph or line gives every family that is so confirmed. Lines beside it that have
      the family as likeliest lengthen the finding.
    * else a family that the model names with a probability of at least named_from, in a line that is a licence with at least licence_from;
    * else "unknown": such a line with less, and a line or words over several lines with a third of a template's pairs.
    probability: of the family among the families if confirmed, of the family if not, of any licence if unknown. Findings span
    whole lines. n_lines counts lines with a word. Null and empty texts and empty tables have no findings; equal rows have equal ones.
    """
    texts = inputs(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    item = pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("confirmed", pa.bool_())])

    # which template has which telling pair, and how many it has; a confirmation takes `need` grams, so at least able_from pairs
    held = np.stack([np.isin(model.vocabulary, t) for _, t in model.templates])
    family = np.array([f for f, _ in model.templates])
    size, pairs = np.array([len(t) for _, t in model.templates]), np.maximum(1, held.sum(1))
    need = np.ceil(confirm * size).astype(np.int64)
    able_from = np.maximum(1, need - (size - held.sum(1)))

    def shared_pairs(of: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        seen = np.unique(np.stack((of, code)), axis=1)
        out = np.zeros((n, len(pairs)))
        np.add.at(out, seen[0], held[:, seen[1]].T)
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.union1d(model.vocabulary, model.told)
        likely = np.zeros(1 << 16, bool)
        likely[(known >> np.uint64(48)).astype(np.int64)] = True
        for batch in sliced(batches):
            data = [t.encode() for t in batch.column("text").to_pylist()]
            counts, n_lines, findings = [], [], [[] for _ in data]
            for a, b in chunks(data):
                g = paragraph_grams(data[a:b])
                n_lines.append(np.bincount(g["text"], minlength=b - a))
                counts.append(np.bincount(g["text"][np.unique(g["block"], return_index=True)[1]], minlength=b - a))
                telling = np.flatnonzero(likely[(g["gram"] >> np.uint64(48)).astype(np.int64)] & ~g["first"])
                telling = telling[np.isin(g["gram"][telling], known)]
                if not len(telling):
                    continue
                # the sentences of lines that hold a pair of a template or mention; only those with a telling pair may be licences
                tells = np.zeros(len(g["sentence_line"]), bool)
                at = telling[(g["sentence"][telling] >= 0) & np.isin(g["gram"][telling], model.told)]
                tells[g["sentence"][at]] = True
                judge = np.zeros(len(g["text"]), bool)
                judge[g["of_line"][telling]] = True
                chosen = np.flatnonzero(judge[g["sentence_line"]])
                place = np.full(len(tells), -1)
                place[chosen] = np.arange(len(chosen))
                of = np.where(g["sentence"] >= 0, place[g["sentence"]], -1)
                sentences = model.probabilities(g["gram"][of >= 0], of[of >= 0], len(chosen))
                rising = np.argsort(tells[chosen] + 1 - sentences[:, 0], kind="stable")
                judged = np.zeros(len(g["text"]), np.int64)
                judged[g["sentence_line"][chosen[rising]]] = rising  # of each line the last, which is likeliest a licence
                likeliest = sentences[judged]
                licences = np.flatnonzero(judge & tells[chosen][judged] & (1 - likeliest[:, 0] >= model.licence_from))
                telling = telling[np.isin(g["gram"][telling], model.vocabulary)]
                code = np.searchsorted(model.vocabulary, g["gram"][telling])
                within = ~g["cross"][telling]
                # lines that share a pair with some template: near a template, or likely a licence
                paired = np.unique(g["of_line"][telling[within]])
                lines = np.union1d(paired, licences)
                number = np.full(len(g["text"]), -1)
                number[lines] = np.arange(len(lines))
                of = np.where(g["cross"], -1, number[g["of_line"]])
                p = likeliest[lines]
                whole = model.probabilities(g["gram"][of >= 0], of[of >= 0], len(lines))
                alike = np.argmax(whole[:, :-1], 1)  # of the whole line: no licence, or the likeliest family
                shared = shared_pairs(number[g["of_line"][telling[within]]], code[within], len(lines))
                near = (shared >= 0.34 * pairs).any(1)
                sure = np.isin(lines, licences)
                shares = share_of(p)
                best = 1 + np.argmax(shares, 1)
                candidates: dict[int, list[int]] = {}
                for k in np.flatnonzero(near | sure | (np.isin(lines, paired) & (alike > 0))).tolist():
                    candidates.setdefault(int(g["block"][lines[k]]), []).append(k)
                # paragraphs that share a pair
                block = g["block"][g["of_line"]]
                blocks = np.union1d(block[telling], g["block"][lines])
                of_block = np.searchsorted(blocks, block[telling])
                shared = shared_pairs(of_block, code, len(blocks))
                able, nearly = shared >= able_from, shared >= 0.34 * pairs
                some = np.array([int(x) in candidates for x in blocks]) | able.any(1) | nearly.any(1)
                mine = np.flatnonzero(np.isin(block, blocks[some]))
                mine = mine[np.argsort(block[mine], kind="stable")]
                bounds = np.searchsorted(block[mine], blocks, "left"), np.searchsorted(block[mine], blocks, "right")
                for n in np.flatnonzero(some).tolist():
                    grams = mine[bounds[0][n] : bounds[1][n]]
                    found: list[list] = []  # family, first and last line, probability, confirmed
                    for x in sorted(y for k in np.flatnonzero(able[n]).tolist() for y in notices(model, g, grams, k, int(need[k]))):
                        if found and found[-1][0] == x[0] and x[1] <= found[-1][2]:
                            found[-1][2:4] = max(found[-1][2], x[2]), max(found[-1][3], x[3])
                        else:
                            found.append([*x, True])
                    covered = {x for f in found for x in range(f[1], f[2] + 1)}
                    own = set(telling[of_block == n].tolist()) if found and int(blocks[n]) in candidates else set()
                    rest: dict[int, int] = {}  # line: its number among those judged
                    for k in candidates.get(int(blocks[n]), []):
                        line = int(lines[k])
                        if line in covered:
                            continue
                        if shares[k, best[k] - 1] >= model.unknown_below and model.confirmed(np.unique(g["gram"][of == k]), int(best[k]), confirm):
                            found.append([int(best[k]), line, line, float(shares[k, best[k] - 1]), True])
                            covered.add(line)
                        else:
                            rest[line] = k
                    for f in found:  # lengthen it by its notice's other lines beside it
                        has = {int(g["gram"][x]) for x in own if f[1] <= g["of_line"][x] <= f[2]}
                        ours = np.concatenate([t for c, t in model.templates if c == f[0]])
                        for edge, step in ((1, -1), (2, 1)):
                            while (k := rest.get(f[edge] + step)) is not None and alike[k] == f[0]:
                                new = {int(g["gram"][x]) for x in own if g["of_line"][x] == f[edge] + step and not g["cross"][x]} - has
                                if near[k] and not np.isin(np.array([*new], np.uint64), ours).any():
                                    break
                                has |= new
                                f[edge] += step
                                del rest[f[edge]]
                                covered.add(f[edge])
                    for line, k in rest.items():
                        if near[k] or sure[k]:
                            named = sure[k] and p[k, best[k]] >= model.named_from
                            found.append([int(best[k]), line, line, float(p[k, best[k]]), False] if named else [0, line, line, float(1 - p[k, 0]), False])
                            covered.add(line)
                    confirmed = {f[0] for f in found}
                    for k in np.flatnonzero(nearly[n] & ~np.isin(family, [*confirmed])).tolist():  # words over several lines that are near a template
                        some_pairs = grams[~g["first"][grams] & np.isin(g["gram"][grams], model.templates[k][1])]
                        code_of = np.unique(g["gram"][some_pairs], return_inverse=True)[1]
                        first = g["word"][some_pairs]
                        for x, y in windows(first, first + 1, code_of, int(np.ceil(0.34 * pairs[k])), len(model.templates[k][1]) + 1):
                            u, v = int(g["of_line"][x]), int(g["of_line"][y])
                            if covered.isdisjoint(range(u, v + 1)):
                                h = g["gram"][x : y + 1]
                                q = model.probabilities(np.concatenate((h, pair_grams(h))), np.zeros(2 * len(h) - 1, np.int64), 1)[0]
                                found.append([0, u, v, float(1 - q[0]), False])
                                covered.update(range(u, v + 1))
                    text = findings[a + int(g["text"][g["of_line"][grams[0]]])]
                    for c, u, v, share, held_up in sorted(found, key=lambda f: f[1:3]):
                        text.append({"family": FAMILIES[c - 1] if c else "unknown", "start": int(g["start"][u]), "end": int(g["end"][v]), "probability": share, "confirmed": held_up})
            totals = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (counts, n_lines)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *totals, pa.array(findings, pa.list_(item))], ["id", "n_paragraphs", "n_lines", "findings"])

    return texts.mapInArrow(scan, f"id {kind}, n_paragraphs long, n_lines long, findings array<struct<family: string, start: long, end: long, probability: double, confirmed: boolean>>")
