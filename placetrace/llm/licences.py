"""Licence scan: a trained paragraph classifier with template comparison.

A multinomial logistic regression on hashed sparse word 1- and 2-grams gives a
stretch of text a licence family, ``other`` (licence language of no known family)
or nothing.  Stretches are lines, and windows of words that run over line breaks:
a notice may be wrapped, or stand in the middle of a line of hundreds of words.  Of
hits that overlap one counts: a family before ``other``, a line before a window.  The classifier is trained on the template lines below, on distorted
copies of them in surroundings of several lengths, on generic licence language, and
on lines of a bounded sample of the corpus as background.  Its probabilities are
calibrated by one temperature fitted on distorted copies it has not seen.

A family must be confirmed: a calibrated probability of ``least_probability``, and
a template of which the stretch holds ``least_overlap`` of the weight (word pairs
count by how few templates share them) and the name, its words together and not
followed by a qualifier.  A template line without a name needs ``least_alone`` of
its weight.  So a Lesser, Affero or ShareAlike text never passes for the family
whose words it shares, known or not.  What is not confirmed is ``other`` if it
reads like a licence: an SPDX line, or a probability of ``least_other`` for any
licence class and three word pairs shared with templates (two beside the word
licence) that are ``least_known`` of its pairs.

Edge cases: a null or empty text has no paragraphs and no licence; blank lines
are no paragraphs; null ids and repeated rows are scanned each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.tables import texts
from placetrace.llm.textkit import BASE, Hasher, mix, pieces, separators, word_spans

# Typical notice lines of public licences, by family.
TEMPLATES = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "eupl": (
        "Licensed under the European Union Public Licence, version 1.2.",
        "Licensed under the EUPL, Version 1.2.",
        "SPDX-License-Identifier: EUPL-1.2",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright (c) 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission.",
    ),
}
# The names by which a family is told; the words of a name stand together.
NAMES = {
    "agpl": ("gnu affero general public license", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"),
    "apache": ("apache license version 2.0", "apache license 2.0", "apache-2.0", "apache.org/licenses/license-2.0"),
    "bsd": ("bsd license", "bsd-2-clause", "bsd-3-clause"),
    "cc-by": ("creative commons attribution", "cc by", "cc-by-4.0", "cc-by-3.0"),
    "cc-by-nc": ("creative commons attribution-noncommercial", "cc by-nc", "cc-by-nc-4.0", "cc-by-nc-3.0"),
    "cc-by-nc-nd": ("creative commons attribution-noncommercial-noderivatives", "cc by-nc-nd", "cc-by-nc-nd-4.0"),
    "cc-by-nc-sa": ("creative commons attribution-noncommercial-sharealike", "cc by-nc-sa", "cc-by-nc-sa-4.0"),
    "cc-by-nd": ("creative commons attribution-noderivatives", "cc by-nd", "cc-by-nd-4.0"),
    "cc-by-sa": ("creative commons attribution-sharealike", "cc by-sa", "cc-by-sa-4.0", "cc-by-sa-3.0"),
    "eupl": ("european union public licence", "the eupl", "eupl-1.1", "eupl-1.2"),
    "gpl": ("gnu general public license", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"),
    "isc": ("isc license", "spdx-license-identifier isc"),
    "lgpl": ("gnu lesser general public license", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"),
    "mit": ("mit license", "spdx-license-identifier mit"),
    "mpl": ("mozilla public license", "mpl-2.0"),
    "public-domain": ("dedicated to the public domain", "released into the public domain", "cc0 1.0", "cc0-1.0"),
    "reserved": ("all rights reserved",),
}
# What may follow the name of an attribution licence; anything else qualifies it.
FOLLOWERS = ("license", "licence", "international", "unported", "generic")
# Licence language of no family; words of the corpus fill the gaps, as names of unknown licences.
GENERIC = (
    "Use of this work is subject to the terms of the attached license.",
    "See the LICENSE file for details.",
    "You may copy and distribute this work under the terms of its license agreement.",
    "This software is provided under a custom license by the vendor.",
    "Permission is granted to use this data for research under the license of the provider.",
    "Permission to use and copy this material for any purpose without fee is granted under the terms of its license.",
    "Licensed under the {} License, version 1.1.",
    "Released under the {} License.",
    "Licensed under the {} Public Licence, version 1.2.",
    "This work is licensed under a {} 4.0 International License.",
    "Licensed under {} 4.0.",
    "it under the terms of the {} General Public License as published by the {} Foundation",
    "SPDX-License-Identifier: {}",
)
NONE, OTHER = "none", "other"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SPDX = re.compile(rb"(?i)spdx-license-identifier")
# Words of a window and how far the next one starts, for each length.
WINDOWS = ((16, 8), (32, 16))


@dataclass(frozen=True)
class Settings:
    """``background_documents`` bounds the sampled documents, ``background_lines`` the lines used of them."""

    buckets: int = 1 << 16
    background_documents: int = 300
    background_lines: int = 3000
    copies: int = 40
    rounds: int = 150
    rate: float = 4.0
    decay: float = 1e-4
    least_probability: float = 0.5
    least_overlap: float = 0.35
    least_alone: float = 0.75
    least_other: float = 0.9
    least_known: float = 0.3
    seed: int = 2


def word_table():
    """Separators for licence words: white space and signs other than those inside names."""
    apart = separators()
    apart[[ord(c) for c in ",;:!?()[]{}\"'*<>|/"]] = True
    return apart


@dataclass
class Stretches:
    """Words of a piece and the stretches that are scored, as ranges of words; lines come first."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray
    n_lines: int
    n_words: np.ndarray  # of each row, by the number of its first word


def stretches(data, offsets, hasher, apart, windows=WINDOWS):
    """Lines, and windows over the words of each row that has more than one line or more words than a window."""
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate((offsets, breaks + 1))).astype(np.int64)
    edges = edges[edges <= len(data)]
    starts, ends, lines = word_spans(data, edges, apart) if len(edges) > 1 else (np.zeros(0, np.int64),) * 3
    # Points at the end of a word belong to the sentence.
    while len(ends):
        dot = (data[ends - 1] == 46) & (ends - starts > 1)
        if not dot.any():
            break
        ends = ends - dot
    codes = hasher.spans(hasher.running(data), starts, ends)
    rows = np.searchsorted(starts, offsets)  # the first word of each row
    numbers = np.arange(max(0, len(edges) - 1))
    first, last = [np.searchsorted(lines, numbers)], [np.searchsorted(lines, numbers, "right")]
    size = np.diff(rows)
    wrapped = np.diff(np.searchsorted(edges[:-1], offsets)) > 1 if len(edges) else size > 0
    for width, step in windows:
        times = np.where((size > width) | (wrapped & (size > 0)), -(-np.maximum(size - width, 0) // step) + 1, 0)
        begin = np.repeat(rows[:-1], times) + step * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        first.append(begin)
        last.append(np.minimum(begin + width, np.repeat(rows[1:], times)))
    return Stretches(codes, starts, ends, np.concatenate(first), np.concatenate(last), len(numbers), rows)


@dataclass
class Model:
    classes: list
    weights: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float


def buckets_of(codes, settings):
    """Buckets of the single words, and of each word with the next one."""
    pairs = mix(codes[:-1] * np.uint64(BASE) + codes[1:]) if len(codes) else codes
    return tuple(((c >> np.uint64(20)) % np.uint64(settings.buckets)).astype(np.int64) for c in (codes, pairs))


def logits(model, one, two, first, last):
    """Class values of stretches [first, last) of words: mean feature weight times the root of the number of features."""
    sums = []
    for buckets in (one, two):
        total = np.zeros((len(buckets) + 1, len(model.classes)))
        np.cumsum(model.weights[buckets], axis=0, out=total[1:])
        sums.append(total)
    pairs = np.maximum(last - 1, first)  # the pair of the last word leaves the stretch
    value = sums[0][last] - sums[0][first] + sums[1][pairs.clip(max=len(two))] - sums[1][first.clip(max=len(two))]
    count = np.maximum(2 * (last - first) - 1, 1)
    return value / np.sqrt(count)[:, None] + model.bias


def softmax(z):
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def distorted(line, random, background):
    """A copy with words left out, changed case, and often text of the corpus around it, as a window would see it."""
    words = [w for w in line.split() if random.random() > 0.12] or line.split()
    text = " ".join(words)
    text = text.upper() if random.random() < 0.1 else text
    if background and random.random() < 0.5:
        for side in range(2):
            n = int(random.integers(0, 4 if random.random() < 0.5 else 14))
            other = " ".join(background[random.integers(len(background))].split()[:n])
            text = f"{other} {text}" if side else f"{text} {other}"
    return text.strip()


def _encoded(lines, settings):
    raw = [line.replace("\n", " ").encode() + b"\n" for line in lines]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    found = stretches(data, offsets, Hasher(lower=True), word_table(), ())
    return (*buckets_of(found.codes, settings), found.first, found.last)


def _filled(line, random, background):
    """A line of unknown licences with one to three words of the corpus in its gaps."""
    while "{}" in line:
        words = (background[random.integers(len(background))].split() if background else []) or ["Sample"]
        at = int(random.integers(len(words)))
        line = line.replace("{}", " ".join(words[at : at + int(random.integers(1, 4))]), 1)
    return line


def lines_of(family):
    """The template lines of a family, and an SPDX line for each of its identifiers."""
    ids = [name for name in NAMES[family] if " " not in name and "/" not in name]
    spdx = [f"SPDX-License-Identifier: {name}" for name in ids]
    told = {line.lower() for line in TEMPLATES[family]}
    return [*TEMPLATES[family], *(line for line in spdx if line.lower() not in told)]


def examples(background, settings, families=None):
    """(lines, labels) for training and (lines, labels) kept apart; ``families`` may leave some out."""
    random = np.random.default_rng(settings.seed)
    known = families or tuple(TEMPLATES)
    classes = [NONE, OTHER, *known]
    parts = ([], []), ([], [])
    for label, lines in ((OTHER, GENERIC), *((f, lines_of(f)) for f in known)):
        for line in lines:
            for copy in range(settings.copies):
                held = parts[copy % 4 == 3]
                made = _filled(line, random, background)
                held[0].append(made if copy == 0 else distorted(made, random, background))
                held[1].append(classes.index(label))
    for i, line in enumerate(background):
        parts[i % 4 == 3][0].append(line)
        parts[i % 4 == 3][1].append(0)
    return classes, *parts


def train(background: list[str], settings: Settings = Settings(), families: tuple[str, ...] | None = None) -> Model:
    """Fit weights on templates, distorted copies and background, and the temperature on copies kept apart."""
    known = Known(settings, families)
    plain = [b for b in background if b.strip() and not known.licence_like(words_of(b.encode()))]
    classes, (lines, labels), held = examples(plain, settings, families)
    one, two, first, last = _encoded(lines, settings)
    # The features of each line in order: its words, then its pairs.
    n_one, n_two = last - first, np.maximum(last - first - 1, 0)
    size = n_one + n_two
    starts = np.cumsum(size) - size
    inside = np.arange(size.sum()) - np.repeat(starts, size)
    single = inside < np.repeat(n_one, size)
    word = np.repeat(first, size) + np.where(single, inside, inside - np.repeat(n_one, size))
    buckets = np.where(single, one[word], two[np.minimum(word, max(len(two) - 1, 0))] if len(two) else 0)
    used, column = np.unique(buckets, return_inverse=True)
    owner = np.repeat(np.arange(len(lines)), size)
    by_column = np.argsort(column, kind="stable")
    heads = np.searchsorted(column[by_column], np.arange(len(used)))
    scale = 1 / np.sqrt(np.maximum(2 * n_one - 1, 1))
    truth = np.eye(len(classes))[labels]
    weights, bias = np.zeros((len(used), len(classes))), np.zeros(len(classes))
    squares = np.full_like(weights, 1e-8)
    for _ in range(settings.rounds):
        value = np.add.reduceat(weights[column], starts, axis=0) * scale[:, None] + bias
        error = (softmax(value) - truth) / len(lines)
        gradient = np.add.reduceat((error * scale[:, None])[owner[by_column]], heads, axis=0)
        gradient += settings.decay * weights / len(lines)
        squares += gradient**2
        weights -= settings.rate * gradient / np.sqrt(squares) * 0.1
        bias -= settings.rate * error.sum(0)
    model = Model(classes, np.zeros((settings.buckets, len(classes))), bias, 1.0)
    model.weights[used] = weights
    values = logits(model, *_encoded(held[0], settings))
    grid = np.exp(np.linspace(-2, 2, 41))
    losses = [-np.log(softmax(values / t)[np.arange(len(held[1])), held[1]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    return model


def words_of(line: bytes) -> list[bytes]:
    words = [w.strip(b".,;:!?()[]{}\"'*<>|").lower() for w in re.split(rb"[\x20\x09-\x0d,;:!?()\[\]{}\"'*<>|]+", line)]
    words = [w.removeprefix(b"http//").removeprefix(b"//").removeprefix(b"www.") for w in words]
    return [w for w in words if w]


def pairs_of(words) -> set[bytes]:
    return {a + b" " + b for a, b in zip(words[:-1], words[1:], strict=True)} or set(words)


class Known:
    """Templates by family with weighted word pairs, and names as word lists."""

    def __init__(self, settings, families=None):
        self.settings = settings
        chosen = families or tuple(TEMPLATES)
        self.templates = {f: [pairs_of(words_of(t.encode())) for t in lines_of(f)] for f in chosen}
        self.names = {f: [n.encode().split() for n in NAMES[f]] for f in chosen}
        every = [t for lines in self.templates.values() for t in lines]
        generic = [pairs_of(words_of(part.encode())) for t in GENERIC for part in t.split("{}")]
        self.weight = {}
        for pair in set().union(*every):
            held = sum(pair in t for t in every)
            self.weight[pair] = float(np.log(1 + len(every) / held))
        self.pairs = set().union(*every, *generic)
        self.named = {
            f: [any(self._at(words_of(t.encode()), n) for n in self.names[f]) for t in lines_of(f)] for f in chosen
        }

    @staticmethod
    def _at(words, name):
        """Places after the name where its words stand together."""
        n = len(name)
        return [i + n for i in range(len(words) - n + 1) if words[i : i + n] == name]

    def name_in(self, words, family):
        for name in self.names[family]:
            for after in self._at(words, name):
                if name[-1] not in (b"attribution", b"by") and not name[-1].startswith((b"attribution-", b"by-")):
                    return True
                follower = words[after].decode(errors="replace") if after < len(words) else ""
                if not follower or follower[0].isdigit() or follower in FOLLOWERS:
                    return True
        return False

    def overlap(self, pairs, template):
        """Share of the template's own weight that the stretch holds."""
        return sum(self.weight[p] for p in template & pairs) / sum(self.weight[p] for p in template)

    def confirms(self, words, family):
        pairs, named = pairs_of(words), self.name_in(words, family)
        for template, has_name in zip(self.templates[family], self.named[family], strict=True):
            least = self.settings.least_overlap if has_name else self.settings.least_alone
            if (named or not has_name) and self.overlap(pairs, template) >= least:
                return True
        return False

    def licence_like(self, words):
        pairs = pairs_of(words)
        shared = len(pairs & self.pairs)
        least = 2 if any(w.startswith((b"licens", b"licenc")) for w in words) else 3
        return (shared >= least and shared >= self.settings.least_known * len(pairs)) or b"spdx-license-identifier" in words

    def judged(self, words, classes, probability):
        """(family or other, probability), or None for a stretch without licence language."""
        best = int(probability.argmax())
        family, p = classes[best], float(probability[best])
        if best > 1 and p >= self.settings.least_probability and self.confirms(words, family):
            return family, p
        licence = 1.0 - float(probability[0])
        spdx = b"spdx-license-identifier" in words
        if spdx or (licence >= self.settings.least_other and self.licence_like(words)):
            return OTHER, max(licence, self.settings.least_other) if spdx else licence
        return None


def background_lines(docs: DataFrame, settings: Settings) -> list[str]:
    """Lines of the documents of smallest hash; both numbers are bounded by the settings."""
    hashed = texts(docs).where("text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    # Hashes alone are ranked, so no text is shuffled but those chosen.
    least = hashed.select("h").distinct().orderBy("h").limit(settings.background_documents)
    chosen = hashed.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"])
    lines = chosen.select("h", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) != ''")
    return [r.line for r in lines.orderBy(F.xxhash64("h", "line"), "line").limit(settings.background_lines).collect()]


def hits_of(data, offsets, model, known, settings, hasher, apart):
    """Per row the number of lines with words and the hits (family, probability): lines, then runs of windows beside them."""
    found = stretches(data, offsets, hasher, apart)
    one, two = buckets_of(found.codes, settings)
    n = len(found.first)
    probability = softmax(logits(model, one, two, found.first, found.last) / model.temperature) if n else np.zeros((0, 1))
    filled = found.last > found.first
    lines = np.arange(n) < found.n_lines
    ask = filled & (probability.argmax(1) > 0 if n else filled)
    for match in SPDX.finditer(bytes(data)):
        word = np.searchsorted(found.starts, match.start(), "right") - 1
        ask |= filled & lines & (found.first <= word) & (word < found.last)
    row_of = np.searchsorted(found.n_words, found.first, "right") - 1
    counts = np.bincount(row_of[filled & lines], minlength=len(offsets) - 1)
    hits, judged = {}, []
    for i in np.flatnonzero(ask).tolist():
        first, last = int(found.first[i]), int(found.last[i])
        result = known.judged(words_of(bytes(data[found.starts[first] : found.ends[last - 1]])), model.classes, probability[i])
        if result is not None:
            judged.append((result[0] == OTHER, not lines[i], -result[1], first, last, int(row_of[i]), result))
    # Of stretches that overlap, the one that says most counts: a family before other, a line before a window.
    taken = np.zeros(len(found.codes) + 1, bool)
    for _, _, _, first, last, row, result in sorted(judged):
        if not taken[first:last].any():
            taken[first:last] = True
            hits.setdefault(row, []).append(result)
    return counts, hits


def _scan(model, settings):
    known = Known(settings)
    local = Model(model.classes, model.weights.astype(np.float32).astype(float), model.bias, model.temperature)

    def run(batches):
        hasher, apart = Hasher(lower=True), word_table()
        for batch in batches:
            found = []
            for _, _, data, offsets in pieces(batch.column("text"), 1 << 19):
                counts, hits = hits_of(data, offsets, local, known, settings, hasher, apart)
                for r, count in enumerate(counts.tolist()):
                    mine = hits.get(r, [])
                    families = sorted({f for f, _ in mine})
                    sure = max(mine, key=lambda x: (x[0] != OTHER, x[1], x[0]), default=(NONE, 0.0))
                    found.append((count, len(mine), sure[0], round(sure[1], 6), ",".join(families)))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_paragraphs", "n_licence", "licence", "confidence", "families"],
            )

    return run


def licence_scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row with doc_id, n_paragraphs, n_licence, licence, confidence and families."""
    model = train(background_lines(docs, settings), settings)
    return texts(docs).mapInArrow(
        _scan(model, settings),
        "doc_id long, n_paragraphs long, n_licence long, licence string, confidence double, families string",
    )
