"""License scans: a trained classifier of paragraphs, confirmed by comparison with templates.

A text is read twice: by lines cut at sentence ends, and by sentences that run on over wrapped and comment-prefixed
lines to a blank line.  Features are hashed word 1- and 2-grams; a softmax regression over licence families, "unknown"
(speaks like a licence, names none of the families) and "none" is trained here, on the driver, from the templates and
names below, whole, in fragments and among other words, and a bounded sample of paragraphs.  The templates are dealt
into folds, whole ones to each; a temperature that makes the probabilities honest for templates never seen is fitted on
what models of the other folds say of each fold.  A prediction counts if the paragraph shares enough word trigrams with
a template of that family and not more with one of another, which tells the GPL, LGPL and AGPL apart, or if it calls the
family by one of its names in the words of a notice.  Scoring is one pass over whole texts in numpy: gather the weights,
add them up by paragraph.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.common import read

#: Notices and sentences of public licences.
TEMPLATES = {
    "agpl": [
        "licensed under the GNU Affero General Public License version 3",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "released under the AGPL 3.0 license",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "See the GNU Affero General Public License for more details",
        "This file is part of a program that is free software under the GNU AGPL, either version 3 of the License, or any later version",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed to the Apache Software Foundation under one or more contributor license agreements",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
        "released under the Apache 2.0 license",
        "This project is distributed under the terms of the Apache License, Version 2.0",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "licensed under the 2-clause BSD license",
        "distributed under the terms of the modified BSD license",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0",
        "Use, modification and distribution are subject to the Boost Software License, Version 1.0",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Content is available under the Creative Commons Attribution license",
        "text available under CC-BY 3.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Content is available under the Creative Commons Attribution-NonCommercial license",
        "shared under CC BY-NC 3.0 for noncommercial use only",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "shared under CC BY-SA 3.0, share alike",
    ],
    "cc0": [
        "released under CC0 1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication",
        "made available under the Creative Commons CC0 waiver",
    ],
    "epl": [
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
        "Licensed under the Eclipse Public License 1.0",
        "which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 2 of the License, or (at your option) any later version of the GNU GPL",
        "released under the GPL version 2 license",
        "You should have received a copy of the GNU General Public License along with this program",
        "See the GNU General Public License for more details",
        "may be used under the terms of the GNU General Public License version 2.0 or later",
        "distributed under the GPLv3",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "licensed under the ISC License",
        "distributed under the terms of the ISC license",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License version 2.1",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This library is distributed in the hope that it will be useful under the GNU LGPL",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "See the GNU Lesser General Public License for more details",
        "under the terms of the GNU Library General Public License, version 2",
        "released under the LGPL 3.0 license",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE",
        "This project is licensed under the terms of the MIT license",
        "distributed under the MIT licence, see the LICENSE file",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License 2.0",
        "released under the MPL 2.0 license",
    ],
    "reserved": [
        "All rights reserved",
        "Copyright by the authors, all rights reserved",
        "No part of this publication may be reproduced without permission",
        "reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",
        "Unauthorized copying of this file, via any medium, is strictly prohibited",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
        "released under the Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
        "licensed under the zlib license",
    ],
}
#: What licences are called, in identifiers and in prose.
NAMES = {
    "agpl": ["AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU Affero General Public License", "Affero GPL"],
    "apache": ["Apache", "Apache-2.0", "Apache 2.0", "Apache License", "Apache License 2.0", "Apache Software License", "ASL 2.0"],
    "bsd": ["BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSD License", "3-clause BSD", "2-clause BSD", "New BSD License", "Simplified BSD License"],
    "boost": ["BSL-1.0", "Boost Software License", "Boost License"],
    "cc-by": ["CC-BY-4.0", "CC-BY-3.0", "CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC-BY-NC-3.0", "CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": ["CC-BY-SA-4.0", "CC-BY-SA-3.0", "CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike"],
    "cc0": ["CC0", "CC0-1.0", "CC0 1.0", "Creative Commons Zero"],
    "epl": ["EPL", "EPL-1.0", "EPL-2.0", "Eclipse Public License"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GNU GPL", "GNU General Public License", "General Public License"],
    "isc": ["ISC", "ISC License"],
    "lgpl": ["LGPL", "LGPLv2", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "GNU LGPL", "GNU Lesser General Public License", "GNU Library General Public License"],
    "mit": ["MIT", "MIT License", "MIT licence", "Expat License"],
    "mpl": ["MPL", "MPL-2.0", "MPL 2.0", "MPL-1.1", "Mozilla Public License"],
    "unlicense": ["Unlicense", "The Unlicense"],
    "zlib": ["Zlib", "zlib License", "zlib/libpng License"],
}
#: How a notice leads to a name.
NOTICES = [
    "SPDX-License-Identifier: {}", "License: {}", "license = {}", "Licence: {}", "licensed under the {}", "licensed under {}", "released under the {} license", "distributed under the terms of the {}",
    "this is free software under {} or later", "available under the {}", "see the {} for details", "covered by the {} license", "under {}",
]
#: Parts of licence-like sentences that name no known family.
UNKNOWN_VERBS = ["licensed under the", "distributed under the", "released under the terms of the", "covered by the", "subject to the", "available under the"]
UNKNOWN_NAMES = ["Acme", "Example", "Vendor", "Community", "Evaluation", "Research", "Academic", "Internal", "Partner", "House", "Sample", "Project"]
UNKNOWN_ENDS = ["License", "Licence", "License Agreement", "License version 1", "Terms of License", "Source License"]
#: Words one of which any report of an unknown licence must have.
TERMS = re.compile(r"(?i)licen[sc]|copyright|copyleft|rights reserved|permission|redistribut|public domain|warrant")
_WORD = re.compile(r"[a-z0-9]+|[^\x00-\x7f]+")
_ENDS = re.compile(rb"\n|(?<=[.!?])[ \t]+")
#: Where a sentence that runs on over lines ends: at a stop, or where a line holds neither letter nor digit.
_SENTENCE = re.compile(rb"(?<=[.!?])(?<!\W[A-Za-z]\.)[\"')]*\s+|\n(?=[^\w\x80-\xff\n]*(?:\n|\Z))")
#: One of these is in every text that is read by sentences, too, lower-cased.
_HINTS = (b"licen", b"copyright", b"permi", b"redistribut", b"warrant", b"free software", b"public", b"rights reserved", b"gpl", b"notice", b"liab")
_NOTICE = re.compile(r"(?i)licen[sc]|spdx|\bunder\b|\bterms\b|free software|copyright")
#: Names that mean other things, too, and say nothing unless a licence is spoken of.
PLAIN = {"Apache", "MIT", "BSD", "ISC", "Zlib", "EPL", "MPL"}
BUCKETS_LOG2 = 15
FOLDS = 3


@functools.lru_cache(maxsize=1)
def _cells() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (32, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(text: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, paragraph) of every 1-gram and of every 2-gram inside a paragraph; cuts are paragraph starts."""
    b = np.frombuffer(text, np.uint8)
    b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    word = ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(size.sum()) - np.repeat(first, size)
    h = _mix(np.add.reduceat(_cells()[place & 31, b[word]] + place.astype(np.uint64), first))
    part = np.searchsorted(cuts, starts, "right") - 1
    both = _mix(h[:-1] * np.uint64(3) + h[1:])[part[:-1] == part[1:]]
    shift = np.uint64(64 - BUCKETS_LOG2)
    return (
        np.concatenate((h >> shift, both >> shift)).astype(np.int64),
        np.concatenate((part, part[1:][part[:-1] == part[1:]])),
    )


def paragraphs(text: bytes, ends: re.Pattern[bytes] = _ENDS) -> np.ndarray:
    """Byte offsets at which paragraphs start."""
    return np.array([0, *(m.end() for m in ends.finditer(text))], np.int64)


def sentences(text: bytes) -> np.ndarray | None:
    """Byte offsets at which sentences start, however their lines are wrapped; None where lines say it all."""
    low = text.lower()
    return paragraphs(text, _SENTENCE) if b"\n" in text and any(h in low for h in _HINTS) else None


def _spelt(name: str) -> str:
    return r"[\s/-]+".join(map(re.escape, re.split(r"[\s/-]+", name)))


@functools.lru_cache(maxsize=1)
def _patterns() -> list[tuple[str, bool, re.Pattern[str]]]:
    """(family, whether the name is a plain one, name as whole words): short names as written, the others in any case."""
    return [(f, n in PLAIN, re.compile(rf"(?<![A-Za-z0-9]){_spelt(n)}(?![A-Za-z0-9])", re.I if len(n) > 6 else 0)) for f, ns in NAMES.items() for n in ns]


def named(text: str) -> set[str]:
    """Families that a notice calls by name; of names that overlap the first, of those at one place the longest counts."""
    if not _NOTICE.search(text):
        return set()
    flat = re.sub(r"\n[^\w\n]*", " ", text)
    spoken = re.search(r"(?i)licen[sc]|spdx", flat)
    best: dict[int, tuple[int, str]] = {}
    for f, plain, pattern in _patterns():
        for m in pattern.finditer(flat) if spoken or not plain else ():
            best[m.start()] = max(best.get(m.start(), (0, "")), (m.end(), f))
    found, last = set(), -1
    for at, (end, f) in sorted(best.items(), key=lambda x: (x[0], -x[1][0])):
        if end > last:
            found.add(f)
            last = end
    return found


def trigrams(text: str) -> set[tuple[str, ...]]:
    w = _WORD.findall(text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


@dataclass
class Model:
    """Weights (bucket x class), class names, temperature, share of trigrams that confirms, prior of "none".

    Classes weigh the same in training; the prior puts back how rare licence paragraphs are.
    """

    weights: np.ndarray
    classes: list[str]
    temperature: float
    confirm: float = 0.5
    prior: float = 0.9

    def probabilities(self, text: bytes, cuts: np.ndarray, prior: float | None = None) -> np.ndarray:
        bucket, part = features(text, cuts)
        order = np.argsort(part, kind="stable")
        bucket, part = bucket[order], part[order]
        z = np.zeros((len(cuts), len(self.classes)), np.float32)
        if len(bucket):
            at = np.flatnonzero(np.diff(part, prepend=-1))
            n = np.diff(np.append(at, len(part))).astype(np.float32)[:, None]
            z[part[at]] = np.add.reduceat(self.weights[bucket], at, axis=0) / np.sqrt(n) / self.temperature
        prior = self.prior if prior is None else prior
        z[:, self.classes.index("none")] += np.log(prior / (1 - prior) * (len(self.classes) - 1))
        return _soft(z)

    def families(self, text: str) -> tuple[set[str], bool, bool]:
        """Families that the templates confirm: those with a template that shares enough trigrams with the paragraph, none sharing more; else one called by name.

        And whether that is much, more than three trigrams or a name, and whether it is most of the template, or a name.
        """
        own = trigrams(text)
        if not own:
            return set(), False, False
        best: dict[str, tuple[float, int, float]] = {}
        for name, t in _template_trigrams():
            shared = len(own & t)
            best[name] = max(best.get(name, (0.0, 0, 0.0)), (shared / min(len(own), len(t)) + shared / 1000, shared, shared / len(t)))
        top = max(best.values())
        if top[0] >= self.confirm:
            return {f for f, x in best.items() if x[0] == top[0]}, top[1] > 3, top[2] >= 0.6
        called = named(text)
        return (called, True, True) if len(called) == 1 else (set(), False, False)

    def confirmed(self, family: str, text: str) -> bool:
        return family in self.families(text)[0]


@functools.lru_cache(maxsize=1)
def _template_trigrams() -> list[tuple[str, set[tuple[str, ...]]]]:
    return [(family, trigrams(x)) for family, texts in TEMPLATES.items() for x in texts]


def training_rows(background: list[str], seed: int = 1, copies: int = 12) -> list[tuple[str, str, int]]:
    """(class, paragraph, fold): templates with words dropped, cut to fragments, or set among background words; names in notices; and others.

    All copies of a template, all notices of a kind and all unknown sentences of a name are of one fold.
    """
    rnd = random.Random(seed)
    loose = [w for p in background[:500] for w in p.split()] or ["the"]
    out = []
    for family, texts in TEMPLATES.items():
        for k in range(copies * len(texts)):
            w = texts[k % len(texts)].split()
            turn = k // len(texts) % 6
            if turn == 1:
                w = [x for x in w if rnd.random() > 0.08] or w
            if turn == 2:
                w = rnd.choices(loose, k=rnd.randint(1, 4)) + w + rnd.choices(loose, k=rnd.randint(0, 4))
            if turn > 2 and len(w) > 8:
                # A wrapped line of it.
                n = rnd.randint(7, min(13, len(w)))
                at = rnd.randint(0, len(w) - n)
                w = w[at : at + n]
            out.append((family, " ".join(w), k % len(texts) % FOLDS))
        for k, notice in enumerate(NOTICES):
            out += [(family, notice.format(n), k % FOLDS) for n in NAMES.get(family, []) if n not in PLAIN or re.search("(?i)licen", notice)]
    for k in range(copies * 24):
        name = UNKNOWN_NAMES[k % len(UNKNOWN_NAMES)]
        w = f"{rnd.choice(UNKNOWN_VERBS)} {name} {rnd.choice(UNKNOWN_ENDS)}".split()
        out.append(("unknown", " ".join(rnd.choices(loose, k=rnd.randint(0, 3)) + w), k % len(UNKNOWN_NAMES) % FOLDS))
    return out + [("none", p, k % FOLDS) for k, p in enumerate(background)]


def _soft(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass
class Fitting:
    """Rows as a sparse matrix of hashed features, and gradient descent on some of them."""

    rows: list[tuple[str, str, int]]

    def __post_init__(self):
        self.classes = sorted({c for c, *_ in self.rows} | {"none", "unknown"})
        self.y = np.array([self.classes.index(c) for c, *_ in self.rows])
        self.fold = np.array([f for *_, f in self.rows])
        cells = [features(text.encode(), np.zeros(1, np.int64))[0] for _, text, _ in self.rows]
        self.owner = np.repeat(np.arange(len(cells)), [len(x) for x in cells])
        self.used, self.col = np.unique(np.concatenate(cells), return_inverse=True)
        size = np.maximum(np.bincount(self.owner, minlength=len(cells)), 1)
        self.value = (1 / np.sqrt(size))[self.owner]
        self.who, self.at = np.unique(self.owner, return_index=True)
        self.by_col = np.argsort(self.col, kind="stable")
        self.col_at = np.unique(self.col[self.by_col], return_index=True)[1]

    def scores(self, w: np.ndarray) -> np.ndarray:
        z = np.zeros((len(self.rows), len(self.classes)))
        z[self.who] = np.add.reduceat(w[self.col] * self.value[:, None], self.at, axis=0)
        return z

    def weights(self, some: np.ndarray, rounds: int, rate: float, decay: float) -> np.ndarray:
        """Softmax regression on the rows ``some``, each class weighing the same."""
        truth, w = np.eye(len(self.classes))[self.y], np.zeros((len(self.used), len(self.classes)))
        share = np.bincount(self.y[some], minlength=len(self.classes)).astype(float)
        weight = (some.sum() / len(self.classes) / np.maximum(share, 1))[self.y] * some
        for _ in range(rounds):
            gap = (_soft(self.scores(w)) - truth) * weight[:, None]
            grad = np.add.reduceat((gap[self.owner] * self.value[:, None])[self.by_col], self.col_at, axis=0)
            w -= rate * (grad / some.sum() * len(self.classes) + decay * w)
        return w

    def unseen(self, rounds: int, rate: float, decay: float) -> np.ndarray:
        """Scores of each fold by a model of the others."""
        z = np.zeros((len(self.rows), len(self.classes)))
        for f in range(FOLDS):
            z[self.fold == f] = self.scores(self.weights(self.fold != f, rounds, rate, decay))[self.fold == f]
        return z


def train(background: list[str], rounds: int = 80, rate: float = 5.0, decay: float = 1e-4) -> Model:
    """The model of all rows, with the temperature that suits templates that a model has not seen."""
    fitting = Fitting(training_rows(background))
    z, y = fitting.unseen(rounds, rate, decay), fitting.y
    loss = lambda t: -np.log(_soft(z / t)[np.arange(len(z)), y] + 1e-12).mean()
    temperature = min((0.05 * 1.25**k for k in range(24)), key=loss)
    full = np.zeros((1 << BUCKETS_LOG2, len(fitting.classes)), np.float32)
    full[fitting.used] = fitting.weights(np.ones(len(y), bool), rounds, rate, decay)
    return Model(full, fitting.classes, float(temperature))


def unseen_quality(background: list[str], rounds: int = 80, rate: float = 5.0, decay: float = 1e-4, bins: int = 10) -> dict[str, float]:
    """What models say of templates they have not seen: shares called a licence and called the right family, false alarms, and the
    calibration error (mean gap between confidence and accuracy in bins of confidence)."""
    fitting = Fitting(training_rows(background))
    z, y = fitting.unseen(rounds, rate, decay), fitting.y
    p = _soft(z / train(background, rounds, rate, decay).temperature)
    none, unknown = fitting.classes.index("none"), fitting.classes.index("unknown")
    said, sure = p.argmax(1), p.max(1)
    known = (y != none) & (y != unknown)
    place = np.minimum((sure * bins).astype(int), bins - 1)
    gaps = [abs(sure[place == b].mean() - (said == y)[place == b].mean()) * (place == b).mean() for b in range(bins) if (place == b).any()]
    return {
        "licence": float((said != none)[y != none].mean()), "family": float((said == y)[known].mean()),
        "false": float((said != none)[y == none].mean()), "calibration_error": float(sum(gaps)),
    }


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", background_docs: int = 300, per_doc: int = 5, paragraph_chars: int = 2000) -> Model:
    """Train with background paragraphs of a bounded sample: ``per_doc`` of each of ``background_docs`` documents.

    Both are the least by a hash, of id and text and of the paragraph, over all documents and whole texts, so the sample
    does not depend on files or partitions.  Of a paragraph at most ``paragraph_chars`` are used.  Runs two jobs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.filter(F.transform(F.split(text, r"\n|(?<=[.!?])[ \t]+"), F.trim), lambda p: (p != "") & ~F.rlike(p, F.lit(TERMS.pattern)))
    first = F.slice(F.array_sort(F.transform(F.array_distinct(parts), lambda p: F.struct(F.xxhash64(p).alias("h"), F.substring(p, 1, paragraph_chars).alias("p")))), 1, per_doc)
    order = F.xxhash64(F.col(id_col), text)
    last = docs.select(order.alias("h")).orderBy("h").limit(background_docs).agg(F.max("h")).first()[0]
    if last is None:
        return train([])
    some = docs.filter(order <= last).select(order.alias("h"), F.col(id_col).alias("i"), first.alias("parts"))
    rows = some.orderBy("h", "i").limit(background_docs).collect()
    return train([x["p"] for r in rows for x in r.parts])


def _judged(m: Model, text: bytes, cuts: np.ndarray, least: float) -> list[tuple[int, int, str, float, bool, bool]]:
    """(start, end in bytes, family, probability, confirmed, confirmed by most of a template) of the paragraphs that speak of licences."""
    none, out = m.classes.index("none"), []
    even = m.probabilities(text, cuts, 0.5)
    for i in np.flatnonzero(1 - even[:, none] >= least):
        s, e = int(cuts[i]), int(cuts[i + 1]) if i + 1 < len(cuts) else len(text)
        s += len(text[s:e]) - len(text[s:e].lstrip())
        raw = text[s:e].rstrip()
        part = raw.decode()
        families, much, most = m.families(part)
        # The prior says how rare licences are among all paragraphs; among those that repeat the words of a template others are.
        p = even[i].copy()
        p[none] *= (1 - m.prior) / m.prior if much else m.prior / (1 - m.prior)
        p /= p.sum()
        among = [m.classes.index(f) for f in sorted(families)]
        # Words that several families share are theirs together; the likeliest of them is named.
        sure = bool(among) and float(p[among].sum()) >= least
        if sure or 1 - p[none] >= least and TERMS.search(part):
            family = m.classes[max(among, key=lambda k: p[k])] if sure else "unknown"
            out.append((s, s + len(raw), family, float(p[among].sum() if sure else 1 - p[none]), sure, sure and most))
    return out


def find(m: Model, text: bytes, least: float = 0.5) -> list[dict]:
    """Findings of both readings of a text as rows; offsets are code points."""
    lines = _judged(m, text, paragraphs(text), least)
    cuts = sentences(text)
    if cuts is not None:
        for x in _judged(m, text, cuts, least):
            own = [y for y in lines if y[0] < x[1] and x[0] < y[1]]
            if b"\n" not in text[x[0] : x[1]] or any(y[4] for y in own) and not x[4]:
                continue
            # Two whole licences on lines of their own are not one sentence, and a line that says as much alone needs no neighbours.
            if len({y[2] for y in own if y[5]}) > 1 or len(own) == 1 and own[0][5] and own[0][3] >= x[3]:
                continue
            lines = [y for y in lines if y not in own] + [x]
    found = []
    for s, e, family, p, sure, _ in sorted(lines):
        start = len(text[:s].decode())
        found.append({"family": family, "start": start, "end": start + len(text[s:e].decode()), "probability": round(p, 6), "confirmed": sure})
    return found


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: its id and ``found``, an array of (family, start, end, probability, confirmed).

    Offsets are code points of the line or, where one that runs over several lines says more, of the sentence; spans of
    one reading do not overlap, and a sentence takes the place of what its lines gave.  A family counts if its
    probability reaches ``least`` and a template or a name confirms it; if none does, or the confirmation fails, but
    licence classes together reach ``least`` and the paragraph has one of ``TERMS``, it is reported as "unknown".  A null
    or empty text has none.  Ids of any type pass through, null or repeated; an empty table gives an empty result; other
    columns are not returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part_of, out = batch.slice(k, 256), []
                for text in part_of.column(1).to_pylist():
                    found = find(m, text, least)
                    out.append(found)
                yield pa.RecordBatch.from_arrays([part_of.column(0), pa.array(out, shape)], names=["doc", "found"])

    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = StructType([base.schema["doc"], *StructType.fromDDL("found array<struct<family: string, start: int, end: int, probability: double, confirmed: boolean>>")])
    return base.mapInArrow(run, kind).withColumnRenamed("doc", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scan(docs, fit(docs))
    sure = F.filter("found", lambda x: x["confirmed"])
    return out.select(
        "doc_id",
        F.size(sure).cast("long").alias("n_confirmed"),
        (F.size("found") - F.size(sure)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        "found",
    )
