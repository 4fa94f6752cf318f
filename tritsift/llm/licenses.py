"""License scans by a trained paragraph classifier.

A paragraph is a line, or a part of up to ``max_lines`` lines of a run of lines
without a blank one, as statements are wrapped in a file's header: of these the
least ones that hold the share ``confirm`` of a template's word pairs, over the
lines' ends too. Softmax regression over hashed word 1-
to ``max_n``-grams tells licence families and an unknown class apart. It is
trained on the templates below, varied by lost and added words, and for the
unknown class on near misses and on at most ``max_unknown`` distinct lines of the corpus
that resemble no template; a held-out part sets the temperature that calibrates
the probabilities. A paragraph is reported for a family whose probability is
``threshold`` or more, if the family's nearest template confirms it: the share
``confirm`` of the template's word pairs stands in the paragraph. A part of
several lines is reported under its first line, and not if a line or a better
part that it overlaps is reported for the same family.

Null and empty texts and lines without words have no finding. Rows with a null
doc_id are reported under null. Repeated rows and lines are each judged. Lines
of any length are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritsift.llm import packed, store
from tritsift.llm import text as tx

_U = np.uint64

TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "This project is distributed under the Apache License 2.0.", "Apache License Version 2.0, January 2004"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "This project is licensed under the MIT License.", "The MIT License (MIT)"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under the GNU GPL, version 2 or later.", "GNU General Public License Version 3, 29 June 2007"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "GNU Lesser General Public License Version 3", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution license."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "public-domain": ("This work has been released into the public domain.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "This document is confidential and proprietary. Unauthorized copying is prohibited."),
}
UNKNOWN = "unknown"
NEAR_MISSES = (
    "Bring your driver's license and a second form of identification.",
    "The council renewed the restaurant's liquor license for another version of the menu.",
    "He became an apache helicopter pilot after years at MIT.",
    "The general public was free to use the library under the new terms.",
    "Poetic license allows the author to modify the source of the tale.",
    "The software was released in June and permission was granted to visit the site.",
    "Version 2.0 of the public timetable is published by the ministry.",
    "The foundation is free of charge for any person in the creative arts.",
    "The work of the commons committee was released to the public.",
    "Hunting licenses are issued under the general rules of the county.",
    "The BSD conference met in a public hall without modification of the program.",
    "Rights and duties of the reserved seats are printed on the ticket.",
)


@dataclass(frozen=True)
class LicenseParams:
    bits: int = 16
    max_n: int = 2
    #: Distinct lines of the corpus, the first in the order of a hash, that train the unknown class.
    max_unknown: int = 2000
    copies: int = 24
    epochs: int = 80
    rate: float = 0.05
    l2: float = 1e-6
    threshold: float = 0.6
    confirm: float = 0.6
    max_lines: int = 12
    seed: int = 7


@dataclass(frozen=True)
class LicenseModel:
    families: tuple[str, ...]
    #: A row a feature, a column a class, the last for the unknown.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Word-pair hashes of the templates, by family.
    pairs: tuple[tuple[np.ndarray, ...], ...]
    params: LicenseParams


def lines_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a column, where the words of each line with words begin (one more at the end), and the lines' rows and numbers."""
    data, offs = tx.buffers(pc.utf8_lower(arr))
    h, start, _, row = tx.words(arr)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, start)  # breaks before each word
    owner = np.repeat(np.arange(len(row) - 1), np.diff(row))
    begin, _ = packed.runs(owner * (len(breaks) + 1) + line)
    before = np.searchsorted(breaks, offs[:-1])
    return h, np.append(begin, len(h)), owner[begin], line[begin] - before[owner[begin]]




def features(h: np.ndarray, row: np.ndarray, p: LicenseParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their rows, and the rows' numbers of features; the features of a row stand together."""
    idx, own = [], []
    for n in range(1, p.max_n + 1):
        g, at = tx.ngrams(h, row, n)
        idx.append((tx.mix(g + _U(n)) >> _U(64 - p.bits)).astype(np.int32))
        own.append(np.repeat(np.arange(len(at) - 1), np.diff(at)))
    i, o = np.concatenate(idx), np.concatenate(own)
    order = np.argsort(o, kind="stable")
    return i[order], o[order], np.bincount(o, minlength=len(row) - 1)


def logits(h: np.ndarray, row: np.ndarray, m: LicenseModel) -> np.ndarray:
    i, o, n = features(h, row, m.params)
    out = np.tile(m.bias, (len(n), 1))
    start, _ = packed.runs(o)
    if len(start):
        out[o[start]] += np.add.reduceat(m.weights[i], start, axis=0) / np.sqrt(n[o[start]])[:, None]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def word_pairs(h: np.ndarray) -> np.ndarray:
    return np.unique(tx.ngrams(h, np.array([0, len(h)]), 2)[0])


def coverage(pairs: np.ndarray, templates: tuple[np.ndarray, ...]) -> float:
    """The largest share of a template's word pairs that stand in the paragraph."""
    return max(float(np.isin(t, pairs).mean()) for t in templates)


def variants(rng: np.random.Generator, noise: list[str], p: LicenseParams) -> list[tuple[str, int]]:
    """Templates with words lost and others added around them, and their classes."""
    out = []
    for c, forms in enumerate(TEMPLATES.values()):
        for form in forms:
            words = form.split()
            for k in range(p.copies):
                kept = [w for w in words if k == 0 or rng.random() > 0.06]
                around = [noise[j] for j in rng.integers(0, len(noise), int(rng.integers(0, 14)) if k else 0)]
                at = int(rng.integers(0, len(around) + 1))
                out.append((" ".join(around[:at] + kept + around[at:]), c))
    return out


def fit(data: list[tuple[str, int]], p: LicenseParams) -> LicenseModel:
    rng = np.random.default_rng(p.seed)
    families = tuple(TEMPLATES)
    classes = len(families) + 1
    h, _, _, row = tx.words(pa.array([t for t, _ in data]))
    i, o, n = features(h, row, p)
    ends = np.searchsorted(o, np.arange(len(data) + 1))
    y = np.array([c for _, c in data])
    order = rng.permutation(len(data))
    train, held = order[: len(data) * 4 // 5], order[len(data) * 4 // 5 :]
    w, b = np.zeros((1 << p.bits, classes)), np.zeros(classes)
    used, at = np.unique(i, return_inverse=True)  # only these weights move
    rows = np.repeat(np.arange(len(data)), np.diff(ends))
    mine = np.isin(rows, train)
    at, rows, x = at[mine], rows[mine], 1 / np.sqrt(n[rows[mine]])
    target = np.eye(classes)[y]
    target[held] = 0
    learn = np.zeros(len(data), bool)
    learn[train] = True
    v, m1, m2 = np.zeros((len(used), classes)), np.zeros((len(used), classes)), np.zeros((len(used), classes))
    start, _ = packed.runs(rows)
    for step in range(1, p.epochs + 1):  # Adam on all rows
        z = np.tile(b, (len(data), 1))
        z[rows[start]] += np.add.reduceat(v[at] * x[:, None], start, axis=0)
        e = (softmax(z) * learn[:, None] - target) / len(train)
        b -= p.rate * e.sum(0)
        g = np.stack([np.bincount(at, e[rows, c] * x, len(used)) for c in range(classes)], 1) + p.l2 * v
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        v -= p.rate * m1 / (1 - 0.9**step) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    w[used] = v
    pairs = tuple(tuple(word_pairs(tx.words(pa.array([t]))[0]) for t in forms) for forms in TEMPLATES.values())
    model = LicenseModel(families, w.astype(np.float32), b, 1.0, pairs, p)
    hr = tx.words(pa.array([data[r][0] for r in held]))
    z, yt = logits(hr[0], hr[3], model), y[held]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(yt)), yt] + 1e-12).mean()
    best = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    return LicenseModel(families, model.weights, b, best, pairs, p)


def train(docs: DataFrame, params: LicenseParams = LicenseParams()) -> LicenseModel:
    """Fit on the templates and a bounded sample of the corpus's lines."""
    p = params
    line = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")).where(F.length(F.trim("line")) > 20)
    sample = [r.line for r in store.first_by_hash(line, ["line"], p.max_unknown).collect()]
    words = [w for s in (*NEAR_MISSES, *sample[:200]) for w in s.split()[:40]]
    data = variants(np.random.default_rng(p.seed), words, p)
    all_pairs = [word_pairs(tx.words(pa.array([t]))[0]) for forms in TEMPLATES.values() for t in forms]
    known = np.unique(np.concatenate(all_pairs))
    unknown = []
    for s in sample:
        mine = word_pairs(tx.words(pa.array([s]))[0])
        mine = mine[np.isin(mine, known)]
        if not len(mine) or max(float(np.isin(t, mine).mean()) for t in all_pairs) < 0.4:
            unknown.append(s)
    misses = [" ".join(w for j, w in enumerate(s.split()) if (j + k) % 11 or not k) for s in NEAR_MISSES for k in range(p.copies)]
    return fit(data + [(s, len(TEMPLATES)) for s in (*unknown, *misses)], p)


def least_windows(hits: list[tuple[int, int, int]], need: int, most: int) -> list[tuple[int, int]]:
    """(first, last) of the parts of 2 to ``most`` lines that hold ``need`` different pairs and don't without their first or their last line, of (line of the first word, line of the second, pair)."""
    ends: dict[int, list[tuple[int, int]]] = {}
    for one, two, pair in hits:
        ends.setdefault(two, []).append((one, pair))
        ends.setdefault(one, [])
    lines, out, count, lo = sorted(ends), [], {}, 0
    within: dict[int, list[int]] = {n: [] for n in lines}  # pairs that are counted, by the line of their first word
    for last in lines:
        for one, pair in ends[last]:
            if one >= lines[lo]:
                count[pair] = count.get(pair, 0) + 1
                within[one].append(pair)
        first = None
        while len(count) >= need:
            first = lines[lo]
            for pair in within[first]:
                count[pair] -= 1
                if not count[pair]:
                    del count[pair]
            lo += 1
        if first is not None and 1 <= last - first < most:
            out.append((first, last))
    return out


def wrapped(h: np.ndarray, row: np.ndarray, owner: np.ndarray, number: np.ndarray, m: LicenseModel) -> list[tuple[int, int, int]]:
    """(family, first, last) of the parts of several lines, as positions of lines, that hold enough of a template's word pairs."""
    lines = len(owner)
    new = np.ones(lines, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1] + 1)
    begin = np.flatnonzero(new)
    para_row = np.append(row[begin], row[-1])
    forms = [(f, t) for f, family in enumerate(m.pairs) for t in family]
    key = np.concatenate([t for _, t in forms])
    which = np.repeat(np.arange(len(forms)), [len(t) for _, t in forms])
    order = np.argsort(key, kind="stable")
    key, which = key[order], which[order]
    g, at = tx.ngrams(h, para_row, 2)
    lo, hi = np.searchsorted(key, g, "left"), np.searchsorted(key, g, "right")
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return []
    count = (hi - lo)[some]
    form = which[np.repeat(lo[some] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    para = np.repeat(np.searchsorted(at, some, "right") - 1, count)
    word = np.repeat(some - at[np.searchsorted(at, some, "right") - 1] + para_row[np.searchsorted(at, some, "right") - 1], count)
    line = np.searchsorted(row, word, "right") - 1
    then = np.searchsorted(row, np.minimum(word + 1, para_row[para + 1] - 1), "right") - 1
    pair = np.repeat(g[some], count)
    need = np.array([int(np.ceil(m.params.confirm * len(t) - 1e-9)) for _, t in forms])
    order = np.lexsort((word, para, form))
    form, para, line, then, pair = form[order], para[order], line[order], then[order], pair[order]
    start, size = packed.runs(form * (len(begin) + 1) + para)
    out = set()
    for s, k in zip(start.tolist(), size.tolist()):
        f = int(form[s])
        if k >= need[f] and line[s] != then[s + k - 1]:
            out |= {(forms[f][0], a, b) for a, b in least_windows(list(zip(line[s : s + k].tolist(), then[s : s + k].tolist(), pair[s : s + k].tolist())), int(need[f]), m.params.max_lines)}
    return sorted(out)


def findings(arr: pa.Array, m: LicenseModel) -> list[tuple[int, int, str, float, float]]:
    """(row, line number, family, probability, similarity) of a column's licence paragraphs."""
    h, row, owner, number = lines_of(arr)
    if not len(h):
        return []
    prob = softmax(logits(h, row, m) / m.temperature)
    c = prob[:, :-1].argmax(1)
    sure = prob[np.arange(len(c)), c]
    out = []
    for r in np.flatnonzero(sure >= m.params.threshold).tolist():
        near = coverage(word_pairs(h[row[r] : row[r + 1]]), m.pairs[c[r]])
        if near >= m.params.confirm:
            out.append((int(owner[r]), int(number[r]), m.families[c[r]], float(sure[r]), near))
    parts = wrapped(h, row, owner, number, m)
    if parts:
        taken = {(r, n, f) for r, n, f, _, _ in out}
        words = [h[row[a] : row[b + 1]] for _, a, b in parts]
        prob = softmax(logits(np.concatenate(words), np.append(0, np.cumsum([len(w) for w in words])), m) / m.temperature)
        sure = [(coverage(word_pairs(w), m.pairs[f]), float(x[f]), f, a, b) for (f, a, b), w, x in zip(parts, words, prob) if x[:-1].argmax() == f and x[f] >= m.params.threshold]
        for near, x, f, a, b in sorted(sure, key=lambda v: (-v[0], -v[1], v[4] - v[3], v[3])):
            at = {(int(owner[n]), int(number[n]), m.families[f]) for n in range(a, b + 1)}
            if near >= m.params.confirm and not at & taken:
                taken |= at
                out.append((int(owner[a]), int(number[a]), m.families[f], x, near))
    return out


def license_lines(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """(doc_id, line_no, family, probability, similarity): the paragraphs that are licence statements; lines are numbered from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * classes * 2**bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch):
                r, n, f, x, s = list(zip(*findings(piece.column("text"), shared.value))) or [()] * 5
                yield pa.record_batch({"doc_id": piece.column("doc_id").take(pa.array(r, pa.int64())), "line_no": pa.array(n, pa.int32()), "family": pa.array(f, pa.string()), "probability": pa.array(x, pa.float64()), "similarity": pa.array(s, pa.float64())})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, line_no int, family string, probability double, similarity double")
