"""Licence notices in texts: MinHash bands over overlapping windows, confirmed by shingle containment.

Texts and templates are normal words as in decontaminate.py; shingles are five words (a template of fewer
is one shingle). A template of m shingles is looked for in windows of m shingles, a quarter of that apart.
A place that holds a share of CONTAINED of the template's shingles has a window with a Jaccard similarity
of at least LEAST; with ROWS minima a band, BANDS bands retrieve it with probability
1 - (1 - LEAST ** ROWS) ** BANDS, over 0.9999. Retrieved places are confirmed on the exact shingles.

Windows without any template's shingle have similarity 0 and are not hashed.

Templates are a parameter, as a list or as a table (name, text): whole licence texts, too. A table is read to the
driver and may hold MAX_TEMPLATE_BYTES, which is checked.

Cases: null and empty texts hold nothing; templates without words are never found; a notice cut by a text's end counts by what is there; repeated
notices of a text give one row at the best place; of different licences' notices that overlap the one of which most
shingles are held is given; templates with equal words are found under each name;
null ids pass; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, inside_doc, mix, read_table, window_hashes
from .decontaminate import normal_words

SHINGLE, CONTAINED = 5, 0.8
ROWS, BANDS, LEAST = 2, 32, 0.5

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: Public licence notices and short licence texts, by SPDX identifier.
TEMPLATES: Sequence[tuple[str, str]] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD}: 1. {_BSD_TWO.replace('. R', '. 2. R')}"),
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-3-Clause", f"{_BSD}: 1. {_BSD_TWO.replace('. R', '. 2. R')} 3. {_BSD_THIRD}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
MAX_TEMPLATE_BYTES = 16 << 20

_LANES = np.random.default_rng(31).integers(1, 2**63, (2, ROWS * BANDS), dtype=np.uint64) | np.uint64(1)


def minima(h: np.ndarray) -> np.ndarray:
    """MinHash lanes of rows of shingle hashes: (rows, length) to (rows, lanes)."""
    out = np.empty((len(h), ROWS * BANDS), np.uint64)
    for k in range(ROWS * BANDS):
        out[:, k] = ((h ^ _LANES[0, k]) * _LANES[1, k]).min(1)
    return out


def bands(lanes: np.ndarray) -> np.ndarray:
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(lanes), 0)
    for r in range(ROWS):
        out = mix(out * np.uint64(31) + lanes[:, r::ROWS])
    return out


@dataclass
class Templates:
    """shingles: of each template, distinct; sizes: with repeats; keys: bands of those of one size."""

    names: list[str]
    width: np.ndarray
    shingles: list[np.ndarray]
    sizes: np.ndarray
    keys: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, templates: Sequence[tuple[str, str]]) -> Templates:
        w, h = normal_words(pa.array([t for _, t in templates], pa.large_string()))
        names, width, shingles, sizes = [], [], [], []
        raw: list[np.ndarray] = []
        for i, (name, _) in enumerate(templates):
            own = h[w.first[i] : w.first[i + 1]]
            if not len(own):
                continue
            q = min(SHINGLE, len(own))
            s = window_hashes(own, q)
            names.append(name), width.append(q), shingles.append(np.unique(s)), sizes.append(len(s)), raw.append(s)
        keys = {}
        for m in sorted(set(sizes)):
            own = [i for i, s in enumerate(sizes) if s == m]
            k = bands(minima(np.stack([raw[i] for i in own])))
            flat, who = k.ravel(), np.repeat(own, BANDS)
            order = np.argsort(flat, kind="stable")
            keys[m] = flat[order], who[order]
        return cls(names, np.array(width), shingles, np.array(sizes), keys)

    def find(self, w: Words, h: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first word) of all notices, the best of each text and template."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        doc = w.doc
        for q in sorted(set(self.width.tolist())):
            win = window_hashes(h, q)
            if not len(win):
                continue
            ok = inside_doc(w, q)
            mine = [i for i in range(len(self.names)) if self.width[i] == q]
            every = np.unique(np.concatenate([self.shingles[i] for i in mine]))
            known = np.zeros(1 << 16, bool)
            known[(every >> np.uint64(48)).astype(np.int64)] = True
            hits = np.flatnonzero(known[(win >> np.uint64(48)).astype(np.int64)] & ok)
            hits = hits[every[np.minimum(np.searchsorted(every, win[hits]), len(every) - 1)] == win[hits]]
            if not len(hits):
                continue
            for m in sorted({int(self.sizes[i]) for i in mine}):
                step = max(1, m // 4)
                # windows on a grid of `step` from each text's begin that hold a hit
                near = (hits[:, None] - (hits - w.first[doc[hits]])[:, None] % step) - np.arange(-(-m // step) + 1) * step
                start = np.unique(np.maximum(near, w.first[doc[hits]][:, None]))
                # the part of a window beyond its text does not count: the last whole shingle stands there again
                last = w.first[doc[start] + 1] - q
                start, last = start[start <= last], last[start <= last]
                at = np.minimum(start[:, None] + np.arange(m), last[:, None])
                key = bands(minima(win[at]))
                flat, who = self.keys[m]
                lo, hi = np.searchsorted(flat, key), np.searchsorted(flat, key, "right")
                retrieved = {(int(r), i) for r, b in zip(*np.nonzero(hi > lo), strict=True) for i in who[lo[r, b] : hi[r, b]].tolist() if self.width[i] == q}
                for r, i in sorted(retrieved):
                    self._confirm(best, w, win, int(doc[start[r]]), i, int(start[r]), m, q)
        # of notices that overlap, the one held most: versions of a licence share most of their words, and some
        # licences begin with another's words
        out: list[tuple[int, int, float, int]] = []
        for (t, i), (c, at) in sorted(best.items(), key=lambda x: (x[0][0], -x[1][0] * int(self.sizes[x[0][1]]), -x[1][0], x[0][1])):
            end = at + int(self.sizes[i] + self.width[i]) - 1
            if not any(at < b + int(self.sizes[j] + self.width[j]) - 1 and b < end and self.names[i] != self.names[j] for _, j, _, b in takewhile(lambda x: x[0] == t, reversed(out))):
                out.append((t, i, c, at))
        return sorted(out)

    def _confirm(self, best: dict, w: Words, win: np.ndarray, t: int, i: int, start: int, m: int, q: int) -> None:
        lo, hi = max(int(w.first[t]), start - m), min(int(w.first[t + 1]) - q + 1, start + 2 * m)
        own = self.shingles[i]
        k = np.minimum(np.searchsorted(own, win[lo:hi]), len(own) - 1)
        held = np.flatnonzero(own[k] == win[lo:hi])
        if not len(held):
            return
        # how many distinct shingles of the template the stretch of m from each place on has: a held one counts for the
        # places from behind its last occurrence before (or m - 1 back) up to itself
        code = k[held]
        order = np.argsort(code, kind="stable")
        before = np.full(len(held), -1)
        same = code[order[1:]] == code[order[:-1]]
        before[order[1:][same]] = held[order[:-1][same]]
        edge = np.bincount(np.maximum(before + 1, np.maximum(held - m + 1, 0)), minlength=hi - lo + 1)
        counts = np.cumsum(edge - np.bincount(held + 1, minlength=hi - lo + 1))[held]
        top = int(np.argmax(counts))
        share, where = float(counts[top] / len(own)), lo + int(held[top])
        if share >= CONTAINED:
            found = (share, where - int(w.first[t]))
            old = best.get((t, i), (0.0, 0))
            if (found[0], -found[1]) > (old[0], -old[1]):
                best[t, i] = found


def find_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES) -> DataFrame:
    """One row per text and template held: id, licence, template (its number), containment, first_word."""
    if isinstance(templates, DataFrame):
        size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > MAX_TEMPLATE_BYTES:
            raise ValueError(f"templates of {size} bytes; {MAX_TEMPLATE_BYTES} are taken")
        templates = [(r["name"], r["text"] or "") for r in templates.select("name", "text").orderBy("name", "text").collect()]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates.of(templates)
        for batch, _, _ in batches(it, "_text"):
            w, h = normal_words(batch.column(1))
            found = known.find(w, h)
            if found:
                t, i, c, at = zip(*found, strict=True)
                cols = [pa.array([known.names[k] for k in i]), pa.array(i, pa.int32()), pa.array(c, pa.float64()), pa.array(at, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), *cols], ["_id", "licence", "template", "containment", "first_word"])

    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return plain.mapInArrow(run, f"_id {kind}, licence string, template int, containment double, first_word bigint").withColumnRenamed("_id", id_col)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licences(read_table(spark, sf_dir, "documents"))
