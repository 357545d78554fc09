"""License scan: MinHash bands over overlapping text windows, verified by exact shingle containment.

Templates are license texts and notices as word shingles (five words). Templates of similar length share a
window length and stride, chosen so that every run of a template's length lies within one window whole. The
window's Jaccard similarity with a template that it holds is bounded below by lengths and the containment asked
for; from that bound come bands and rows that make a collision as likely as `1 - MISS`. What the bands
retrieve is verified by exact containment: the share of the template's distinct shingles that the window holds.

Windows without any template's shingle are passed over before hashing: their similarity with every template is 0.
A template longer than the longest class is cut into parts, each a template of its own.

Null or empty text: no match. Texts of fewer than five words can match nothing. Very long texts: as many windows
as they need. Repeated rows are scanned each for itself. Extra columns are ignored. One narrow pass, no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, document_words, mix, slices, window_hashes

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-3
LONGEST = 256

#: Public license notices and texts, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def bands_for(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """The most rows a band, with the bands that miss a pair of this similarity with probability `miss` at most; 128 hashes at most if one row allows it."""
    best = (ceil(log(miss) / log(1 - min(similarity, 1 - 1e-9))), 1)
    for rows in range(2, 6):
        bands = ceil(log(miss) / log(1 - min(similarity, 1 - 1e-9) ** rows))
        if bands * rows <= 128:
            best = (bands, rows)
    return best


class LengthClass:
    """Templates of `low` to `high` words, their window, stride and bands."""

    def __init__(self, names: list[str], words: list[np.ndarray], containment: float):
        self.names = names
        longest = max(map(len, words))
        self.stride = max(1, longest // 2)
        self.window = longest + self.stride - 1
        self.sets = [np.unique(window_hashes(w, SHINGLE)) for w in words]
        self.need = [ceil(containment * len(s) - 1e-9) for s in self.sets]
        held = self.window - SHINGLE + 1
        self.similarity = min(n / (held + len(s) - n) for s, n in zip(self.sets, self.need, strict=True))
        self.bands, self.rows = bands_for(self.similarity)
        self.seeds = mix(np.arange(1, self.bands * self.rows + 1, dtype=np.uint64))
        self.buckets: dict[tuple[int, bytes], list[int]] = defaultdict(list)
        for t, s in enumerate(self.sets):
            for key in self.keys(s):
                self.buckets[key].append(t)

    def keys(self, hashes: np.ndarray) -> list[tuple[int, bytes]]:
        low = mix(hashes[:, None] ^ self.seeds).min(axis=0).reshape(self.bands, self.rows)
        return [(b, row.tobytes()) for b, row in enumerate(low)]

    def match(self, hashes: np.ndarray) -> list[tuple[int, float]]:
        """Templates in a window, with their containment."""
        found = sorted({t for key in self.keys(hashes) for t in self.buckets.get(key, ())})
        out = []
        for t in found:
            share = int(np.isin(self.sets[t], hashes).sum())
            if share >= self.need[t]:
                out.append((t, share / len(self.sets[t])))
        return out


class Templates:
    def __init__(self, templates: dict[str, list[str]] | None = None, containment: float = CONTAINMENT):
        cut: list[tuple[str, np.ndarray]] = []
        for name, texts in (templates or TEMPLATES).items():
            for text in texts:
                words = document_words([text.encode()])[0]
                for a in range(0, max(len(words), 1), LONGEST):
                    part = words[max(0, min(a, len(words) - SHINGLE)) : a + LONGEST]
                    if len(part) >= SHINGLE:
                        cut.append((name, part))
        cut.sort(key=lambda x: len(x[1]))
        self.classes: list[LengthClass] = []
        while cut:
            most = max(len(cut[0][1]) + 1, int(len(cut[0][1]) * 1.4))
            now = [x for x in cut if len(x[1]) <= most]
            cut = cut[len(now) :]
            self.classes.append(LengthClass([x[0] for x in now], [x[1] for x in now], containment))
        self.all = np.unique(np.concatenate([s for c in self.classes for s in c.sets])) if self.classes else np.zeros(0, np.uint64)

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int, float]]]:
        """(license, first word, last word of the window, containment) of each text, once for each license and window."""
        words, bounds = document_words(texts)
        h = window_hashes(words, SHINGLE)
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        if not len(h) or not len(self.all):
            return out
        i = np.minimum(np.searchsorted(self.all, h), len(self.all) - 1)
        hits = np.flatnonzero(self.all[i] == h)
        owner = np.searchsorted(bounds, hits, "right") - 1
        inside = hits + SHINGLE <= bounds[owner + 1]
        hits, owner = hits[inside], owner[inside]
        for d in np.unique(owner):
            a, b = int(bounds[d]), int(bounds[d + 1])
            at = hits[owner == d] - a
            best: dict[tuple[str, int], tuple[str, int, int, float]] = {}
            for c in self.classes:
                # Windows start at multiples of the stride; those that hold a hit.
                firsts = np.unique(np.concatenate([np.maximum(at // c.stride - j, 0) for j in range(-(-c.window // c.stride) + 1)]))
                for w in firsts.tolist():
                    x, y = w * c.stride, min(w * c.stride + c.window, b - a)
                    if y - x < SHINGLE or not np.any((at >= x) & (at + SHINGLE <= y)):
                        continue
                    for t, share in c.match(np.unique(h[a + x : a + y - SHINGLE + 1])):
                        key = (c.names[t], x)
                        if key not in best or best[key][3] < share:
                            best[key] = (c.names[t], x, y - 1, share)
            out[d] = sorted(best.values(), key=lambda m: (m[1], m[0]))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id") -> DataFrame:
    """Per document: its licenses, the windows that hold them, the best containment."""
    held = docs.sparkSession.sparkContext.broadcast(Templates(templates, containment))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))
        for b in slices(batches, "__text"):
            found = held.value.scan(binaries(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array([[dict(zip(("license", "first_word", "last_word", "containment"), m, strict=True)) for m in x] for x in found], kind)], names=[id_col, "matches"])

    out = docs.select(F.col(id_col).cast("long"), F.col("text").alias("__text")).mapInArrow(run, f"{id_col} long, matches array<struct<license:string,first_word:bigint,last_word:bigint,containment:double>>")
    return out.withColumn("licenses", F.array_sort(F.array_distinct(F.col("matches.license")))).withColumn("containment", F.array_max("matches.containment"))
