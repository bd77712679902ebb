"""Licence notices in texts, by MinHash bands over overlapping windows.

Templates of like length share windows: a little wider than the longest of them, one an eighth of its length after the other, so that every
place of a template lies whole in some window. A window's signature is the least of each of ``hashes`` permutations of its five-word
shingles; each component is a band of its own. A window whose shingles have the Jaccard similarity j with a template meets it in some band
with probability 1 - (1 - j) ** hashes; where ``least`` of a template stand in a window j is 0.4 at the lowest, which gives 0.999995.
Templates that a window meets are verified: the fraction of the template's shingles that lie in the window and its margins, counted exactly.
Texts stand one after another, and a window that ends in the next text is verified in both. Where notices overlap, the one that is held most fully stands, of equals the longer one.

Null, empty and short texts match nothing; any length is handled, whole; each notice of a text is a row; repeated rows are reported each;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import WordHashes, lean, mix64, runs, with_fields
from evidentia.llm.shingles import shingles

SIZE, LEAST, HASHES = 5, 0.8, 24
#: How much longer than the shortest the longest template of a group may be.
ALIKE = 1.25
#: Public licence notices.
TEMPLATES = {
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
    ),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "Apache-2.0-warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "BSD-line": "Licensed under the BSD License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation"
    ),
    "ISC": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-line": "Licensed under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction"
    ),
    "MIT-body": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
}


_LOW = np.uint64(4095)
_MOST = np.uint64(2**64 - 1)


class Group:
    """Templates of like length and the windows they share."""

    def __init__(self, names: list[str], longest: int, signatures: np.ndarray):
        self.names, self.signatures = names, signatures  # template x hash
        self.step = max(1, longest // 8)
        self.blocks = -(-longest // self.step) + 1  # of ``step`` shingles a window
        self.low = np.zeros((signatures.shape[1], int(_LOW) + 1), bool)  # the low bits that a signature has
        for k, row in enumerate(signatures.T):
            self.low[k][(row & _LOW).astype(np.int64)] = True


class Scanner:
    def __init__(self, templates: dict[str, str], size: int = SIZE, least: float = LEAST, hashes: int = HASHES):
        self.size, self.least, self.known = size, least, WordHashes()
        self.seeds = mix64(np.arange(1, hashes + 1, dtype=np.uint64))
        self.odds = mix64(self.seeds) | np.uint64(1)
        self.shingles, self.words = {}, {}
        for name, text in sorted(templates.items()):
            _, got, (words,) = shingles([text], size, self.known)
            if len(words) < size:
                raise ValueError(f"template {name} has fewer than {size} words")
            self.shingles[name], self.words[name] = np.unique(got), len(words)
        self.groups: list[Group] = []
        left = sorted(self.shingles, key=lambda n: (self.words[n], n))
        while left:
            alike = [n for n in left if self.words[n] <= ALIKE * self.words[left[0]]]
            signatures = np.array([[self.permuted(self.shingles[n], k).min() for k in range(hashes)] for n in alike])
            self.groups.append(Group(alike, self.words[alike[-1]] - size + 1, signatures))
            left = left[len(alike) :]

    def permuted(self, shingle: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (shingle ^ self.seeds[k]) * self.odds[k]

    def met(self, got: np.ndarray) -> set[tuple[int, int, int]]:
        """(group, template, first shingle) of each window that meets a template."""
        found: set[tuple[int, int, int]] = set()
        room = max((g.blocks * g.step for g in self.groups), default=0)
        for k in range(len(self.seeds)):
            h = np.concatenate([self.permuted(got, k), np.full(room + 64, _MOST)])
            for step in sorted({g.step for g in self.groups}):
                least, wide = h[: len(h) // step * step : step], 1
                for r in range(1, step):
                    least = np.minimum(least, h[r : len(h) // step * step : step])
                for i, g in enumerate(self.groups):  # by length
                    if g.step != step:
                        continue
                    while 2 * wide <= g.blocks:
                        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
                    rest = g.blocks - wide
                    m = np.minimum(least[:-rest], least[rest:]) if rest else least
                    at = np.flatnonzero(g.low[k][(m & _LOW).astype(np.int64)])
                    for t, w in zip(*np.nonzero(g.signatures[:, k][:, None] == m[at]), strict=True):
                        found.add((i, int(t), int(at[w]) * step))
        return found

    def scan_all(self, texts: list[str | None], every: bool = False) -> list[list[tuple[str, float, int, int]]]:
        """(template, containment, first word, last word + 1) of each text's notices, in order. ``every`` verifies all windows, met or not."""
        _, got, words = shingles(texts, self.size, self.known)
        n = np.array([max(0, len(w) - self.size + 1) for w in words], np.int64)
        got = got[: n.sum()]  # shingles of shorter texts stand behind
        begin = np.r_[0, np.cumsum(n)]
        met = {(i, t, w) for i, g in enumerate(self.groups) for t in range(len(g.names)) for w in range(0, len(got), g.step)} if every else self.met(got)
        found: list[dict] = [{} for _ in texts]
        for i, t, start in met:
            g, name = self.groups[i], self.groups[i].names[t]
            want = self.shingles[name]
            end = min(start + g.blocks * g.step, len(got))
            for d in range(int(np.searchsorted(begin, start, side="right")) - 1, int(np.searchsorted(begin, end, side="left"))):
                low, high = max(int(begin[d]), start - g.step), min(int(begin[d + 1]), end + g.step)
                inside = np.flatnonzero(np.isin(got[low:high], want)) + low
                for a, b in clusters(inside, self.words[name]):
                    share = len(np.intersect1d(got[a:b], want)) / len(want)
                    if share >= self.least:
                        found[d][name, a - int(begin[d]), b - int(begin[d]) + self.size - 1] = share
        return [distinct(f) for f in found]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        return self.scan_all([text])[0]


def clusters(hits: np.ndarray, words: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of places that lie no further than a template's length apart, cut where a run outgrows it."""
    out: list[tuple[int, int]] = []
    for h in hits.tolist():
        if out and h - out[-1][0] < words * 1.2:
            out[-1] = (out[-1][0], h + 1)
        else:
            out.append((h, h + 1))
    return out


def distinct(found: dict) -> list[tuple[str, float, int, int]]:
    """Of matches that overlap, the most fully held one, of equals the longer, then the first."""
    kept: list[tuple[str, float, int, int]] = []
    for (name, a, b), share in sorted(found.items(), key=lambda x: (-x[1], x[0][1] - x[0][2], x[0][1], x[0][0])):
        if all(b <= c or d <= a for _, _, c, d in kept):
            kept.append((name, share, a, b))
    return sorted(kept, key=lambda x: (x[2], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, **how) -> DataFrame:
    """doc_id, license, containment, first_word, last_word of each notice found."""
    texts_of = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        scanner = Scanner(texts_of, **how)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in runs(texts, 500_000):
                found = [(i + k, *r) for k, rows in enumerate(scanner.scan_all(texts[i:j])) for r in rows]
                k, name, share, first, last = zip(*found, strict=True) if found else ([],) * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(k, pa.int64())), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["doc_id", "license", "containment", "first_word", "last_word"])

    schema = with_fields(docs.select("doc_id").schema, "license string, containment double, first_word int, last_word int")
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)
