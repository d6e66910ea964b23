"""Operator 9: licence texts by winnowed fingerprints and banded alignment.

Templates are cut into words (lower case, letters and digits only), shingled by ``K`` words and
winnowed over ``WINDOW`` shingles; their fingerprints make a small inverted index (fingerprint to template and
place), bounded by the templates, which travels with the tasks. A text's fingerprints are looked up in it; hits of one
template near one diagonal make a candidate, and a banded alignment of the words there gives the
matched words, the template's coverage and the span in the text. Every candidate is aligned; a match is
reported where coverage reaches ``least``. Alignments of one template that overlap keep the best.

Map only: no shuffle. Winnowing guarantees a hit wherever K + WINDOW - 1 words of a template stand
unbroken; templates shorter than that keep all their shingles, and so does the text's lookup.

Defined cases: null and empty texts have no match; texts shorter than K words neither; equal
coverage goes to the template first by name; repeated rows are scanned each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, codes_of, mix64, pieces, span_hashes

K, WINDOW, BAND = 3, 4, 12

#: Notices as they are put into files, and the parts that licences are made of: public texts of their stewards (fixed values). Whole
#: licences come from a table of the caller's, by ``load_templates``.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-warranty": 'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


@functools.cache
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: lower case, and whether it belongs to a word."""
    low, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x30000):
        s = chr(c)
        if s.isalnum():
            word[c] = True
            if len(x := s.lower()) == 1:
                low[c] = ord(x)
    return low, word


def fold(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased codes; start and end of each run of letters and digits."""
    low, word = _folded()
    flag = np.zeros(len(codes) + 2, bool)
    flag[1:-1] = word[codes]
    edge = np.flatnonzero(flag[1:] != flag[:-1])
    return low[codes], edge[::2], edge[1::2]


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        return mix64(h)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the rightmost minimum of each window; all places if there are fewer than a window."""
    if len(h) <= window:
        return np.arange(len(h))
    v = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(v)) + window - 1 - np.argmin(v[:, ::-1], axis=1))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = []
        key, where = [], []
        for t, name in enumerate(self.names):
            codes, _ = codes_of([templates[name]])
            low, a, b = fold(codes)
            w = span_hashes(low, a, b)
            self.words.append(w)
            s = shingles(w)
            for p in winnow(s).tolist() if len(w) >= K + WINDOW - 1 else range(len(s)):
                key.append(int(s[p]))
                where.append((t, p))
        order = np.argsort(np.array(key, np.uint64), kind="stable")
        self.key, self.where = np.array(key, np.uint64)[order], np.array(where, np.int64).reshape(-1, 2)[order]


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence of words within a band around b = a + shift: matched, first and last matched place of b (-1 if none)."""
    best: dict[int, tuple[int, int, int]] = {}  # per diagonal: matched, first, last
    for i in range(len(a)):
        row: dict[int, tuple[int, int, int]] = {}
        left = None
        for d in range(-band, band + 1):
            j = i + shift + d
            up, diag = best.get(d + 1, (0, -1, -1)), best.get(d, (0, -1, -1))
            now = max(up, left or (0, -1, -1), key=lambda x: (x[0], x[1]))
            if 0 <= j < len(b) and a[i] == b[j]:
                hit = (diag[0] + 1, diag[1] if diag[1] >= 0 else j, j)
                now = max(now, hit, key=lambda x: (x[0], x[1]))
            elif diag[0] > now[0]:
                now = diag
            row[d] = left = now
        best = row
    return max(best.values(), key=lambda x: (x[0], x[1]), default=(0, -1, -1))


def scan_words(index: Index, words: np.ndarray, least: float) -> list[tuple[str, int, int, int, float]]:
    """(template, matched words, first word, last word, coverage) in the text's word hashes."""
    s = shingles(words)
    if not len(s) or not len(index.key):
        return []
    at = np.minimum(np.searchsorted(index.key, s), len(index.key) - 1)
    hits = np.flatnonzero(index.key[at] == s)
    seeds: dict[int, list[int]] = {}
    for p in hits.tolist():
        k = int(at[p])
        while k < len(index.key) and index.key[k] == s[p]:
            t, q = index.where[k]
            seeds.setdefault(int(t), []).append(p - int(q))
            k += 1
    found = []
    for t, shifts in seeds.items():
        a, last = index.words[t], None
        for shift in sorted(shifts):
            if last is not None and shift - last <= BAND // 2:
                continue
            last = shift
            lo = max(0, shift - BAND)
            n, first, end = align(a, words[lo : shift + len(a) + BAND], shift - lo)
            if n and n / len(a) >= least:
                found.append((index.names[t], n, lo + first, lo + end, n / len(a)))
    out: list[tuple[str, int, int, int, float]] = []
    for m in sorted(found, key=lambda m: (-m[1], -m[4], m[0], m[2])):
        if all(m[2] > o[3] or m[3] < o[2] for o in out):
            out.append(m)
    return sorted(out, key=lambda m: (m[2], m[0]))


def load_templates(table: DataFrame, *, name_col: str = "name", text_col: str = "text", max_chars: int = 64_000_000) -> dict[str, str]:
    """Templates from a table, for ``scan``. They travel with the tasks, so a table above ``max_chars`` raises; null names and texts are left out."""
    rows = table.select(F.col(name_col).cast("string").alias("n"), F.col(text_col).cast("string").alias("t")).where("n is not null and t is not null")
    if (rows.agg(F.sum(F.length("t"))).first()[0] or 0) > max_chars:
        raise ValueError(f"templates above {max_chars} characters")
    return {r["n"]: r["t"] for r in rows.collect()}


def scan(df: DataFrame, *, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, matched_words, coverage, start_char, end_char; overlapping matches keep the longest."""
    given = templates or TEMPLATES

    def run(batches):
        index = Index(given)
        for b in batches:
            for lo, _, part in pieces(b.column(1)):
                codes, at = codes_of(part)
                low, start, end = fold(codes)
                words = span_hashes(low, start, end)
                # texts are scanned together for hits, then each that has one by itself
                s = shingles(words)
                k = np.minimum(np.searchsorted(index.key, s), max(0, len(index.key) - 1))
                doc = np.searchsorted(at, start, side="right") - 1
                some = np.unique(doc[np.flatnonzero(index.key[k] == s)]) if len(s) and len(index.key) else []
                rows = []
                for d in some:
                    x, y = np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")
                    for name, n, i, j, share in scan_words(index, words[x:y], least):
                        rows.append((b.column(0)[lo + int(d)].as_py(), name, n, share, int(start[x + i] - at[d]), int(end[x + j] - at[d])))
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield batch(doc_id=pa.array(c[0], pa.int64()), license=pa.array(c[1], pa.string()), matched_words=pa.array(c[2], pa.int32()), coverage=pa.array(c[3], pa.float64()), start_char=pa.array(c[4], pa.int32()), end_char=pa.array(c[5], pa.int32()))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, matched_words int, coverage double, start_char int, end_char int")


