"""License scan: winnowed template fingerprints pick candidates, banded alignment confirms them.

Templates are license statements, notices and whole license texts, as words (letters and digits, A-Z in
lower case).  The word hashes of a template's runs of words are put in an inverted index from hash to
template and place; the index is broadcast, its size is that of the templates.  Templates of up to SHORT
words are indexed by all their runs of two or three words: where MIN_COVERAGE of a template's words stand
in order and no words came between, such a run is left, so none is missed.  Longer ones have their
K-word hashes winnowed (the least of each WINDOW neighbours stays): a hit lies in every K + WINDOW - 1
words in a row that were not changed, and one that has none is not found.  Every run of words of a whole
document is looked up.  Hits of a template are chained, each near the diagonal of the one before it, and
the document's words around them are aligned with the template's in a band that runs from hit to hit, so
words put in or left out may shift the diagonal on the way as far as they add up to: matching words
count, other words cost.  A match is reported with its coverage (matched words over template words), and
its span in the document, when the coverage is at least MIN_COVERAGE.

Defined cases: a null or empty text has no matches; a template found several times in a document gives
a row for each place; where matches of several templates overlap, the one with more matched words
stays (equal ones by coverage, then name); repeated rows give repeated matches; further columns are
kept, those with the name of a result column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelry.llm.textbuf import SpanHasher, buffers, code_points, mix, slices

K, WINDOW, BAND, MIN_COVERAGE = 3, 2, 6, 0.75
#: Between two hits, and beyond the outer ones, one word of DRIFT may be put in or left out: the band is as much wider.
DRIFT = 3
#: Words up to which all runs of a template are indexed; words from which on a run of K words must be left by MIN_COVERAGE.
SHORT, LONG_RUNS = 40, 12

# License statements, notices and whole texts, by identifier.
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_END = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License",
    "MIT-short": "Licensed under the MIT License",
    "MIT-text": _MIT,
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-statement": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": _BSD_HEAD + _BSD_END,
    "BSD-3-Clause": _BSD_HEAD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "MIT-whole": _MIT + _MIT_END,
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "ISC-whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense-whole": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved",
}

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def license_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and text number of the words of a buffer."""
    n = len(buf)
    inside = _WORD_BYTE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lower = buf + ((buf >= 0x41) & (buf <= 0x5A)).astype(np.uint8) * np.uint8(32)
    return SpanHasher(lower)(starts, ends), starts, ends, np.searchsorted(offs, starts, "right") - 1


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    h = np.full(max(len(words) - size + 1, 0), size, np.uint64)
    for k in range(size if len(h) else 0):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return h


def run_size(n: int) -> int:
    """Words of the runs by which a template of n words is indexed."""
    return min(n, K if n == K or n >= LONG_RUNS else 2)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the kept hashes: the least of every `window` neighbours, the rightmost of equals."""
    if len(h) <= window:
        return np.arange(len(h)) if len(h) < window else np.array([len(h) - 1 - int(h[::-1].argmin())])
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))


class Index:
    """Inverted index of winnowed template fingerprints: sorted hashes with their postings."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words: list[np.ndarray] = []
        rows = []
        for t, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            words = license_words(raw, np.array([0, len(raw)]))[0]
            self.words.append(words)
            h = gram_hashes(words, run_size(len(words)))
            rows += [(int(h[p]), t, int(p)) for p in (range(len(h)) if len(words) <= SHORT else winnow(h))]
        self.sizes = sorted({run_size(len(w)) for w in self.words})
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h and in the postings of all equal pairs."""
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(48)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, h[maybe], "left"), np.searchsorted(self.hashes, h[maybe], "right")
        count = high - low
        at = np.repeat(maybe, count)
        return at, np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def band(anchors: list[tuple[int, int]], n: int) -> tuple[list[int], int]:
    """The middle of the band of words for each of n template words, and its half width.

    anchors: places (template, words) of hits, both rising.  The band runs through them, slanted in between,
    and is as much wider as the words between two of them, or beyond the outer ones, may shift it.
    """
    place, word = (np.array(c) for c in zip(*anchors, strict=True))
    middle = np.interp(np.arange(n), place, word - place).round().astype(int) + np.arange(n)
    gaps = [int(place[0]), *np.maximum(np.diff(place), np.diff(word)).tolist(), n - int(place[-1])]
    return middle.tolist(), BAND + max(gaps) // DRIFT


def align(template: np.ndarray, words: np.ndarray, middle: list[int], reach: int) -> tuple[int, int, int]:
    """Matched words and first and last (exclusive) matched word of the best banded local alignment.

    Template word i is compared with the words from middle[i] - reach to middle[i] + reach.  Score: 2 for a
    match, -1 for a word left out on either side.
    """
    width, given, nothing = 2 * reach + 1, words.tolist(), (0, 0, -1)
    best = (0, 0, 0, 0)
    row, before = [nothing] * width, middle[0] - reach - 1  # score, matches, first word; word of the row's first cell
    for i, t in enumerate(template.tolist()):
        start = middle[i] - reach
        now: list[tuple[int, int, int]] = []
        for d in range(width):
            j = start + d
            above = j - before  # the same word in the row before
            score, matches, first = row[above - 1] if 0 < above <= width else nothing
            if 0 <= j < len(given) and given[j] == t:
                cell = (score + 2, matches + 1, j if first < 0 else first)
                if (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], cell[2], j + 1)
            else:
                cell = (score - 2, matches, first)
            if 0 <= above < width and row[above][0] - 1 > cell[0]:
                cell = (row[above][0] - 1, *row[above][1:])
            if d and now[d - 1][0] - 1 > cell[0]:
                cell = (now[d - 1][0] - 1, *now[d - 1][1:])
            now.append(cell if cell[0] > 0 else nothing)
        row, before = now, start
    return best[1], best[2], best[3]


def chains(place: np.ndarray, hit_at: np.ndarray, n: int) -> list[np.ndarray]:
    """Hits of a template of n words (sorted by place in the words) in chains, each hit beyond the one before and near its diagonal.

    A hit follows the one that makes its chain longest, less a little for each word of drift; longest chains
    are taken first, and each hit is in one.
    """
    diagonal = hit_at - place
    length, before = np.ones(len(place)), np.full(len(place), -1)
    first = np.searchsorted(hit_at, hit_at - (n + BAND)).tolist()
    for k in range(len(place)):
        a = first[k]
        step, gap = np.abs(diagonal[a:k] - diagonal[k]), np.maximum(place[k] - place[a:k], hit_at[k] - hit_at[a:k])
        near = (place[a:k] < place[k]) & (hit_at[a:k] < hit_at[k]) & (step <= BAND + gap // DRIFT)
        if near.any():
            gain = np.where(near, length[a:k] - step / (4 * BAND), 0)
            best = int(gain.argmax())
            if gain[best] > 0:
                length[k], before[k] = 1 + gain[best], a + best
    out, used = [], np.zeros(len(place), bool)
    for k in np.argsort(-length, kind="stable").tolist():
        run = []
        while k >= 0 and not used[k]:
            used[k] = True
            run.append(k)
            k = before[k]
        if run:
            out.append(np.array(run[::-1]))
    return out


def _without_echoes(runs: list[list[int]], template: np.ndarray, hit_at: np.ndarray, place: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Runs by template and place, without those that lie where a longer run puts its template: they come from grams that it repeats."""
    runs = sorted(runs, key=lambda r: (template[r[0]], hit_at[r[0]], -len(r)))
    same = lambda r, q: template[r[0]] == template[q[0]]
    inside = lambda r, q: len(r) < len(q) and hit_at[q[0]] - place[q[0]] <= hit_at[r[0]] and hit_at[r[-1]] < hit_at[q[-1]] - place[q[-1]] + sizes[template[q[0]]]
    out: list[list[int]] = []
    for r in runs:
        while out and same(r, out[-1]) and inside(out[-1], r):
            out.pop()
        if not (out and same(r, out[-1]) and inside(r, out[-1])):
            out.append(r)
    return out


def matches(index: Index, words: np.ndarray, hit_at: np.ndarray, posting: np.ndarray) -> list[tuple[int, int, int, int]]:
    """template, matched words, first and last word of the matches in one document."""
    found = []
    diagonal, template, place = hit_at - index.place[posting], index.template[posting], index.place[posting]
    order = np.lexsort((place, hit_at, template))
    edges = np.flatnonzero(np.diff(template[order], prepend=-1, append=-1))
    runs = [order[a:b][run].tolist() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for run in chains(place[order[a:b]], hit_at[order[a:b]], len(index.words[template[order[a]]]))]
    runs = _without_echoes(runs, template, hit_at, place, [len(w) for w in index.words])
    for r, run in enumerate(runs):
        t, own = int(template[run[0]]), index.words[template[run[0]]]
        low = max(0, int(diagonal[run[0]]) - BAND - int(place[run[0]]) // DRIFT)
        high = min(len(words), int(diagonal[run[-1]]) + len(own) + BAND + (len(own) - int(place[run[-1]])) // DRIFT)
        if r and template[runs[r - 1][0]] == t:
            low = max(low, min(int(hit_at[runs[r - 1][-1]]) + run_size(len(own)), int(hit_at[run[0]])))
        if r + 1 < len(runs) and template[runs[r + 1][0]] == t:
            high = min(high, max(int(hit_at[runs[r + 1][0]]), int(hit_at[run[-1]]) + run_size(len(own))))
        if np.isin(own, words[low:high]).sum() < MIN_COVERAGE * len(own):
            continue
        got, first, last = align(own, words[low:high], *band([(int(place[k]), int(hit_at[k]) - low) for k in run], len(own)))
        if got >= MIN_COVERAGE * len(own):
            found.append((t, got, first + low, last + low))
    found.sort(key=lambda f: (-f[1], -f[1] / len(index.words[f[0]]), index.names[f[0]], f[2]))
    kept: list[tuple[int, int, int, int]] = []  # in the order of their places, which do not overlap
    for f in found:
        at = bisect_left(kept, f[2], key=lambda g: g[2])
        if (at == 0 or kept[at - 1][3] <= f[2]) and (at == len(kept) or f[3] <= kept[at][2]):
            kept.insert(at, f)
    return kept


RESULT = [("license", T.StringType()), ("coverage", T.DoubleType()), ("n_matched", T.LongType()), ("n_template", T.LongType()), ("start_char", T.LongType()), ("end_char", T.LongType())]


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each match: the columns of docs but the text, and license, coverage, n_matched, n_template, start_char, end_char (code points, end exclusive)."""
    names = {n for n, _ in RESULT}
    kept = [c for c in docs.columns if c.lower() not in names and c != text]
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for part in slices(batch, text):
                buf, offs = buffers(part.column(part.schema.get_field_index(text)))
                words, starts, ends, owner = license_words(buf, offs)
                found = []
                for size in index.sizes:
                    at, posting = index.hits(gram_hashes(words, size))
                    found.append(np.stack([at, posting])[:, owner[at] == owner[at + size - 1]])
                at, posting = np.concatenate(found, 1)
                order = np.argsort(at, kind="stable")
                at, posting = at[order], posting[order]
                if not len(at):
                    continue
                points = code_points(buf)
                rows: list[tuple] = []
                who = owner[at]
                for d in np.unique(who).tolist():
                    a, b = np.searchsorted(owner, [d, d + 1])
                    own = slice(*np.searchsorted(who, [d, d + 1]))
                    for t, got, first, last in matches(index, words[a:b], at[own] - a, posting[own]):
                        size = len(index.words[t])
                        rows.append((d, index.names[t], got / size, got, size, int(points[starts[a + first]] - points[offs[d]]), int(points[ends[a + last - 1]] - points[offs[d]])))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    took = [part.column(part.schema.get_field_index(c)).take(pa.array(cols[0])) for c in kept]
                    types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(took + [pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)], names=kept + [n for n, _ in RESULT])

    return docs.select(*kept, docs[text].cast("string").alias(text)).mapInArrow(run, schema)
