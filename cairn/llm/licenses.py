"""License scan: winnowed fingerprints find candidates, banded alignment reports coverage and spans.

Every template's word trigrams are winnowed: of each window of neighbouring trigrams the one with the
least hash is kept, in an inverted index trigram -> (template, position). A text's trigrams are all looked
up; hits of one template on neighbouring diagonals are a candidate region, which is aligned
with the template inside a band around those diagonals. Pieces of one template that follow each other in the text and in
the template are chained where their scores outweigh the gap, as one alignment without a band would join them. A match
is reported where the words aligned alike cover enough of the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.common import Memo, small_batches, text_or_empty

#: Words of a text that one entry of the list of matches stands for.
BLOCK = 256
# Texts of public licenses and the notices that name them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "LGPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.',
    "AGPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.',
    "GPL-2.0-header": 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
GRAM = 3
WINDOW = 4
BAND = 8


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    """The inverted index of some templates, and the scan of a text."""

    def __init__(self, templates: dict[str, str], least_coverage: float):
        import xxhash

        self.hashes = Memo(lambda w: xxhash.xxh64_intdigest(w), 200_000)
        self.least = least_coverage
        self.names = list(templates)
        self.words = [words_of(t) for t in templates.values()]
        index: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            grams = self.grams(words)
            kept = set()
            for at in range(max(1, len(grams) - WINDOW + 1)):
                part = grams[at : at + WINDOW]
                if len(part):
                    kept.add(at + int(part.argmin()))
            for p in sorted(kept):
                index.setdefault(int(grams[p]), []).append((t, p))
        self.known = np.array(sorted(index), np.uint64)
        self.places = [index[int(g)] for g in self.known]

    def grams(self, words: list[str]) -> np.ndarray:
        own = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        if len(own) < GRAM:
            return np.zeros(0, np.uint64)
        mixed = np.zeros(len(own) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - GRAM + 1 + k]
        return mixed ^ (mixed >> np.uint64(31))

    def regions(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, least and greatest diagonal) of hits on neighbouring diagonals."""
        if not len(grams) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == grams)
        diagonals = sorted({(t, int(h) - p) for h in hits for t, p in self.places[at[h]]})
        out: list[list[int]] = []
        for t, d in diagonals:
            if out and out[-1][0] == t and d - out[-1][2] <= BAND and d - out[-1][1] <= 4 * BAND:
                out[-1][2] = d
            else:
                out.append([t, d, d])
        return [tuple(x) for x in out]

    def align(self, template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int, int, int, int]:
        """(score, words aligned alike, first, past the last word of the text, the same of the template) of the best local alignment in the band.

        Alike scores 2, unlike and gap cost 1. Column j of row i stands for the text's word i + low - BAND + j.
        """
        width, n = high - low + 2 * BAND + 1, len(words)
        none = (0, 0, None)
        before = [none] * (width + 1)  # score, alike, start in text and template
        best = (0, 0, (-1, -1), -1, -1)
        for i, w in enumerate(template):
            row, left = [], none
            base = i + low - BAND
            for j in range(width):
                at = base + j
                if not 0 <= at < n:
                    cell = none
                else:
                    s, a, b = before[j]
                    cell = (s + 2, a + 1, b or (at, i)) if words[at] == w else (s - 1, a, b)
                    up, side = before[j + 1], left
                    if up[0] - 1 > cell[0]:
                        cell = (up[0] - 1, up[1], up[2])
                    if side[0] - 1 > cell[0]:
                        cell = (side[0] - 1, side[1], side[2])
                    if cell[0] <= 0:
                        cell = none
                    elif cell[0] > best[0]:
                        best = (*cell, at + 1, i + 1)
                row.append(cell)
                left = cell
            row.append(none)
            before = row
        score, alike, (first, t_first), past, t_past = best
        return score, alike, first, past, t_first, t_past

    def chained(self, pieces: list[tuple[int, int, int, int, int, int]], length: int) -> list[tuple[int, int, int]]:
        """(alike, first, past) of the best chains of pieces of a template of so many words; each piece is in one.

        The words between two pieces cost 1 each, or pair up as unlike; what both pieces cover counts once.
        """
        free, out = sorted(set(pieces), key=lambda x: (x[2], x[3])), []
        while free:
            ends: list[tuple[int, int, int, int]] = []  # score, alike, first, the piece before
            for k, (score, alike, first, past, t_first, t_past) in enumerate(free):
                best = (score, alike, first, -1)
                for j in range(k - 1, -1, -1):
                    _, own, f, p, tf, tp = free[j]
                    if first - f > 5 * length:  # no chain outweighs such a gap
                        break
                    over = max(p - first, tp - t_first, 0)
                    if f < first and p < past and tf < t_first and tp < t_past and over < min(own, alike):
                        total = ends[j][0] + score - 2 * over - max(first - p, t_first - tp, 0)
                        if total > max(best[0], ends[j][0]):
                            best = (total, ends[j][1] + alike - over, ends[j][2], j)
                ends.append(best)
            used: set[int] = set()
            for end in sorted(range(len(free)), key=lambda k: (-ends[k][0], k)):
                if end in used:
                    continue
                chain, at = [], end
                while at >= 0:
                    chain.append(at)
                    at = ends[at][3]
                if not used.isdisjoint(chain):
                    break  # what is left of it has to be weighed anew
                if ends[end][1] < self.least * length:
                    return out
                out.append((ends[end][1], ends[end][2], free[end][3]))
                used.update(chain)
            free = [x for k, x in enumerate(free) if k not in used]
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, words, start, end) of the matches, by place; of overlapping ones of a template the best, and none inside one with more words alike (or as many, and more coverage)."""
        lower = text.lower()
        words = WORD.findall(lower)
        found = []
        regions = self.regions(self.grams(words))
        if not regions:
            return []
        if len(lower) != len(text):  # a few letters change length in lower case
            words = [m[0].lower() for m in WORD.finditer(text)]
        places = [m.span() for m in WORD.finditer(text)]
        pieces: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
        for t, low, high in regions:
            start = max(0, low - BAND)  # the band reaches no word before, nor any past its end
            left = words[start : high + BAND + len(self.words[t]) + 1]
            while True:  # a region may hold the template several times
                score, alike, first, past, t_first, t_past = self.align(self.words[t], left, low - start, high - start)
                if alike:
                    pieces.setdefault(t, []).append((score, alike, start + first, start + past, t_first, t_past))
                if alike < max(GRAM, 0.1 * len(self.words[t])):
                    break
                left[first:past] = [""] * (past - first)
        for t, own in pieces.items():
            if sum(x[1] for x in own) >= self.least * len(self.words[t]):
                found.extend((alike / len(self.words[t]), t, alike, first, past) for alike, first, past in self.chained(own, len(self.words[t])))
        out: list[tuple[str, float, int, int, int]] = []
        taken: dict[int, list[tuple[int, int, int]]] = {}  # by block of words
        for coverage, t, alike, first, past in sorted(found, key=lambda x: (-x[2], -x[0], x[1], x[3])):
            blocks = range(first // BLOCK, (past - 1) // BLOCK + 1)
            near = [x for k in blocks for x in taken.get(k, ())]
            inside = any(a <= first and past <= b for a, b, _ in near)
            if not inside and all(past <= a or b <= first for a, b, other in near if other == t):
                for k in blocks:
                    taken.setdefault(k, []).append((first, past, t))
                out.append((self.names[t], coverage, alike, places[first][0], places[past - 1][1]))
        return sorted(out, key=lambda x: (x[3], x[0]))


def scan(df: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = 0.8, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each match: the columns in keep, license, coverage (of the template), n_words, start, end (code points, end exclusive).

    Whole texts are scanned; null and empty ones, and those without a match, give no row. The
    templates are a parameter and go to every task; a template of fewer than three words is never found. Repeated rows
    give repeated matches.
    """
    small_batches(df.sparkSession, 1000)
    own = dict(TEMPLATES if templates is None else templates)
    new = (("license", T.StringType()), ("coverage", T.DoubleType()), ("n_words", T.LongType()), ("start", T.LongType()), ("end", T.LongType()))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own, least_coverage)
        for batch in batches:
            rows, out = [], ([], [], [], [], [])
            for row, x in enumerate(batch.column(len(keep)).to_pylist()):
                for match in scanner.scan(x):
                    rows.append(row)
                    for column, value in zip(out, match, strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            given = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(given + [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=[f.name for f in schema])

    return df.select(*[f"`{c}`" for c in keep], text_or_empty(text).alias("__text")).mapInArrow(run, schema)
