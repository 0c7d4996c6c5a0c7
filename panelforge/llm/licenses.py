"""License scans: winnowed fingerprints of templates, an inverted index, banded alignment.

Templates are cut into words; of the hashes of their word runs, winnowing keeps the least of
every few neighbours. The kept ones form an inverted index of (template, place). All word
runs of a document are looked up in it; hits of one template that follow each other make a chain of diagonals, and an alignment
of the template with the words there, in a band around the chain, tells how much of it is matched, and where.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, offsets, prepare, spread, texts_of
from .repeats import _mix, word_hashes

#: Public license notices, by their SPDX names where there are any.
TEMPLATES = {
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-1.1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_WORD = np.zeros(256, np.int8)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


@dataclass(frozen=True)
class Settings:
    """run: words of a fingerprint; window: neighbours of which winnowing keeps the least; band: how far an
    alignment may leave its diagonals; gap: words that may be put into a notice, or left out of it, between two of its
    fingerprints; coverage: least share of a template's words to be matched; short: templates of at most so many words
    need all their words with digits."""

    run: int = 3
    window: int = 2
    band: int = 4
    gap: int = 64
    coverage: float = 0.8
    short: int = 24


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each word: runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    return starts, lengths, word_hashes(data.lower(), starts, lengths)


def _runs(h: np.ndarray, run: int) -> np.ndarray:
    n = max(0, len(h) - run + 1)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : n + k]
    return _mix(out)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window (the rightmost of equals); of all, if there are fewer."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    width = min(window, len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.unique(np.arange(len(view)) + width - 1 - view.argmin(axis=1))


class Index:
    """The inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: dict[str, str], settings: Settings):
        self.names = list(templates)
        self.settings = settings
        self.words = [words(t.encode())[2] for t in templates.values()]
        rows = []
        for k, h in enumerate(self.words):
            if len(h) < settings.run:
                raise ValueError(f"template {self.names[k]} has fewer than {settings.run} words")
            runs = _runs(h, settings.run)
            rows += [(int(runs[p]), k, int(p)) for p in winnow(runs, settings.window)]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = (np.array([r[c] for r in rows], np.int64) for c in (1, 2))
        digits = [np.array([any(48 <= c < 58 for c in w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode())], bool) for t in templates.values()]
        self.needed = [np.unique(h[d], return_counts=True) if len(h) <= settings.short else None for h, d in zip(self.words, digits, strict=True)]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def tells(self, template: int, h: np.ndarray) -> bool:
        """Whether a stretch of words has all that tells a short template, a version say."""
        needed = self.needed[template]
        return needed is None or all(int((h == w).sum()) >= n for w, n in zip(*needed, strict=True))

    def hits(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the runs, template, place in the template) of every fingerprint found."""
        at = np.flatnonzero(self.maybe[(runs >> np.uint64(48)).astype(np.int64)])
        low, high = np.searchsorted(self.keys, runs[at]), np.searchsorted(self.keys, runs[at], "right")
        n = high - low
        row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), self.template[row], self.place[row]


def align(template: np.ndarray, text: np.ndarray, low: int, high: int, start: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1) of the longest common subsequence within the band.

    Word i of the template may pair with the words of the text from i + low to i + high. Of
    equally good alignments the one with the shortest span is taken, then the one that starts nearest to ``start``.
    """
    wide = high - low + 1
    # row[d]: matched words and first place of alignments that end at or before diagonal d, the latest first place of the best
    row, best = np.zeros(wide + 1, np.int64), (0, 0, 0, 0)
    padded = np.zeros(len(template) + wide, np.uint64)
    a, z = max(0, low), min(len(text), len(template) + high)
    if z > a:
        padded[a - low : z - low] = text[a:z]
    known = np.zeros(len(padded), bool)
    known[max(0, a - low) : max(0, z - low)] = True
    for i, word in enumerate(template):
        own = row[:-1]
        hit = np.flatnonzero((padded[i : i + wide] == word) & known[i : i + wide])
        fresh = np.maximum(own, row[1:])  # the template's word is left out: the same place of the text is a diagonal further
        if len(hit):
            place = hit + i + low
            before = own[hit]
            first = np.where(before >> 32 == 0, place, before & 0xFFFFFFFF)
            now = ((before >> 32) + 1 << 32) | first
            fresh[hit] = np.maximum(fresh[hit], now)
            m = now >> 32
            k = int(np.lexsort((first, abs(first - start), place - first, -m))[0])
            best = max(best, (int(m[k]), int(first[k] - place[k] - 1), -abs(int(first[k]) - start), -int(first[k])))
        row[:-1] = np.maximum.accumulate(fresh)
    m, span, _, first = best
    return m, -first, -first - span


def chains(place: np.ndarray, at: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """The least and the largest diagonal of each chain of hits of a template, which come by place.

    A hit goes on with the chain whose last hit lies before it in text and template alike and whose diagonal is nearest, at most ``gap`` away.
    """
    open_: list[list[int]] = []  # place, place in the template, least and largest diagonal
    done: list[tuple[int, int]] = []
    for p, t in sorted(zip(place.tolist(), at.tolist(), strict=True)):
        shift = p - t
        going = []
        for c in open_:
            if t + gap < c[1] or p - c[0] > gap + max(0, t - c[1]) + gap:
                done.append((c[2], c[3]))  # too far behind
            else:
                going.append(c)
        open_ = going
        fits = [c for c in open_ if c[0] < p and c[1] < t and abs(shift - (c[0] - c[1])) <= gap]
        if fits:
            c = min(fits, key=lambda c: abs(shift - (c[0] - c[1])))
            c[:] = [p, t, min(c[2], shift), max(c[3], shift)]
        else:
            open_.append([p, t, shift, shift])
    return sorted({*done, *((c[2], c[3]) for c in open_)})


def matches(index: Index, h: np.ndarray, known: dict | None = None) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word + 1) of a text's matches, by template and place.

    Every diagonal that fingerprints hit is aligned, and every chain of such diagonals. Of matches of a template that overlap the best stays,
    of equally good ones the shortest, then the first. Of rivals (templates of about one length that match the same
    words) the best one stays.
    """
    s = index.settings
    place, template, at = index.hits(_runs(h, s.run))
    kept: list[tuple[int, int, int, int]] = []
    for t in np.unique(template).tolist():
        own, found, mine = index.words[t], set(), template == t
        diagonals = {(d, d) for d in np.unique((place - at)[mine]).tolist()}
        for low, high in sorted(diagonals | set(chains(place[mine], at[mine], s.gap))):
            a, b = max(0, low - s.band), min(len(h), high + len(own) + s.band)
            key = (t, h[a:b].tobytes(), low - a, high - low)
            got = known.get(key) if known is not None else None
            if got is None:
                got = align(own, h[a:b], low - a - s.band, high - a + s.band, low - a)
                if known is not None:
                    if len(known) > 20_000:
                        known.clear()
                    known[key] = got
            m, first, last = got
            if m >= s.coverage * len(own) and index.tells(t, h[first + a : last + a]):
                found.add((-m, last - first, first + a, last + a))
        taken: list[tuple[int, int, int]] = []  # by place, without overlaps
        for m, _, first, last in sorted(found):
            k = bisect.bisect(taken, (first, last, -m))
            if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or last <= taken[k][0]):
                taken.insert(k, (first, last, -m))
        kept += [(t, m, first, last) for first, last, m in taken]
    return [r for r in kept if not any(_beats(index, o, r) for o in kept)]


def _beats(index: Index, one: tuple, other: tuple) -> bool:
    """Whether ``other`` is a rival of ``one`` in the same place, and fewer words match or, of as many, less of its template is covered."""
    (t, m, a, z), (u, n, b, y) = one, other
    size, least = len(index.words[t]), len(index.words[u])
    if t == u or 4 * min(size, least) < 3 * max(size, least) or 2 * (min(z, y) - max(a, b)) <= min(z - a, y - b):
        return False
    return (m, m / size) > (n, n / least)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, first_byte, last_byte, matched_words, template_words, coverage): a row for every match.

    Words put into a notice, up to ``gap`` between two of its fingerprints, don't hide it. Very long texts are scanned whole; an empty table
    gives no rows; other columns are pruned. Bytes count from 0 in the whole text's UTF-8, the last one excluded. Null or empty texts have no matches;
    repeated rows repeat theirs; a notice that occurs twice in a text gives two rows.
    """
    prepare(docs.sparkSession)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
    names = ["doc_id", "license", "first_byte", "last_byte", "matched_words", "template_words", "coverage"]

    def run(batches):
        index, known = Index(templates, settings), {}
        for ids, texts in chunks(batches):
            data = b"\n".join(texts)
            starts, lengths, h = words(data)
            begin = offsets(np.fromiter(map(len, texts), np.int64, len(texts)))[:-1] + np.arange(len(texts))
            first = np.append(np.searchsorted(starts, begin), len(starts))
            hit, _, _ = index.hits(_runs(h, settings.run))
            rows = []
            for k in np.unique(np.searchsorted(first, hit, "right") - 1).tolist():
                a, b = int(first[k]), int(first[k + 1])
                for t, m, x, y in matches(index, h[a:b], known):
                    n = len(index.words[t])
                    rows.append((ids[k], index.names[t], int(starts[a + x] - begin[k]), int(starts[a + y - 1] + lengths[a + y - 1] - begin[k]), m, n, m / n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spread(texts_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, license string, first_byte long, last_byte long, matched_words int, template_words int, coverage double")
