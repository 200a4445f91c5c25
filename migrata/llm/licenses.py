"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment decides.

Words are the runs of digits, a-z and non-ASCII characters with A-Z lower-cased; shingles are ``SHINGLE``
words (a template of fewer words is one shingle of its own length).  A template of n shingles belongs to
class c, 2^(c-1) < n <= 2^c.  The windows of class c hold 2 * 2^c shingles and start every 2^c, so any run
of n shingles lies whole in one of them, and a window that holds ``CONTAINMENT`` of the template has a
known least Jaccard similarity to it.  From that follows the number of bands (one MinHash row each) at
which such a window and the template collide with probability ``RECALL``.  A collision is only a
candidate: the template is reported if at least ``CONTAINMENT`` of its distinct shingles, compared word
by word, are in the window.

A band can collide only where the window holds a shingle of a template of its class, so signatures are
computed for those windows alone; the rest of a text costs one hash and one table look-up per word.

Occurrences: in a window that holds enough of a template, the span with the most distinct shingles of the
template for its length is an occurrence; what lies left and right of it is searched again.  Related
licenses share most of their wording, and a one-line notice is part of a longer one: of occurrences that
overlap, the one with most shingles in the template's order less those missing and foreign ones stays
(containment alone would let a short line win over a long notice with one changed word, and two notices in
a row over either).  All others are returned, repeated ones too.

A template is named by its license, or by license, colon and part; ``report`` counts licenses.

Scale: a map over whole texts without a shuffle.  The templates (``MAX_TEMPLATE_WORDS`` words at most,
checked) travel to the tasks; texts are worked on one at a time.

Defined results: null and empty texts have no words and no matches; wordless templates never match;
templates with equal texts are all reported; repeated rows are reported each; only the ``keep`` columns
are returned; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from migrata.llm.common import col, map_texts
from migrata.llm.decontaminate import words_of

SHINGLE = 5
CONTAINMENT = 0.8
RECALL = 0.999
MAX_TEMPLATE_WORDS = 200_000
WORD_CACHE = 200_000

# Public license notices, as their authors ask for them to be written.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
           "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
           "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
           "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
           "distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                  "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
                  "the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                        "option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                 "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
                 "purpose, commercial or non-commercial, and by any means.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                        "option) any later version.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                    "Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                         "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                         "(at your option) any later version.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                         "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                         "(at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                         "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                         "(at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
               "which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
               "this software to the public domain worldwide. This software is distributed without any warranty. You should have "
               "received a copy of the CC0 Public Domain Dedication along with this software.",
    "MIT:body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
                "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
                "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
                "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
                "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC:body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
                "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
                "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
                "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
                "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
                "THIS SOFTWARE.",
    "0BSD:body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                 "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
                 "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
                 "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
                 "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
                 "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause:body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                         "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
                         "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
                         "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                         "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
                         "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
                         "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
                         "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
                         "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
                         "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
                         "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
                         "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause:body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                         "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
                         "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
                         "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                         "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
                         "its contributors may be used to endorse or promote products derived from this software without specific "
                         "prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND "
                         "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
                         "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
                         "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
                         "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
                         "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
                         "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
                         "THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib:body": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
                 "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
                 "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
                 "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
                 "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
                 "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
                 "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
                 "distribution.",
}

MATCHES = T.ArrayType(T.StructType([
    T.StructField("template", T.StringType(), False), T.StructField("start", T.IntegerType(), False),
    T.StructField("end", T.IntegerType(), False), T.StructField("containment", T.DoubleType(), False)]), False)


def bands_for(least: int, window: int, containment: float = CONTAINMENT, recall: float = RECALL) -> int:
    """Bands at which a window of ``window`` shingles that holds ``containment`` of a template of at least
    ``least`` shingles collides with it with probability ``recall``."""
    held = containment * least
    jaccard = held / (window + least - held)
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard))


def shingles_of(words: Sequence[bytes], size: int) -> list[tuple[bytes, ...]]:
    n = min(size, len(words))
    return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)] if n else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    return _mixed(h)


class Match(NamedTuple):
    """An occurrence: words ``start`` to ``end`` (past the last) hold ``found`` of the template's ``size`` distinct
    shingles; ``worth``: shingles found in the template's order less those missing and less foreign ones."""
    template: str
    start: int
    end: int
    found: int
    size: int
    worth: int


def spans(pos: np.ndarray, shingle: np.ndarray, times: Sequence[int], need: int, width: int) -> list[tuple[int, int, int]]:
    """Disjoint spans with ``need`` or more distinct shingles: (first word, past the last word, distinct shingles).

    ``pos`` (ascending) are the places of a template's shingles of ``width`` words, ``shingle`` their numbers,
    ``times`` how often the template holds each.  With shingles counted that often at most, the span with the
    largest 2 * count - length comes first (ties: leftmost, then shortest), then the rest on either side of it."""
    out, todo = [], [(0, len(pos))]
    while todo:
        lo, hi = todo.pop()
        p, s = pos[lo:hi], shingle[lo:hi]
        if len(set(s.tolist())) < need:
            continue
        # index where the same shingle was last, and as often ago as the template holds it; -1 if nowhere
        seen: dict[int, list[int]] = {}
        last, spent = np.full(len(s), -1, np.int64), np.full(len(s), -1, np.int64)
        for i, x in enumerate(s.tolist()):
            own = seen.setdefault(x, [])
            if own:
                last[i] = own[-1]
            if len(own) >= times[x]:
                spent[i] = own[-times[x]]
            own.append(i)
        best = None
        for i in range(len(p)):
            distinct = np.cumsum(last[i:] < i)
            if distinct[-1] < need:
                break
            first = int(np.searchsorted(distinct, need))
            counted = np.cumsum(spent[i:] < i)
            worth = 2 * counted[first:] - (p[i + first:] - p[i])
            j = int(worth.argmax())
            if best is None or worth[j] > best[0]:
                best = (worth[j], i, i + first + j, int(distinct[first + j]))
        _, i, j, found = best
        out.append((int(p[i]), int(p[j]) + width, found))
        todo.append((lo, lo + int(np.searchsorted(p, p[i] - width, "right"))))
        todo.append((lo + int(np.searchsorted(p, p[j] + width, "left")), hi))
    return out


def in_order(numbers: Sequence[int], places: Sequence[Sequence[int]]) -> int:
    """Length of the longest common subsequence of a span's shingles and the template's (``places`` of each, ascending)."""
    ends: list[int] = []  # least place at which a common subsequence of each length can end
    for x in numbers:
        for place in reversed(places[x]):
            i = bisect_left(ends, place)
            ends[i:i + 1] = [place]
    return len(ends)


def settled(found: Iterable[Match]) -> list[Match]:
    """Of matches that overlap, the one worth most (ties: higher containment, leftmost, name);
    matches of equal templates at one place all stay."""
    starts: list[int] = []
    taken: list[Match] = []
    kept = []
    for m in sorted(set(found), key=lambda m: (-m.worth, -m.found / m.size, m.start, m.end, m.template)):
        at = bisect_right(starts, m.start)
        clash = [t for t in taken[max(at - 1, 0):at + 1] if t.start < m.end and m.start < t.end]
        if not clash:
            starts.insert(at, m.start)
            taken.insert(at, m)
        if all(t[1:] == m[1:] for t in clash):
            kept.append(m)
    return sorted(kept, key=lambda m: (m.start, m.end, m.template))


class Scanner:
    """Templates in classes, their signatures, and the look-up tables of their shingles."""

    def __init__(self, templates: Mapping[str, str], size: int = SHINGLE, containment: float = CONTAINMENT, recall: float = RECALL) -> None:
        self.size, self.containment = size, containment
        self.word_hash: dict[bytes, int] = {}
        # (words per shingle, class) -> [(name, shingle -> number, places of each)]; templates shorter than a shingle have sizes of their own
        self.groups: dict[tuple[int, int], list[tuple[str, dict[tuple[bytes, ...], int], list[list[int]]]]] = {}
        total = 0
        for name, text in sorted(templates.items()):
            words = words_of(text)
            total += len(words)
            if words:
                every = shingles_of(words, size)
                own = {s: i for i, s in enumerate(dict.fromkeys(every))}
                places: list[list[int]] = [[] for _ in own]
                for at, s in enumerate(every):
                    places[own[s]].append(at)
                k = len(every)
                self.groups.setdefault((min(size, len(words)), (k - 1).bit_length()), []).append((name, own, places))
        if total > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates hold {total} words; at most {MAX_TEMPLATE_WORDS} travel to the tasks")
        self.known: dict[tuple[int, int], np.ndarray] = {}
        self.signatures: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for (n, c), members in self.groups.items():
            self.known[n, c] = np.unique(np.concatenate([shingle_hashes(self._hashes(s), n) for _, own, _ in members for s in own]))
            least = (1 << c) // 2 + 1
            bands = bands_for(min(least, min(len(own) for _, own, _ in members)), 2 << c, containment, recall)
            seeds = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            table = np.stack([self._signature(np.concatenate([shingle_hashes(self._hashes(list(s)), n) for s in own]), seeds) for _, own, _ in members])
            self.signatures[n, c] = (seeds, table)

    def _hashes(self, words: Sequence[bytes]) -> np.ndarray:
        cache = self.word_hash
        if len(cache) > WORD_CACHE:
            cache.clear()
        out = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    @staticmethod
    def _signature(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return _mixed(h[:, None] ^ seeds[None]).min(0)

    def candidates(self, words: Sequence[bytes]) -> set[Match]:
        """Every occurrence of every template in the windows that its bands retrieve; they may overlap."""
        out: set[Match] = set()
        hashed = self._hashes(words)
        hashes = {n: shingle_hashes(hashed, n) for n, _ in self.groups}
        for (n, c), members in self.groups.items():
            h, known = hashes[n], self.known[n, c]
            if not len(h):
                continue
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            seeds, table = self.signatures[n, c]
            for block in np.unique(np.concatenate([at >> c, np.maximum((at >> c) - 1, 0)])).tolist():
                start = block << c
                stop = min(start + (2 << c), len(h))
                collide = np.flatnonzero((table == self._signature(h[start:stop], seeds)).any(1))
                if not len(collide):
                    continue
                there = [(i, tuple(words[i:i + n])) for i in at[np.searchsorted(at, start):np.searchsorted(at, stop)].tolist()]
                for k in collide.tolist():
                    name, own, places = members[k]
                    held = [(i, own[s]) for i, s in there if s in own]
                    need = next(x for x in range(len(own) + 1) if x / len(own) >= self.containment)
                    if len({x for _, x in held}) < need:
                        continue
                    pos, number = np.array(held, dtype=np.int64).T
                    times = [len(x) for x in places]
                    for a, b, found in spans(pos, number, times, need, n):
                        inside = number[np.searchsorted(pos, a):np.searchsorted(pos, b - n, "right")]
                        same = in_order(inside.tolist(), places)
                        out.add(Match(name, a, b, found, len(own), 3 * same - sum(times) - (b - a - n + 1)))
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, float]]]:
        """Word count and (template, first word, past the last word, containment) of every occurrence, in text order."""
        words = words_of(text)
        return len(words), [(m.template, m.start, m.end, m.found / m.size) for m in settled(self.candidates(words))]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
         size: int = SHINGLE, containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """The ``keep`` columns, ``n_words`` and ``matches`` (every occurrence of a template, in text order)."""
    templates = dict(templates)
    Scanner(templates, size, containment, recall)  # checks the size before anything is shipped

    def make():
        s = Scanner(templates, size, containment, recall)

        def work(texts):
            got = [s.scan(t) for t in texts]
            return ([n for n, _ in got],
                    [[{"template": a, "start": b, "end": c, "containment": d} for a, b, c, d in m] for _, m in got])
        return work

    return map_texts(docs, [col(k) for k in keep], [col(text_col)],
                     [T.StructField("n_words", T.LongType()), T.StructField("matches", MATCHES)], make)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: word count, the licenses found (sorted, comma-joined), occurrences, the best containment."""
    found = F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.substring_index(m["template"], ":", 1))))
    return scan(docs, text_col=text_col, keep=(id_col,)).select(
        col(id_col), "n_words", F.size(found).cast("long").alias("n_licenses"),
        F.array_join(found, ",").alias("licenses"), F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"))
