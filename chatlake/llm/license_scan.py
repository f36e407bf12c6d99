"""License scans: all template runs of two words pick candidates, banded alignment measures them.

The templates' runs of ``GRAM`` words give an inverted index run -> (template, position). It is a
table of the templates alone, so its size never depends on the documents. Texts look up all of their
runs; only words of the templates' vocabulary can take part, so most of a text is passed over. Hits
of one template on near diagonals are aligned, word by word, within a band around those diagonals
(local alignment: a match 1, a mismatch or gap -1). An alignment counts if its matched words cover
``COVERAGE`` of the template; its hits are then set aside and the rest is tried again, so repeated
notices are all reported.

No alignment is lost. Its score is positive from its first word on, so it begins with two matches in
a row, which are a hit; it has fewer words and gaps without a match than matches, so it ends within
twice the template's length, where the text must hold enough of the template's words, and strays from
its first diagonal by less than that length. Hits that can't begin one are passed over.

An alignment names its licence only if nothing tells it from the template: the template's telling words
(``TELLING``; of other short templates, all but the ``USUAL`` ones) must stand in it in their order;
words that make another licence of it (``TURNING``), unless they are the template's, must not stand in
it, nor a denial in it or just before it. Of alignments over much the same words, the one that covers
most of its template, then the longest, is reported.

Texts are scanned whole inside Arrow batches and never shuffled. Defined cases: null and empty texts
match nothing; letters compare without case, punctuation separates words; equal rows give equal
results; a template within another's text is reported beside it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chatlake.llm.common import read, texts

GRAM, COVERAGE = 2, 0.8

#: The public wording of common licences and notices; opening sentences stand beside full texts,
#: as texts often quote no more.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.""",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along
        with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
        altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws,
        the author or authors of this software dedicate any and all copyright interest in the software to the public
        domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
        future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer.""",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version. This library is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU Lesser General Public License for more details.""",
    "lgpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU Lesser General Public License for more details.""",
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU Affero General Public License for more details.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names
        of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
#: What must stand in an alignment of longer templates, in this order.
TELLING = {
    "gpl": "gnu general public 3", "gpl-3.0-header": "gnu general public 3", "gpl-2.0-header": "gnu general public 2", "lgpl-2.1-header": "gnu lesser general public 2 1", "lgpl-3.0-header": "gnu lesser general public 3",
    "agpl-3.0-header": "gnu affero general public 3", "apache-2.0": "apache 2 0", "apache-2.0-header": "apache 2 0", "mpl-2.0-header": "mozilla public 2 0",
}
#: Words of short templates that tell nothing: many licences' notices hold them, and texts vary them.
USUAL = frozenset("a an and are be by-line commons creative free in into is international it licence license licensed of or release released software terms that the this to under unencumbered version work".split())
#: Words of a template that counts as short, and what turns one licence into another or denies it.
SHORT = 16
TURNING = frozenset("affero lesser library nc nd noncommercial noderivatives noderivs sa sharealike".split())
DENIALS = frozenset("cannot neither never nor not".split())
#: Part of both spans that two alignments share if they are over much the same words.
SAME = 0.8
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words between white space and ASCII punctuation."""
    return text.lower().translate(_PLAIN).split()


class LicenseIndex:
    def __init__(self, templates: dict[str, str], telling: dict[str, str] | None = None):
        self.names = list(templates)
        self.texts = [words(t.encode()) for t in templates.values()]
        given = {n: words(t.encode()) for n, t in (TELLING if telling is None else telling).items()}
        #: By template: the words that must stand in an alignment, and those that must not.
        self.telling = [given[n] if n in given else [w for w in t if w.decode("utf-8", "replace") not in USUAL] if len(t) <= SHORT else [] for n, t in zip(self.names, self.texts, strict=True)]
        self.turning = [frozenset(w.encode() for w in TURNING | (DENIALS if len(t) <= SHORT else frozenset())) - set(t) for t in self.texts]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.coded = [np.array([self.ids[w] for w in t], np.int64) for t in self.texts]
        #: By length of run: code -> (template, position).
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = {g: defaultdict(list) for g in (1, GRAM)}
        for gram, postings in self.postings.items():
            for n, coded in enumerate(self.coded):
                for at, code in enumerate(self.codes(coded, gram).tolist()):
                    postings[code].append((n, at))
        self.runs = {g: np.array(sorted(p), np.int64) for g, p in self.postings.items()}
        #: Per template: which word ids are its own.
        self.members = [np.isin(np.arange(len(self.ids) + 1), coded) for coded in self.coded]

    def codes(self, ids: np.ndarray, gram: int = GRAM) -> np.ndarray:
        """One number for each run of words; runs with a foreign word (0) get -1."""
        n = max(0, len(ids) - gram + 1)
        out, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(gram):
            out = out * (len(self.ids) + 1) + ids[i : i + n]
            whole &= ids[i : i + n] > 0
        return np.where(whole, out, -1)

    def hits(self, ids: np.ndarray, coverage: float = COVERAGE) -> dict[int, list[tuple[int, int]]]:
        """Template -> (position in the text, position in the template) of runs that may be of a place."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        # a single word is enough for the shortest templates only
        single = {n for n, coded in enumerate(self.coded) if coverage * len(coded) <= 1}
        for gram in (1, GRAM) if single else (GRAM,):
            codes = self.codes(ids, gram)
            for at in np.flatnonzero(np.isin(codes, self.runs[gram])).tolist():
                for n, there in self.postings[gram][int(codes[at])]:
                    if (n in single) == (gram == 1):
                        found[n].append((at, there))
        out = {}
        for n, own in found.items():
            reach = 2 * len(self.coded[n])
            sums = np.concatenate([[0], np.cumsum(self.members[n][ids])])
            at = np.array([h[0] for h in own], np.int64)
            starts = at[sums[np.minimum(at + reach, len(ids))] - sums[at] >= coverage * len(self.coded[n])]
            if len(starts):
                # what lies within reach of the last start before it can be of the same place
                last = np.searchsorted(starts, at, side="right") - 1
                near = (last >= 0) & (at - starts[last] < reach)
                out[n] = [h for h, keep in zip(own, near.tolist(), strict=True) if keep]
        return out

    def names_it(self, n: int, text: list[bytes], start: int, end: int) -> bool:
        """Whether the words of an alignment name its template's licence, and no other."""
        left = iter(text[start:end])
        if not all(w in left for w in self.telling[n]) or self.turning[n].intersection(text[start:end]):
            return False
        before = text[max(0, start - 3) : start]
        return not any(w.decode("utf-8", "replace") in DENIALS or (w == b"t" and i and before[i - 1].endswith(b"n")) for i, w in enumerate(before))

    def scan(self, text: bytes, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first word, word after the last) of the licences named, by place."""
        raw = words(text)
        number = {name: n for n, name in enumerate(self.names)}
        named = [r for r in self.places(raw, coverage) if self.names_it(number[r[0]], raw, r[3], r[4])]
        out: list[tuple[str, float, int, int, int]] = []
        # what overlaps much of a better one goes; places are few, and those near each other fewer
        better = sorted(named, key=lambda r: (-r[1], -r[2], r[3], r[0]))
        kept: dict[int, list[tuple]] = defaultdict(list)
        for r in better:
            size = r[4] - r[3]
            # a span that shares most of this one's words begins within its length
            rivals = (q for block in range((r[3] - size) // 64, r[4] // 64 + 1) for q in kept[block])
            if not any(q[0] != r[0] and min(r[4], q[4]) - max(r[3], q[3]) >= SAME * max(size, q[4] - q[3]) for q in rivals):
                kept[r[3] // 64].append(r)
                out.append(r)
        return sorted(out, key=lambda r: (r[3], r[4], r[0]))

    def places(self, raw: list[bytes], coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first word, word after the last) of all alignments, by place.

        A place spans less than ``reach`` words, so windows of twice that, a reach apart, hold each one
        whole. Work grows with the text's length times the template's, however often a notice repeats.
        """
        get = self.ids.get
        ids = np.array([get(w, 0) for w in raw], np.int64)
        out = []
        for n, own in self.hits(ids, coverage).items():
            template, left, least = self.coded[n], ids.copy(), coverage * len(self.coded[n])
            reach, slack = 2 * len(template) + 1, max(4, len(template))
            at = np.array(own, np.int64)
            at = at[np.argsort(at[:, 0], kind="stable")]
            first = 0
            while first < len(at):
                begin = int(at[first, 0])
                last, following = np.searchsorted(at[:, 0], [begin + 2 * reach, begin + reach])
                # what lies before the window can be part of no place that begins in it
                window = left[begin : begin + 2 * reach].copy()
                diagonals = at[first:last, 0] - begin - at[first:last, 1]
                low, high = int(diagonals.min()) - slack, int(diagonals.max()) + slack
                while True:
                    matched, start, end = align(template, window, low, high)
                    if matched < least or end <= start:
                        break
                    if start < reach:
                        out.append((self.names[n], matched / len(template), matched, begin + start, begin + end))
                        left[begin + start : begin + end] = 0
                    # what an alignment used is blanked, so that the next one finds another place
                    window[start:end] = 0
                first = int(following)
        return sorted(out, key=lambda r: (r[3], r[4], r[0]))


#: An alignment's score, matched words and first word in one number, compared in this order.
_SCORE, _MATCH, _START = 1 << 42, 1 << 21, (1 << 21) - 1


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """The best local alignment with text position - template position in low..high.

    Returns the matched words and the text's span; of equal scores the one with more matches, then
    the first to begin. A template word is a row of the band; skipping words of the text along a row
    is a running maximum.
    """
    size, width = len(text), high - low + 1
    before, ramp = np.zeros(width + 1, np.int64), np.arange(width, dtype=np.int64) * _SCORE
    begins = _SCORE + _MATCH + _START - np.arange(size, dtype=np.int64)
    best = end = 0
    for j, word in enumerate(template.tolist()):
        a, b = max(0, -low - j), min(width, size - low - j)
        now = np.zeros(width + 1, np.int64)
        if a < b:
            here, i = before[a:b], low + a + j
            value = np.where(text[i : i + b - a] == word, np.where(here > 0, here + (_SCORE + _MATCH), begins[i : i + b - a]), here - _SCORE)
            np.maximum(value, before[a + 1 : b + 1] - _SCORE, out=value)
            value[value < _SCORE] = 0
            value = np.maximum.accumulate(value + ramp[: b - a]) - ramp[: b - a]
            value[value < _SCORE] = 0
            top = int(value.argmax())
            if value[top] > best:
                best, end = int(value[top]), i + top + 1
            now[a:b] = value
        before = now
    return best // _MATCH % _MATCH, _START - best % _MATCH if best else 0, end


_INDEXES: dict[tuple, LicenseIndex] = {}

SCHEMA = "doc_id bigint, license string, coverage double, matched_words bigint, first_word bigint, end_word bigint"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text -> one row for each place of each template that a text covers enough of."""
    given = tuple((templates or TEMPLATES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _INDEXES.setdefault(given, LicenseIndex(dict(given)))
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch, "text"), strict=True) for r in index.scan(t, coverage)]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "coverage", "matched_words", "first_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
