"""License scans by patience alignment of texts with license templates.

A text's words are looked up in an index of the templates' word sequences; hits on
nearby diagonals of one template make a region, the most frequent diagonal first; it
needs a hit for every `_HITS` words of the template. The region's words are aligned
with the template's: words that are unique in both are anchors, the longest
increasing subsequence of them is kept, and the gaps between anchors are aligned
in the same way, after equal words at their ends have been matched. Coverage is the
share of the template's words that are matched; regions with `MIN_COVERAGE` or more
are reported, and of regions that overlap the one with most matched words. Templates
are whole licenses, the headers that files have, and notices ("under the ..."); a notice
must have every word of the license's name.

A document is worked on alone and nothing is shuffled. The templates are a fixed
list, so what an executor holds is bounded.

Defined results: null, empty and unlicensed texts give no row; repeated rows give
repeated findings; of overlapping regions with equally many words the one of higher
coverage is kept, then the earlier one, then the template first in the list; texts are
scanned whole, whatever their length; a null doc_id is passed on; extra columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

MIN_COVERAGE = 0.8
_HITS = 10
_SHORT = 16  # templates of fewer words are found by pairs of words, others by triples
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

# Short licenses whole, and the headers that go before files. Longer licenses are files beside this one.
TEXTS: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": f"{_CONDITIONS}\n{_DISCLAIMER}",
    "BSD-3-Clause": f"""{_CONDITIONS}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission.
{_DISCLAIMER}""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "Apache-2.0 (header)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0 (header)": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by
the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.
You should have received a copy of the GNU {0}General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
_FILES = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "Artistic-1.0")
# Names of licenses as notices have them.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons CC0 1.0"),
}
_CC_PARTS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}


def notices() -> dict[str, list[str]]:
    """Names of licenses for "under ..." notices: those of NAMES, the GNU licenses and Creative Commons, by version."""
    out = {k: [*v] for k, v in NAMES.items()}
    for short, long, versions in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",))):
        for v in versions:
            forms = dict.fromkeys([v, v.removesuffix(".0")])
            out[f"{short}-{v}"] = [x for f in forms for x in (f"{long}, version {f}", f"{long} v{f}", f"{long} {f}", f"GNU {short} v{f}", f"GNU {short} version {f}")]
    for parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        spelled = "-".join(_CC_PARTS[p] for p in parts.split("-"))
        for v in ("2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{parts}-{v}"] = [f"CC {parts} {v}", f"Creative Commons {spelled} {v}"]
    return out


class Template(NamedTuple):
    """A text to be found, and the first of its words that must all be there (for all others MIN_COVERAGE holds)."""

    license: str
    text: str
    needed_from: int | None = None


def _file(name: str) -> str:
    return pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode("utf-8")


@lru_cache(1)
def standard_templates() -> tuple[Template, ...]:
    """Whole licenses, file headers, and notices made by rule from the licenses' names."""
    out = [Template(k, t) for k, t in TEXTS.items()] + [Template(k, _file(k)) for k in _FILES]
    for which, versions in (("", ("2", "3")), ("Lesser ", ("2.1", "3")), ("Affero ", ("3",))):
        for v in versions:
            short = {"": "GPL", "Lesser ": "LGPL", "Affero ": "AGPL"}[which]
            out.append(Template(f"{short}-{v if '.' in v else v + '.0'}-or-later (header)", _GPL_HEADER.format(which, v)))
    out += [Template(f"{k} (notice)", f"under {name}", 1) for k, names in notices().items() for name in names]
    return (*out, Template("All rights reserved (notice)", "All rights reserved", 0))


class Finding(NamedTuple):
    license: str
    coverage: float
    matched: int
    first_word: int
    last_word: int


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of `pairs`, ordered by their first part, whose second part increases."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words in order, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        where = {w: p for p, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = _increasing([(p, where[w]) for p, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in where])
        if not anchors:
            continue
        out += anchors
        edges = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if p + 1 < q and r + 1 < s]
    return sorted(out)


class Scanner:
    """Index of templates by short word sequences."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.two: dict[tuple, list[tuple[int, int]]] = {}
        self.three: dict[tuple, list[tuple[int, int]]] = {}
        for t, w in enumerate(self.words):
            n, index = (2, self.two) if len(w) < _SHORT else (3, self.three)
            for at, key in enumerate(zip(*(w[i:] for i in range(n)))):
                index.setdefault(key, []).append((t, at))

    def _regions(self, t: int, words: list[str], begins: list[int], least: float) -> Iterator[Finding]:
        """Where a template is, from the diagonals of its hits."""
        template, needed = self.words[t], self.templates[t].needed_from
        counted = Counter(template)
        slack = max(2, len(template) // 4)
        begins.sort()
        used: list[int] = []
        for usual, _ in sorted(Counter(begins).items(), key=lambda x: (-x[1], x[0])):
            k = bisect_left(used, usual - slack)
            if k < len(used) and used[k] <= usual + slack:
                continue
            # A region of the text that has few of the template's sequences isn't the template.
            if bisect_right(begins, usual + slack) - bisect_left(begins, usual - slack) < len(template) // _HITS:
                continue
            insort(used, usual)
            pairs: list[tuple[int, int]] = []
            # The narrowest window that will do: what stands around may repeat the template's words.
            for x, y in ((usual, usual), (usual - slack, usual + slack)):
                at, part = max(0, x), words[max(0, x) : y + len(template)]
                if len(pairs) < len(template) and sum((Counter(part) & counted).values()) >= least * len(template):
                    got = align(part, template)
                    if len(got) > len(pairs):
                        a, pairs = at, got
            if len(pairs) < least * len(template):
                continue
            if needed is not None and sum(k >= needed for _, k in pairs) < len(template) - needed:
                continue
            yield Finding(self.templates[t].license, len(pairs) / len(template), len(pairs), a + pairs[0][0], a + pairs[-1][0])

    def find(self, text: str, least: float = MIN_COVERAGE) -> list[Finding]:
        words = words_of(text)
        starts: dict[int, list[int]] = {}
        for n, index in ((2, self.two), (3, self.three)):
            grams = [*zip(*(words[i:] for i in range(n)))]
            if index.keys().isdisjoint(grams):
                continue
            for p, key in enumerate(grams):
                for t, at in index.get(key, ()):
                    starts.setdefault(t, []).append(p - at)
        found = [(-f.matched, -f.coverage, f.first_word, t, f) for t, begins in starts.items() for f in self._regions(t, words, begins, least)]
        kept: list[tuple[int, int, Finding]] = []  # apart from each other, in order
        for *_, f in sorted(found):
            k = bisect_left(kept, (f.first_word,))
            if (k == 0 or kept[k - 1][1] < f.first_word) and (k == len(kept) or kept[k][0] > f.last_word):
                kept.insert(k, (f.first_word, f.last_word, f))
        return [f for *_, f in kept]


@lru_cache(4)
def _scanner(templates: tuple[Template, ...]) -> Scanner:
    return Scanner(templates)


def scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = MIN_COVERAGE) -> DataFrame:
    """Rows (doc_id, license, coverage, matched_words, first_word, last_word), one for each region found.

    `templates` are texts by name, by default those of `standard_templates`.
    """
    chosen = standard_templates() if templates is None else tuple(Template(k, t) for k, t in templates.items())
    shared = df.sparkSession.sparkContext.broadcast(chosen)
    names = ["doc_id", "license", "coverage", "matched_words", "first_word", "last_word"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared.value)
        for b in batches:
            rows = [(d, *f) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for f in scanner.find(t.as_py() or "", least)]
            columns = [*zip(*rows)] or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return df.select(df[f"`{doc_id}`"].cast("long"), df[f"`{text}`"].cast("string")).mapInArrow(run, "doc_id long, license string, coverage double, matched_words int, first_word int, last_word int")
