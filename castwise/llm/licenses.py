"""Operator 4: license scans by patience alignment of texts with license templates.

Words that occur once in both sides are anchors; the longest increasing subsequence of
their places is kept, and the gaps between anchors are aligned the same way, after common
ends have been matched; a gap without such a word gets its longest common subsequence.  Coverage is the matched share of the template's words.

A text can reach the coverage only if it holds enough of the template's words, and then at
least one of the template words that are rarest in it is matched; windows around those
words are aligned, a narrow one where the template would lie (statements that follow each
other repeat all words) and a wide one, so long texts and repeated statements are scanned whole.

Defined results: one row for each statement found (none for empty or null texts); a match
spreads over at most twice as many words as it matches, holds the words that tell its license from others (TELLING) and
has none between that name another one; of overlapping finds of one template the most compact stays (least words missed or
between), then the first; of overlapping finds of different
texts or notices (which share most words) the one with most coverage, then most matched words, and a statement within a text
that is found is no find of its own; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

# Statements by which works declare their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {holders}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
# License texts and notices; of overlapping finds among these only the best is a find.
TEXTS = {
    "AGPL-3.0-notice": _GNU.format(program="This program", name="Affero General Public License", version="3"),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": _BSD.format(third=""),
    "BSD-3-Clause-text": _BSD.format(third="3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
    "GPL-2.0-notice": _GNU.format(program="This program", name="General Public License", version="2"),
    "GPL-3.0-notice": _GNU.format(program="This program", name="General Public License", version="3"),
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-notice": _GNU.format(program="This library", name="Lesser General Public License", version="2.1"),
    "LGPL-3.0-notice": _GNU.format(program="This library", name="Lesser General Public License", version="3"),
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY.format(holders="OR COPYRIGHT HOLDERS "),
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY.format(holders=""),
}
_CC = "noncommercial sharealike noderivatives noderivs non commercial share alike nc sa nd"
# Words that a find must match, and words that it must not have between.
TELLING = {
    "AGPL-3.0-notice": ("affero 3", "lesser"),
    "Apache-2.0": ("apache 2", "1"),
    "Apache-2.0-notice": ("apache 2", "1"),
    "BSD-2-Clause-text": ("", "endorse promote"),
    "BSD-3-Clause": ("redistribution source binary", ""),
    "BSD-3-Clause-text": ("", "advertising"),
    "CC-BY-4.0": ("creative commons attribution 4", _CC),
    "CC-BY-NC-4.0": ("cc by nc 4", "sa nd"),
    "GPL-2.0-notice": ("gnu general 2", "lesser affero library 3"),
    "GPL-3.0": ("gnu general public 3", "lesser affero library 2"),
    "GPL-3.0-notice": ("gnu general 3", "lesser affero library 2"),
    "ISC-text": ("", "sublicense"),
    "LGPL-2.1-notice": ("lesser 2 1", "affero"),
    "LGPL-3.0-notice": ("lesser 3", "affero 2"),
    "MIT": ("mit", "bsd apache gnu"),
    "MIT-text": ("", ""),
    "MPL-2.0": ("mozilla public 2", "1"),
    "Unlicense-text": ("", ""),
}
COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [pairs[i] for i in increasing([j for _, j in pairs])]
        if not anchors:  # no word is unique here: the longest common subsequence, by the same piles over all equal pairs
            held: dict[str, list[int]] = {}
            for j in range(b1 - 1, b0 - 1, -1):  # descending, so that a word of a is matched once
                held.setdefault(b[j], []).append(j)
            equal = [(i, j) for i in range(a0, a1) for j in held.get(a[i], ())]
            found += [equal[k] for k in increasing([j for _, j in equal])]
            continue
        found += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(found)


def scan(text: list[str], template: list[str], coverage: float = COVERAGE, must: frozenset = frozenset(), never: frozenset = frozenset()) -> list[tuple[int, int, float]]:
    """(first word, end word, coverage) of each find of the template: it matches all words of ``must`` and has none of ``never`` between."""
    need = math.ceil(coverage * len(template) - 1e-9)
    there = Counter(w for w in text if w in set(template)) if template else Counter()
    wanted = Counter(template)
    if not template or sum(min(n, there[w]) for w, n in wanted.items()) < need or not all(there[w] for w in must):
        return []
    rare, left = [], len(template) - need + 1
    for w in sorted(wanted, key=lambda w: (there[w], w)):
        if left <= 0:
            break
        rare.append(w)
        left -= wanted[w]
    n, finds = len(template), set()
    place = {w: [j for j, x in enumerate(template) if x == w] for w in rare}
    # exactly where the template would lie, somewhat around it, and far around it
    stretches = ((max(0, p - j - slack), p - j + n + slack) for p, w in enumerate(text) if w in place for j in place[w] for slack in (0, n // 2, 2 * n))
    for low, high in dict.fromkeys(stretches):
        match = align(text[low:high], template)
        if len(match) < need:
            continue
        first, last = low + match[0][0], low + match[-1][0] + 1
        if last - first > 2 * len(match) or not must <= {template[j] for _, j in match}:
            continue
        own = {low + i for i, _ in match}
        if not any(text[k] in never and k not in own for k in range(first, last)):
            finds.add((last - first - 2 * len(match), -len(match), first, last))
    out: list[tuple[int, int, float]] = []
    for _, less, first, last in sorted(finds):
        if all(last <= a or first >= b for a, b, _ in out):
            out.append((first, last, -less / n))
    return sorted(out)


def best(finds: list[tuple]) -> list[tuple]:
    """(name, first, end, coverage) without those of TEXTS that a better one of TEXTS overlaps (more coverage, then more matched words, then the name) and without statements that lie in one."""
    size = {f[0]: len(words(TEXTS[f[0]])) for f in finds if f[0] in TEXTS}
    out: list[tuple] = []
    apart = lambda f: all(f[2] <= a or f[1] >= b for _, a, b, _ in out)
    for f in sorted((f for f in finds if f[0] in TEXTS), key=lambda f: (-f[3], -f[3] * size[f[0]], f[0])):
        if apart(f):
            out.append(f)
    return [f for f in finds if f[0] not in TEXTS and apart(f)] + sorted(out)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, first_word, end_word, coverage."""
    known = {k: words(v) for k, v in (TEMPLATES | TEXTS if templates is None else templates).items()}
    need = {k: (set(t), coverage * len(t), Counter(t)) for k, t in known.items()}
    telling = {k: tuple(frozenset(w.split()) for w in (TELLING.get(k, ("", "")) if templates is None else ("", ""))) for k in known}

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words(text)
                there, finds = set(own), []
                for name, template in known.items():
                    distinct, least, count = need[name]
                    if sum(count[w] for w in distinct & there) >= least - 1e-9:
                        finds += [(name, *found) for found in scan(own, template, coverage, *telling[name])]
                rows += [(doc, *found) for found in (best(finds) if templates is None else finds)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "license", "first_word", "end_word", "coverage"])

    return texts(docs).mapInArrow(run, "doc_id long, license string, first_word long, end_word long, coverage double")
