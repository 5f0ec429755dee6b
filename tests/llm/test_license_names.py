"""Names that look alike, repeated texts, and every statement by a plain search."""

from __future__ import annotations

import random
import re

import pytest

from castwise.llm.licenses import TELLING, TEMPLATES, TEXTS, best, license_scan, scan, words
from tests.llm.test_operators import documents, prose

#: Sentences, and what may be found in them.
FRIENDS = {
    "Released under the BSD License.": set(),
    "Released under the ISC License.": set(),
    "Released under the Apache License.": set(),
    "Released under the Zlib License.": set(),
    "Released under the MIT License.": {"MIT"},
    "Released under an MIT license.": {"MIT"},
    "Released under the X11 License.": set(),
    "This work is licensed under the GNU General Public License, version 2.": set(),
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": set(),
    "This work is licensed under the GNU Lesser General Public License, version 3.": set(),
    "This work is licensed under the GNU Affero General Public License, version 3.": set(),
    "This work is licensed under the GNU Library General Public License, version 2.": set(),
    "This work is licensed under the GNU Free Documentation License, version 3.": set(),
    "This work is licensed under the Eclipse Public License, version 2.": set(),
    "Licensed under CC BY-SA 4.0.": set(),
    "Licensed under CC BY 4.0.": set(),
    "Licensed under CC BY-ND 4.0.": set(),
    "Licensed under CC BY-NC-SA 4.0.": set(),
    "Licensed under CC BY-NC-ND 4.0.": set(),
    "Licensed under CC BY-NC 3.0.": set(),
    "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0"},
    "Licensed under the Creative Commons Attribution 4.0 International License.": {"CC-BY-4.0"},
    "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.": set(),
    "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": set(),
    "Licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.": set(),
    "Licensed under the Creative Commons Attribution 3.0 International License.": set(),
    "Licensed under the Creative Commons Zero 1.0 International License.": set(),
    "Licensed under the Apache License, Version 2.0.": {"Apache-2.0"},
    "Licensed under the Apache License, Version 1.1.": set(),
    "Licensed under the Mozilla License, Version 2.0.": set(),
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": set(),
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"MPL-2.0"},
    "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0.": set(),
    "This Source Code Form is subject to the terms of the Common Public License, v. 1.0.": set(),
    TEXTS["BSD-2-Clause-text"]: {"BSD-2-Clause-text"},
    TEXTS["BSD-3-Clause-text"]: {"BSD-3-Clause-text"},
    TEXTS["GPL-2.0-notice"]: {"GPL-2.0-notice"},
    TEXTS["LGPL-2.1-notice"]: {"LGPL-2.1-notice"},
    TEXTS["AGPL-3.0-notice"].replace("version 3", "version 2"): set(),
    TEXTS["LGPL-3.0-notice"].replace("Lesser", "Library"): set(),
}


def test_names_that_look_alike(spark):
    rng = random.Random(8)
    texts = [f"{prose(rng, 12)} {t} {prose(rng, 12)}" for t in FRIENDS]
    got = {i: set() for i in range(len(texts))}
    for r in license_scan(documents(spark, texts)).collect():
        got[r["doc_id"]].add(r["license"])
    assert [(t, got[i]) for i, t in enumerate(FRIENDS)] == list(FRIENDS.items())


def test_every_template_tells_itself():
    for name, text in (TEMPLATES | TEXTS).items():
        must, never = (frozenset(w.split()) for w in TELLING[name])
        own = words(text)
        assert scan(own, own, must=must, never=never) == [(0, len(own), 1.0)], name


@pytest.mark.parametrize("name", ["MIT", "CC-BY-NC-4.0", "GPL-3.0", "MIT-text", "GPL-2.0-notice"])
def test_repeats_are_found_each(name):
    own = words((TEMPLATES | TEXTS)[name])
    must, never = (frozenset(w.split()) for w in TELLING[name])
    for k in (*range(1, 8), 20, 60):
        assert [f[0] for f in scan(own * k, own, must=must, never=never)] == [i * len(own) for i in range(k)], k


def matched(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def test_statements_against_a_search_of_all_stretches(spark):
    """Whatever a plain search finds at 0.8 in some stretch is found, and nothing where no stretch has it."""
    rng = random.Random(21)
    texts, short = [], {k: words(v) for k, v in TEMPLATES.items() if len(words(v)) < 14}
    for _ in range(60):
        own = []
        for _ in range(rng.randint(0, 3)):
            statement = words(rng.choice(list(TEMPLATES.values())))
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(statement))
                rng.choice([lambda: statement.pop(i), lambda: statement.insert(i, "indeed"), lambda: statement.__setitem__(i, "other")])()
            own += [*re.findall("[a-h]+", prose(rng, 9)), *statement]
        texts.append(" ".join([*own, *re.findall("[a-h]+", prose(rng, 9))]))
    got = {(r["doc_id"], r["license"]) for r in license_scan(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        own = words(text)
        for name, template in short.items():
            must, never = (set(w.split()) for w in TELLING[name])
            n = len(template)
            hit = False
            for a in range(len(own)):
                stretch = own[a : a + n + 2]
                common = matched(stretch, template)
                if common >= 0.8 * n and must <= set(stretch) and not never & set(stretch):
                    hit = True
            if hit:
                assert (i, name) in got, (text, name)
            if (i, name) in got:
                assert any(matched(own[a : a + 2 * n], template) >= 0.8 * n for a in range(len(own))), (text, name)


def test_a_statement_within_a_text_is_no_find_of_its_own():
    finds = [("BSD-3-Clause", 0, 19, 1.0), ("BSD-2-Clause-text", 0, 180, 1.0), ("MIT", 200, 205, 1.0)]
    assert best(finds) == [("MIT", 200, 205, 1.0), ("BSD-2-Clause-text", 0, 180, 1.0)]
