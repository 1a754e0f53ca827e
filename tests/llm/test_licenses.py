"""License scan against a plain reading of the rules."""
import re

import pytest

from lurescope.llm import licenses
from lurescope.llm.license_rules import rules
from tests.llm.helpers import awkward, docs, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    out = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(FOLD))
        places, base = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    places.append(i)
                    base.add(label)
        text, found = " ".join(w), set()
        for rule, label, keyword, priority, weight, pattern in rules():
            if (" " + text).find(" " + keyword) >= 0:
                found |= {(m.start(), m.end(), priority, rule, label, weight) for m in re.finditer(pattern, text)}
        left = []
        for d in found:
            beaten = any(e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or (e[2] == d[2] and (
                e[1] - e[0] > d[1] - d[0] or e[3] < d[3]))) for e in found)
            if not beaten:
                left.append(d)
        labels = base | {d[4] for d in left}
        score = max([0.0, *[d[5] for d in left], *([licenses.BASE_SCORE] if places else [])])
        out.append((r[0], len(w), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return sorted(out, key=str)


def run(spark, rows, extra=False):
    got = licenses.scan(docs(spark, rows, extra))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


NOTICES = [
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "MIT License",
    "This is free software, under the GNU General Public License, version 3 or later.", "gpl", "GPL v2",
    "Copyright (c) 2021 Foo Bar. All rights reserved.", "all rights reserved all rights reserved", "cc by cc by",
    "CC-BY-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "http://creativecommons.org/licenses/by/4.0/",
    "Released under the terms of the Mozilla Public License v2.0", "mit der Bahn", "permit licence", "accc bypass cc byx",
    "general public\nlicense, cc  by -- all rights RESERVED", "BSD 3-clause license or BSD license",
    "The Artistic License 2.0 or, the GNU GPL v3", "no rights", "unlicense", "General Public License",
]


@pytest.mark.parametrize("extra", [False, True])
def test_rules_and_base_phrases(spark, extra):
    import random
    rng = random.Random(2)
    rows = awkward() + [(1000 + i, t) for i, t in enumerate(NOTICES)]
    rows += [(2000 + i, prose(rng, 30) + " " + " ".join(rng.sample(NOTICES, 3)) + " " + prose(rng, 10)) for i in range(40)]
    rows += [(3000, "cc by " * 500 + "All rights reserved. " * 300)]
    assert run(spark, rows, extra) == brute(rows)


def test_hundreds_of_rules_with_unique_ids():
    table = rules()
    assert len(table) >= 200
    assert [r[0] for r in table] == list(range(len(table)))
    for r in table:
        re.compile(r[5])


def test_empty_table(spark):
    assert run(spark, []) == []
