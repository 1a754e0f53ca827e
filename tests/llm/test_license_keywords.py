"""The keywords of the license rules never decide a result."""
import random
import re
from re import _constants as K
from re import _parser

from lurescope.llm.license_rules import rules
from tests.llm import test_licenses as plain
from tests.llm.helpers import prose

SPELLINGS = [
    "FreeBSD License", "2-clause license", "two clause licence", "three-clause license", "4-clause BSD licence",
    "Common Public Licence 1.0", "Open Database Licence", "Free Documentation Licence 1.3", "for noncommercial use only",
    "licenced under the X licence", "GNU General Public Licence v3", "GNU Lesser General Public Licence 2.1",
    "GNU Library General Public Licence v2", "GNU Affero General Public Licence v3", "Open Font Licence", "SIL Open Font Licence 1.1",
]


def ungated():
    """The rules with a keyword that every text has."""
    return [(*r[:2], "", *r[3:]) for r in rules()]


def test_other_spellings_without_the_gate(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(SPELLINGS + plain.NOTICES)]
    rows += [(1000 + i, prose(rng, 12) + " " + t + " " + prose(rng, 5)) for i, t in enumerate(SPELLINGS)]
    got = plain.run(spark, rows)
    monkeypatch.setattr(plain, "rules", ungated)
    assert got == plain.brute(rows)
    labels = {r[0]: r[6] for r in got}
    assert "" not in [labels[i] for i in range(len(SPELLINGS))]
    assert labels[0] == labels[1] == labels[2] == "bsd-2-clause" and "gpl-3.0" in labels[10]


def sample(tree, rng):
    """A string that the parsed regex matches."""
    out = ""
    for op, arg in tree:
        if op is K.LITERAL:
            out += chr(arg)
        elif op is K.IN:
            pick = rng.choice([a for a in arg if a[0] is not K.NEGATE]) if arg[0][0] is not K.NEGATE else (K.LITERAL, ord("x"))
            out += chr(pick[1]) if pick[0] is K.LITERAL else "7"
        elif op is K.NOT_LITERAL:
            out += "x"
        elif op is K.SUBPATTERN:
            out += sample(arg[3], rng)
        elif op is K.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert op is K.ASSERT_NOT, op
    return out


def test_every_match_holds_a_keyword():
    rng, keywords = random.Random(13), {}
    for _, label, keyword, _, _, pattern in rules():
        keywords.setdefault((label, pattern), []).append(keyword)
    for (label, pattern), words in keywords.items():
        tree = _parser.parse(pattern)
        for _ in range(60):
            text = sample(tree, rng)
            assert re.fullmatch(pattern, text), (pattern, text)
            assert any(" " + k in " " + text for k in words), (label, text, words)
