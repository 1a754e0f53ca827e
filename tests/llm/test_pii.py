"""Personal data: base spans against the plain patterns, message passing against enumeration, consistency of repeats."""
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from lurescope.llm import pii as M
from lurescope.llm import skip_chain as crf
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    total = 0
    for place, c in enumerate(reversed(number)):
        x = int(c) * (1 + place % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())
    return [[m.span() for m in EMAIL.finditer(text)], [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
            [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
            [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, own in zip(M.KINDS, spans) for s, e in own)


def test_patterns_on_random_strings():
    rng = random.Random(1)
    for alphabet in ("a1.@", "12. -", "+1 (). -9", "a@.-_b%+", "0123456789 -", "25.0+@a é"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert M.base_spans(text) == plain(text), text
            cut = M.units(text, M.base_spans(text))
            assert all(a < b for a, b, _ in cut) and all(x[1] <= y[0] for x, y in zip(cut, cut[1:])), text


def test_long_runs_take_linear_time():
    for text in ("x" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "@a.b" * 100_000, "+1 " * 100_000, "a@" * 200_000, "1 " * 200_000):
        M.entities([text], crf.Model(np.zeros((M.FEATURES, M.LABELS)), M.prior()))


def test_messages_are_exact_on_a_tree_and_close_on_a_loop():
    rng = np.random.RandomState(3)
    for edges, close in (([(0, 1, 0), (1, 2, 0), (1, 3, 1)], 1e-3), ([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1)], 0.06)):
        e = np.array(edges)
        model = crf.Model(rng.normal(0, 1, (6, 3)), rng.normal(0, 0.5, (2, 3, 3)))
        ids, bars, observed = rng.randint(0, 6, (4, 2)), np.zeros((4, 3)), np.array([-1, -1, 2, -1])
        got = crf.marginals(model, ids, bars, observed, e[:, 0], e[:, 1], e[:, 2])
        node, want = crf.node_weights(model, ids, bars, observed), np.zeros((4, 3))
        for y in itertools.product(range(3), repeat=4):
            w = np.exp(sum(node[n, y[n]] for n in range(4)) + sum(model.pair[k, y[a], y[b]] for a, b, k in edges))
            for n in range(4):
                want[n, y[n]] += w
        want /= want.sum(axis=1, keepdims=True)
        assert np.abs(got - want).max() < close


@pytest.fixture(scope="module")
def model(spark):
    return M.fit(spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet"))


PLANTED = [
    ("Call +1 (523) 555-7040 now, later (523) 555-7040 or 5235557040 or 523.555.7040.", {"phone": ["(523) 555-7040", "5235557040", "523.555.7040"]}),
    ("card 4111 1111 1111 1111 " + "and words " * 300 + "4111.1111.1111.1111", {"card": ["4111.1111.1111.1111"]}),
    ("host 10.1.2.3 or 10-1-2-3", {"ip": ["10-1-2-3"]}),
    ("Mail ann.63@mail3.example.com " + "text " * 500 + "user ann.63 wrote", {"email": ["ann.63"]}),
    ("sections 9.9. and 3.14 then 2021-10-11, 12345678 and 1234 5678 9012 3456, room 12", {}),
    ("nothing here", {}), ("", {}),
]


def test_mentions_in_another_form_are_added(model):
    for (text, want), found in zip(PLANTED, M.entities([t for t, _ in PLANTED], model)):
        got = {}
        for e in found:
            if not e["base"]:
                got.setdefault(e["kind"], []).append(text[e["start"]:e["end"]])
        assert got == want, text
        assert [(e["kind"], e["start"], e["end"]) for e in found if e["base"]] == [(k, s, e) for k, own in zip(M.KINDS, plain(text)) for s, e in own]


def test_without_skip_edges_they_are_not(model):
    cut = crf.Model(model.table, model.pair * np.array([1, 0, 0])[:, None, None])
    text = PLANTED[3][0]
    assert [e["base"] for e in M.entities([text], cut)[0]] == [True]


@pytest.mark.parametrize("extra", [False, True])
def test_query_on_awkward_rows(spark, model, extra):
    rows = awkward() + [(200 + i, t) for i, (t, _) in enumerate(PLANTED)] + [(201, PLANTED[1][0]), (None, "a.1@b.c é +1 (523) 555-7040")]
    got = M.digest(M.find(docs(spark, rows, extra), model))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for doc, text in [(r[0], r[1] or "") for r in rows]:
        base = plain(text)
        want.append((doc, *map(len, base), hashlib.sha256(joined(base).encode()).hexdigest()))
    out = got.collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted(want, key=str)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1] or "")
    for r in out:  # base spans stay; spans are ordered by kind, then start
        spans = [(M.KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        base = joined(plain(texts[r.doc_id])) if r.doc_id != 201 else ""
        assert spans == sorted(spans) and (not base or set(base.split(",")) <= set(r.spans.split(",")))


def test_empty_table_and_no_base_spans(spark):
    assert M.digest(M.find(docs(spark, []))).collect() == []
    assert [r.spans for r in M.digest(M.find(docs(spark, [(1, "room 12 and 13"), (2, None)]))).collect()] == ["", ""]


def test_whole_table(spark):
    got = M.op13_pii(spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(got) == len(texts)
    added = 0
    for r in got:
        base = joined(plain(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        added += len(set(r.spans.split(",")) - set(base.split(",")) - {""})
    assert added <= len(got) // 20  # ordinary prose gets no spans
