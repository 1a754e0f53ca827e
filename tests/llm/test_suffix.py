"""Repeated byte strings against brute force."""
import hashlib
import random
from collections import Counter

import pytest

from lurescope.llm import suffix
from tests.llm.helpers import awkward, docs, prose


def brute(rows, width):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(raw[i:i + width] for _, raw in raws for i in range(len(raw) - width + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for x in range(len(raw) - width + 1):
            if seen[raw[x:x + width]] > 1:
                gone[x:x + width] = b"\x01" * width
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, width, extra=False):
    got = suffix.cut_repeats(docs(spark, rows, extra), width)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    rows = awkward()
    assert run(spark, rows, 200, extra) == brute(rows, 200)


def test_edited_copies_and_shared_passages(spark):
    rng = random.Random(3)
    base, passage = prose(rng, 200), prose(rng, 60)
    rows = []
    for i in range(40):
        w = base.split(" ")
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        t = " ".join(w) if i % 2 else prose(rng, 50) + passage + prose(rng, 50)
        rows.append((i, t))
    assert run(spark, rows, 200) == brute(rows, 200)
    assert run(spark, rows, 41) == brute(rows, 41)


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 500)
    rng = random.Random(4)
    t = prose(rng, 800)
    rows = [(1, t), (2, t[100:3000] + prose(rng, 300))]
    assert run(spark, rows, 200) == brute(rows, 200)


def test_empty_table(spark):
    assert run(spark, [], 200) == []
