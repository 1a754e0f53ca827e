"""Source mixing against brute force."""
import random
from collections import defaultdict

import pytest

from lurescope.llm import mixing
from tests.llm import brute
from tests.llm.helpers import awkward, docs, prose


def full(rows):
    return [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0") for r in rows]


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 90)) + "#$%" * rng.randrange(3), "en", f"s{int(rng.random() ** 3 * 9)}") for i in range(n)]
    return rows + [(900 + k, prose(rng, 4), "en", "tiny") for k in range(2)] + [(990, None, "en", "empty"), (991, prose(rng, 50), "en", None)]


def check(spark, rows, extra=False, grain_rows=None):
    got = mixing.mix(docs(spark, rows, extra)).collect()
    rows = full(rows)
    keys = brute.mix_keys(rows)
    sizes = defaultdict(int)
    for r, (size, _) in zip(rows, keys):
        sizes[r[3]] += size
    want = brute.targets(sizes)
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6)) for r in got) == \
        sorted((str(r[0]), k[0], sizes[r[3]], round(want[r[3]], 6)) for r, k in zip(rows, keys))
    # the order by key decides: whole epochs, then a prefix
    taken = defaultdict(list)
    for r in got:
        taken[str(r.doc_id)].append(r.taken)
    for source in sizes:
        mine = sorted((k[1], -1 if r[0] is None else r[0], k[0]) for r, k in zip(rows, keys) if r[3] == source)
        epochs = int(want[source] // sizes[source]) if sizes[source] else 0
        left = round(want[source] - epochs * sizes[source])
        seen, ids = 0, defaultdict(int)
        for key, tie, size in mine:
            ids[(key, tie)] += 1
        for key, tie, size in mine:
            t = taken["None" if tie == -1 else str(tie)]
            if ids[(key, tie)] == 1 and len(t) == 1:
                assert t[0] == epochs * size + max(0, min(size, left - seen)), (source, tie)
            seen += size
        total = sum(sum(taken[str(i)]) for i in {str(r[0]) for r in rows if r[3] == source})
        if len({r[0] for r in rows}) == len(rows):
            assert abs(total - want[source]) <= 1
    return got


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    check(spark, awkward(), extra)


def test_targets_cap_and_reshare(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 5)  # many buckets
    got = check(spark, corpus())
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert sum(r.taken for r in got if r.source_size) == pytest.approx(sum(r["size"] for r in got), abs=10)


def test_reruns_agree(spark):
    a, b = (sorted(map(str, mixing.mix(docs(spark, corpus(2))).collect())) for _ in range(2))
    assert a == b


def test_mixed_documents_are_whole(spark):
    rows = corpus(3)
    out = mixing.mix_documents(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = defaultdict(int)
    text = {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert r.text == text[r.doc_id]
        got[r.source] += len((r.text or "").split())
    for s, t in brute.targets(_sizes(rows)).items():
        assert abs(got[s] - t) <= 90


def _sizes(rows):
    sizes = defaultdict(int)
    for r, k in zip(rows, brute.mix_keys(rows)):
        sizes[r[3]] += k[0]
    return sizes


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert mixing.mix_documents(docs(spark, [])).collect() == []
