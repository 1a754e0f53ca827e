"""The linear-chain CRF, its spans, and held-out accuracy."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescope.llm import crf, toxicity
from lurescope.llm.rule_ensemble import held_out
from tests.llm.helpers import awkward, docs, prose


def test_marginals_by_enumeration():
    rng = np.random.RandomState(1)
    for n in (1, 2, 5):
        e, t = rng.randn(n), rng.randn(2, 2)
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            weight[path] = np.exp(sum(e[i] for i in range(n) if path[i]) + sum(t[a, b] for a, b in zip(path, path[1:])))
        total = sum(weight.values())
        want = [sum(w for p, w in weight.items() if p[i]) / total for i in range(n)]
        got = crf.tag([e, np.zeros(0), e[:1]], t)
        assert np.allclose(got[0], want) and len(got[1]) == 0 and np.allclose(got[2], 1 / (1 + np.exp(-e[0])))


def test_blocks_do_not_change_marginals():
    rng = np.random.RandomState(2)
    seqs, t = [rng.randn(rng.randint(0, 40)) for _ in range(50)], rng.randn(2, 2)
    for a, b in zip(crf.tag(seqs, t), crf.tag(seqs, t, cells=1)):
        assert np.allclose(a, b)


def test_training_learns_words_and_prefixes():
    rng = random.Random(3)
    words = [[rng.choice([b"calm", b"plain", b"words", b"bad%d" % rng.randrange(99), b"badness"]) for _ in range(12)] for _ in range(200)]
    ids = np.array([[crf.feature_ids(w) for w in s] for s in words]).transpose(1, 0, 2)
    marks = np.array([[float(w.startswith(b"badness")) for w in s] for s in words]).T
    model = crf.train(ids, marks, np.ones(marks.shape, bool))
    em = crf.Emissions(model)
    p = crf.tag([em.of([b"calm", b"badness", b"plain"]), em.of([b"words", b"bad1"])], model.transitions)
    assert p[0][1] > 0.9 > 0.1 > max(p[0][0], p[0][2], *p[1])


def corpus(n=500):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        t, toxic = prose(rng, rng.randrange(20, 120), 3000), rng.random() < .25
        w = t.split(" ")
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["Idiot", "scum,", "vequ%d" % rng.randrange(500)]))
        rows.append((i, " ".join(w)))
        if rng.random() < .8:
            labels.append((i, int(toxic)))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("score", F.lit("clash"))


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    out = toxicity.classify(docs(spark, rows, True), table(spark, labels), 5, 0)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    truth, text = dict(labels), dict(rows)
    tested = [i for i in truth if got[i].held_out]
    assert len(tested) > 50 and sum(got[i].predicted == truth[i] for i in tested) / len(tested) > 0.95
    for i, r in got.items():
        for s in r.spans:
            piece = text[i][s.start:s.end].lower()
            assert piece and not piece[0].isspace() and not piece[-1].isspace()
    found = [text[i][s.start:s.end].lower() for i, r in got.items() for s in r.spans]
    assert sum("idiot" in f or "scum" in f or "vequ" in f for f in found) / len(found) > 0.9


def test_awkward_rows(spark):
    rows, labels = corpus(120)
    more = [(10_000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in awkward()]
    got = toxicity.classify(docs(spark, rows + more), table(spark, [*labels, (None, 1), (3, None), (0, 1), (0, 0)]), 5, 0).collect()
    assert len(got) == len(rows) + len(more)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_reruns_agree(spark):
    rows, labels = corpus(150)
    a, b = (sorted(map(str, toxicity.classify(docs(spark, rows), table(spark, labels), 5, 0).collect())) for _ in range(2))
    assert a == b


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(i, 1) for i in range(40)], None)])
def test_without_both_classes(spark, labels, score):
    rows, _ = corpus(40)
    got = toxicity.classify(docs(spark, rows), table(spark, labels), 5, 0).collect()
    assert len({r.score for r in got}) == 1 and (score is None or got[0].score == score)


def test_empty_table(spark):
    assert toxicity.classify(docs(spark, []), table(spark, [(1, 1), (2, 0)]), 5, 0).collect() == []


def test_fold(spark):
    import zlib
    got = spark.range(50).select("id", held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
