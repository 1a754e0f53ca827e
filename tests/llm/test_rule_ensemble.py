"""The sparse rule ensemble: rules from trees, compiled scores, held-out accuracy."""
import math
import random

import pytest
from pyspark.sql import functions as F

from lurescope.llm import rule_ensemble as R
from tests.llm.helpers import awkward, docs, prose

TREE = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=2
  If (feature 0 <= 3.5)
   If (feature 1 <= 1.0)
    Predict: 0.0
   Else (feature 1 > 1.0)
    Predict: 1.0
  Else (feature 0 > 3.5)
   Predict: 1.0
"""


def test_paths_of_a_tree():
    assert R.paths(TREE, ["a", "b"]) == [
        (("a", None, 3.5),), (("a", None, 3.5), ("b", None, 1.0)), (("a", None, 3.5), ("b", 1.0, None)), (("a", 3.5, None),)]


def test_compiled_score(spark):
    model = R.RuleEnsemble(0.5, [((("a", None, 3.5),), 1.0), ((("a", 1.0, None), ("b", None, 0.0)), -2.0)])
    rows = spark.createDataFrame([(a, b) for a in (0, 2, 5) for b in (0, 1)], "a int, b int")
    for r in rows.withColumn("s", model.column()).collect():
        x = 0.5 + (1.0 if r.a <= 3.5 else 0) - (2.0 if r.a > 1 and r.b <= 0 else 0)
        assert r.s == pytest.approx(1 / (1 + math.exp(-x)))
    assert len(model.describe()) == 2


def corpus(n=500):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        t, good = prose(rng, rng.randrange(60, 150), 3000), rng.random() < .7
        if not good:
            t = t.replace(" ", rng.choice([" | ", "### "])) if rng.random() < .6 else "\n".join([t[:80]] * 8)
        rows.append((i, t))
        if rng.random() < .8:
            labels.append((i, int(good)))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int").withColumn("label", F.lit("clash"))


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    out = R.classify(docs(spark, rows, True), table(spark, labels), "quality", 3, 1)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got, truth = {r.doc_id: r for r in out.collect()}, dict(labels)
    tested = [i for i in truth if got[i].held_out]
    assert len(tested) > 60 and sum(got[i].predicted == truth[i] for i in tested) / len(tested) > 0.95


def test_awkward_rows(spark):
    rows, labels = corpus(120)
    more = [(10_000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in awkward()]
    got = R.classify(docs(spark, rows + more), table(spark, [*labels, (None, 1), (3, None), (0, 1), (0, 0)]), "quality", 3, 1).collect()
    assert len(got) == len(rows) + len(more)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_without_both_classes(spark):
    rows, _ = corpus(20)
    assert {r.score for r in R.classify(docs(spark, rows), table(spark, []), "quality", 3, 1).collect()} == {0.5}
    ones = R.classify(docs(spark, rows), table(spark, [(i, 1) for i in range(20)]), "quality", 3, 1).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.5


def test_empty_table(spark):
    assert R.classify(docs(spark, []), table(spark, [(1, 1)]), "quality", 3, 1).collect() == []
