"""Adaptive quality rules against brute force."""
import random

import pytest

from lurescope.llm import quality_rules as Q
from tests.llm import brute
from tests.llm.helpers import awkward, docs, prose
from tests.llm.test_mixing import full


def run(spark, rows, extra=False):
    got = Q.quality_table(docs(spark, rows, extra))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    rows = awkward() + [(70, "a a a a"), (71, "a b a b a b a"), (72, "x\n x\nx\n\n\n"), (73, "# $ " * 40)]
    assert run(spark, rows, extra) == sorted(brute.quality(full(rows)), key=str)


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "c", None])
        t = prose(rng, rng.randrange(40, 120), 3000)
        kind = rng.random()
        if kind < .1:
            t = t.replace(" ", " | ")
        elif kind < .2:
            t = t.replace(" ", "### ")
        elif kind < .3:
            t = "\n".join([t[:60]] * 9) + "\n" + t
        rows.append((i, t, lang, source))
    return rows


def test_groups_and_fallbacks(spark):
    rows = corpus()
    got = run(spark, rows)
    assert got == sorted(brute.quality(rows), key=str)
    kept = {r[0] for r in got if r[-1]}
    assert 150 < len(kept) < 230


def test_kept_documents(spark):
    rows = corpus()
    out = Q.keep_documents(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in brute.quality(rows) if r[-1])


def test_sketch_buckets_are_close(spark):
    from pyspark.sql import functions as F
    rows = spark.range(0, 200_000, 37).select("id", Q.sketch_bucket(F.col("id")).alias("b")).collect()
    for r in rows:
        assert r.b == brute.bucket(r.id) and r.id <= r.b <= r.id * (1 + 1 / 32) + 1


def test_empty_table(spark):
    assert run(spark, []) == []
