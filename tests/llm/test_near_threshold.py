"""The threshold of near-duplicates as an argument: 0.8 in the pipeline, 0.85 in the query."""
import random

import corpus_pipeline
from lurescope.llm import minhash
from tests.llm.helpers import docs, prose
from tests.llm.test_minhash import shingle_set


def pairs():
    """(doc_id, text) of 2 * i and 2 * i + 1, where the second has one or more edited words."""
    rng = random.Random(31)
    rows = []
    for i in range(40):
        w = prose(rng, 100, 3000).split(" ")
        rows.append((2 * i, " ".join(w)))
        for k in range(1 + i % 3):
            w[20 + 30 * k] = f"edited{i}"
        rows.append((2 * i + 1, " ".join(w)))
    return rows


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_stage_and_query_thresholds(spark):
    rows = pairs()
    near = {rows[i][0]: similarity(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)}
    assert {0, 1, 2} == {(s >= .8) + (s >= .85) for s in near.values()}  # below, between and above
    stage = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()}
    assert stage == {i for i, _ in rows} - {i + 1 for i, s in near.items() if s >= .8}
    query = {r.doc_id for r in minhash.near_duplicates(docs(spark, rows)).filter("kept").collect()}
    assert query == {i for i, _ in rows} - {i + 1 for i, s in near.items() if s >= .85}


def test_pipeline_at_eighty(spark, tmp_path):
    rows = pairs()
    d = str(tmp_path)
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    near = {rows[i][0]: similarity(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)}
    got = {r.doc_id for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {i for i, _ in rows} - {i + 1 for i, s in near.items() if s >= .8}
