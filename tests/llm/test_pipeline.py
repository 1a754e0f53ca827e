"""The corpus pipeline against its stages in plain Python."""
import os
import random
from collections import Counter

import corpus_pipeline
from lurescope.session import shared_dir
from tests.llm import brute
from tests.llm.helpers import docs, prose
from tests.llm.test_minhash import brute as components
from tests.llm.test_winnowing import brute as contamination

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def mixed(rows):
    """(row, copies): whole epochs, then the prefix by key; the last document if half of it fits."""
    keys = brute.mix_keys(rows)
    sizes = Counter()
    for r, (size, _) in zip(rows, keys):
        sizes[r[3]] += size
    want = brute.targets(dict(sizes))
    out = []
    for source in sizes:
        mine = sorted(((k[1], r[0]), r, k[0]) for r, k in zip(rows, keys) if r[3] == source)
        epochs = int(want[source] // sizes[source]) if sizes[source] else 0
        left, seen = round(want[source] - epochs * sizes[source]), 0
        for _, r, size in mine:
            fit = max(0, min(size, left - seen))
            out += [r] * (epochs + int(size > 0 and 2 * fit >= size))
            seen += size
    return out


def corpus():
    rng = random.Random(21)
    items = [(i, prose(rng, 25, 3000)) for i in range(5)]
    rows = []
    for i in range(220):
        t = prose(rng, rng.randrange(55, 120), 3000)
        if i % 11 == 0:
            t = t.replace(" ", "### ")
        if i % 13 == 0:
            t += " " + items[i % 5][1]
        if i % 7 == 0 and rows:
            w = rows[-1][1].split(" ")
            for k in range(1 + i % 4):  # one to four edits: copies above and below 0.8
                w[3 + 12 * k] = "edited"
            t = " ".join(w)
        rows.append((i, t, rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", "c"])))
    return rows, items


def test_stages_and_result(spark, tmp_path):
    rows, items = corpus()
    d = str(tmp_path)
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = {r[0] for r in brute.quality(rows) if r[-1]}
    want = [r for r in rows if r[0] in kept]
    one = {r[0] for r in components([r[:2] for r in want], 80) if r[3]}
    want = [r for r in want if r[0] in one]
    dirty = {r[0] for r in contamination([r[:2] for r in want], items) if r[5]}
    want = [r for r in want if r[0] not in dirty]
    assert len(rows) > len(kept) > len(one) > len(want) > 100
    want = mixed(want)
    got = corpus_pipeline.run(spark, d)
    assert got.columns == [*COLUMNS, "shard", "slot"]
    got = got.collect()
    assert sorted((r.doc_id, r.text, r.lang, r.source) for r in got) == sorted(want)
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r[0], r[3], r[4]) for r in brute.shards(want))


def test_a_run_leaves_one_table(spark, tmp_path):
    """The written tables of earlier stages are gone; the result's own input stays."""
    rows, items = corpus()
    d = str(tmp_path)
    docs(spark, rows[:60]).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    base = shared_dir(spark).replace("file:", "")
    before = set(os.listdir(base))
    assert corpus_pipeline.run(spark, d).count() > 0
    left = {x.split("-")[0] for x in set(os.listdir(base)) - before}
    assert {x for x in left if not x.startswith("shard")} == {"pipeline_source_mixing"}  # and what the last stage reads


def test_stage_names_and_columns(spark, tmp_path):
    rows, items = corpus()
    d = str(tmp_path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n.split("_")[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "minhash", "winnowing", "source", "hilbert"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs(spark, rows[:40]), d).columns == COLUMNS
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), d).collect() == []
