"""Hilbert sharding against brute force."""
import random

import pytest
from pyspark.sql import functions as F

from lurescope.llm import sharding
from tests.llm import brute
from tests.llm.helpers import awkward, docs, prose
from tests.llm.test_mixing import full


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    got = sharding.shard_table(docs(spark, awkward(), extra))
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got.collect()), key=str) == \
        sorted(brute.shards(full(awkward())), key=str)


def test_runs_of_equal_counts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(60)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(487)]
    rows += [(1000 + i, "same text", "en", "a") for i in range(300)]
    got = sharding.shard_table(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=str) == sorted(brute.shards(rows), key=str)
    counts = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_curve_is_a_walk(spark):
    """Each cell once, and neighbours on the curve are neighbours in space."""
    for n, bits in ((2, 4), (3, 3)):
        cells = spark.range((1 << bits) ** n)
        dims = [F.expr(f"cast(floor(id / {(1 << bits) ** i}) % {1 << bits} as bigint)") for i in range(n)]
        rows = cells.select(sharding.hilbert_index(dims, bits).alias("h"), F.array(*dims).alias("p")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range((1 << bits) ** n))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(x - y) for x, y in zip(a.p, b.p)) == 1
        assert all(r.h == brute.hilbert(r.p, bits) for r in rows)


def test_documents_keep_their_columns(spark):
    out = sharding.shard_documents(docs(spark, awkward()))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert out.count() == len(awkward())


def test_few_rows_and_none(spark):
    assert sharding.shard_table(docs(spark, [])).collect() == []
    assert len({r.shard for r in sharding.shard_table(docs(spark, [(1, "a"), (2, "b"), (3, None)])).collect()}) == 3


def test_written_shards(spark, tmp_path):
    """Files bounded in rows, slots in order, and a filter on a dimension needs a part of the files."""
    rng = random.Random(2)
    sources, langs = [f"s{i}" for i in range(8)], [f"l{i}" for i in range(8)]
    rows = [(i, prose(rng, rng.randrange(1, 80)), rng.choice(langs), rng.choice(sources)) for i in range(2000)]
    path = str(tmp_path / "shards")
    sharding.write_shards(docs(spark, rows), path, 24, 20)
    back = spark.read.parquet(path).withColumn("file", F.input_file_name())
    got = back.collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    files = {}
    for r in got:
        files.setdefault(r.file, []).append(r)
    assert max(len(rs) for rs in files.values()) <= 20
    for rs in files.values():
        slots = sorted(r.slot for r in rs)
        assert len({r.shard for r in rs}) == 1 and slots == list(range(slots[0], slots[0] + len(slots)))
    for column, values in (("source", sources), ("lang", langs)):
        opened = [sum(min(r[column] for r in rs) <= v <= max(r[column] for r in rs) for rs in files.values()) for v in values]
        assert sum(opened) / len(values) < len(files) / 2.5, (column, opened, len(files))
