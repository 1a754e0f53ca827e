"""Decontamination against brute force over all windows."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lurescope.llm import winnowing
from tests.llm.helpers import awkward, docs, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(rows, items):
    out = []
    for r in rows:
        w, hit, ids = words(r[1]), set(), set()
        for item, text in items:
            iw = words(text)
            m = min(10, len(iw))
            for s in range(len(iw) - m + 1 if iw else 0):
                for at in range(len(w) - m + 1):
                    if w[at:at + m] == iw[s:s + m]:
                        hit.update(range(at, at + m))
                        ids.add(item)
        names = sorted(str(i) for i in ids if i is not None)
        out.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, items, extra=False):
    bench = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        bench = bench.withColumn("window", F.lit("x")).withColumn("width", F.lit(1))
    got = winnowing.contamination(docs(spark, rows, extra), bench)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus():
    rng = random.Random(11)
    items = [(i, prose(rng, 30 + i, 3000)) for i in range(8)]
    items += [(100, items[0][1]), (101, "Two words"), (102, ""), (103, None), (104, "Übung3"), (105, " ".join(items[1][1].split()[:12])),
              (106, "a b c d e f g h i"), (106, "x y z")]
    rows = awkward()
    rows += [(200 + i, prose(rng, 40) + " " + items[i % 8][1].upper().replace(" ", " - ") + "\n" + prose(rng, 20)) for i in range(10)]
    rows += [(300, " ".join(items[2][1].split()[5:14])), (301, " ".join(items[2][1].split()[5:15])), (302, items[3][1] + " " + items[3][1]),
             (303, "q a b c d e f g h i r"), (304, " ".join(["rep"] * 50)), (305, None)]
    return rows, [*items, (107, " ".join(["rep"] * 25))]


@pytest.mark.parametrize("extra", [False, True])
def test_all_windows(spark, extra):
    rows, items = corpus()
    assert run(spark, rows, items, extra) == brute(rows, items)


def test_only_long_items(spark):
    rows, items = corpus()
    items = [i for i in items if len(words(i[1])) >= 10]
    assert run(spark, rows, items) == brute(rows, items)


def test_empty_tables(spark):
    rows, items = corpus()
    assert run(spark, [], items) == []
    assert run(spark, rows, []) == brute(rows, [])


def test_clean_documents_stay_whole(spark):
    rows, items = corpus()
    clean = winnowing.clean_documents(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = sorted((str(b[0]) for b in brute(rows, items) if not b[5]))
    assert sorted(str(r.doc_id) for r in clean.collect()) == want
