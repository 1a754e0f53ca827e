"""Small document tables with the awkward cases every operator must handle."""
from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int, vocab: int = 400) -> str:
    words = []
    for _ in range(n):
        w = "w" + str(rng.randrange(vocab)) if rng.random() < .9 else "Übung" + str(rng.randrange(30))
        words.append(w + ("." if rng.random() < .1 else ""))
    text = " ".join(words)
    return text.replace(". ", ".\n", 3)


def docs(spark, rows, extra: bool = False):
    """rows: (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F
        for name in ("size", "key", "n", "rep", "shard", "slot", "label", "score", "rank", "hits", "kept", "bucket", "items", "n_words"):
            df = df.withColumn(name, F.lit("x"))
    return df


def awkward(seed: int = 5):
    """Nulls, empties, whitespace, one word, a long text, copies, repeated rows."""
    rng = random.Random(seed)
    a, b = prose(rng, 120), prose(rng, 300)
    near = a.split(" ")
    near[60] = "changed"
    return [(1, a), (2, a, "en", "src1"), (3, " ".join(near)), (4, b), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "one"),
            (10, prose(rng, 6000, 5000)), (11, "x" * 900), (12, "ab" * 700), (13, b[:700] + " " + a), (14, "two words", None, None),
            (15, "Été à la plage " * 40), (16, a + "\n" + a), (4, b), (None, prose(rng, 60)), (17, prose(rng, 80), "de", None)]
