"""Centroid clustering against plain Lloyd rounds over Python integers."""
import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescope.llm import centroids as M

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(rows):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    def start(r):
        return (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cent = [q for _, q in sorted(kept, key=start)[:8]]
    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(cent))
    for _ in range(10):
        own = [near(q)[1] for _, q in kept]
        for k in range(len(cent)):
            mine = [q for (_, q), o in zip(kept, own) if o == k]
            if mine:
                cent[k] = [sum(x) // len(mine) for x in zip(*mine)]
    best = [near(q) for _, q in kept]
    total = [sum(d for d, c in best if c == k) for k in range(len(cent))]
    return sorted(((i, k, d, total[k], sum(total), hashlib.sha256(",".join(map(str, cent[k])).encode()).hexdigest())
                   for (i, _), (d, k) in zip(kept, best)), key=str)


def run(df):
    out = M.cluster(df)
    out = out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(n, seed=3, spread=0.2):
    rng = random.Random(seed)
    mid = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [float(np.float32(m + rng.gauss(0, spread))) for m in mid[rng.randrange(6)]]) for i in range(n)]


def test_same_as_plain_rounds(spark):
    rows = vectors(300)
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_awkward_rows(spark):
    good = vectors(40, 4)
    bad = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] + [0.1] * 63)]
    rows = good + bad + good[:7] + [good[0]] * 30 + [(None, good[1][1]), (906, [0.0] * 64), (907, [0.0] * 64), (908, [-0.00001] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("w", F.lit("x")).withColumn("cluster", F.lit("y")).withColumn("q", F.lit(1))
    assert run(df) == brute(rows)


def test_few_vectors_ties_and_none(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    three = vectors(3)
    assert run(spark.createDataFrame(three, SCHEMA)) == brute(three)
    same = [(i, [0.25] * 64) for i in range(20)]  # all centroids tie; the smallest number takes all
    got = run(spark.createDataFrame(same, SCHEMA))
    assert got == brute(same) and {r[1] for r in got} == {0}


def test_large_components(spark):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 10 ** rng.choice([1, 4, 5]))) for _ in range(64)]) for i in range(30)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_transform_keeps_distances_and_inverts():
    rng = np.random.RandomState(0)
    x, c = rng.randint(-3000, 3000, (50, 64)), rng.randint(-3000, 3000, (8, 64))
    assert (((M.transform(x)[:, None] - M.transform(c)) ** 2).sum(2) == 64 * ((x[:, None] - c) ** 2).sum(2)).all()
    assert M.inverse_sums(M.transform(x).sum(0).tolist()) == x.sum(0).tolist()
    h = M.transform(np.eye(64, dtype=np.int64)).T
    changes = (h[:, 1:] != h[:, :-1]).sum(axis=1)
    assert changes.tolist() == list(range(64))  # coarse to fine


def test_search_drops_only_strictly_worse():
    rng = np.random.RandomState(1)
    x, c = rng.randint(-9, 9, (400, 64)), rng.randint(-9, 9, (8, 64))
    c[5] = c[2]
    best, total = M.nearest(M.transform(x), M.transform(c))
    d = ((x[:, None] - c) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (total == 64 * d.min(1)).all()
