"""Clusters of 64-dimensional vectors by exact Lloyd rounds with a Walsh-Hadamard search.

A vector's components become integers, and the vector is stored as its integer
Walsh-Hadamard transform with the coefficients in order of sequency (sign
changes), so the coarse ones come first.  The unnormalised transform H keeps
distances up to a factor: |Hx - Hc|^2 = 64 |x - c|^2.  A search adds squared
coefficient differences level by level; sums only grow, so a centroid whose sum
is already above the whole distance of the leader (the best one of the first
level, finished at once) is strictly worse and is dropped.  Those that are left
after all 64 coefficients have their exact distance; ties take the smaller number.

H is linear, so a round sums the transformed vectors per cluster (within each
task first, then 65 rows a cluster), and the new centroid is read from H^-1 of
the sums.  Only the centroids (a fixed number) are ever on the driver.

Defined results: vectors that are null, of another length, or with a null or
non-finite component are left out; rows that repeat count as often as they
occur; a null id starts a centroid only when no other vector is left; fewer vectors
than centroids give as many centroids as vectors; an empty table gives no rows;
extra columns are ignored.  Coefficients beyond 27 bits are computed without a bound
on their size; a component of 2**56 or more, or a distance beyond a long, is an
error, never a wrong row.
"""

from __future__ import annotations

import decimal
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm import common as C

SIZE = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
#: Coefficients after which centroids are dropped; the last level has all 64.
LEVELS = (4, 8, 16, 32, 64)
#: Largest transformed coefficient whose 64 squared differences add up within 63 bits.
NARROW = 1 << 27
LARGEST = 1 << 56


def transform(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows, coefficients by sequency."""
    x = x.copy()
    h = 1
    while h < SIZE:
        y = x.reshape(len(x), SIZE // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), SIZE)
        h *= 2
    return x[:, SEQUENCY]


def _sequency() -> np.ndarray:
    h = np.array([[1]])
    while len(h) < SIZE:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")


SEQUENCY = _sequency()


def inverse_sums(totals: list[int]) -> list[int]:
    """The sums of the components from the sums of the coefficients (Python integers, exact)."""
    natural = np.zeros(SIZE, object)
    natural[SEQUENCY] = totals
    back = transform(natural.reshape(1, SIZE))[0]  # H is its own inverse up to the factor 64
    out = np.zeros(SIZE, object)
    out[SEQUENCY] = back
    return [int(v) // SIZE for v in out]


def nearest(w: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and 64 times the squared distance, for each row of ``w``."""
    if len(w) and max(np.abs(w).max(), np.abs(centroids).max()) > NARROW:
        w, centroids = w.astype(object), centroids.astype(object)
    wide = w.dtype == object
    at = np.arange(len(w))
    first = LEVELS[0]
    partial = ((w[:, None, :first] - centroids[None, :, :first]) ** 2).sum(axis=2)
    leader = partial.argmin(axis=1)
    bound = partial[at, leader] + ((w[:, first:] - centroids[leader, first:]) ** 2).sum(axis=1)
    row, number = np.nonzero((partial <= bound[:, None]).astype(bool))
    total = partial[row, number]
    for low, high in zip(LEVELS, LEVELS[1:]):
        total = total + ((w[row, low:high] - centroids[number, low:high]) ** 2).sum(axis=1)
        left = (total <= bound[row]).astype(bool)
        row, number, total = row[left], number[left], total[left]
    whole = np.full((len(w), len(centroids)), 1 << 200 if wide else np.iinfo(np.int64).max, object if wide else np.int64)
    whole[row, number] = total
    best = whole.argmin(axis=1)  # the first of equal ones
    return best, whole[at, best]


def _kept(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = vectors.filter(v.isNotNull() & (F.size(v) == SIZE)).filter(~bad)
    integers = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return whole.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), integers.alias("q"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), SIZE)


def _transform_rows(batches):
    for batch in batches:
        q = _matrix(batch.column("q"))
        if len(q) and max(int(q.max()), -int(q.min())) >= LARGEST:
            raise ArithmeticError("a component is too large: its transform does not fit a long")
        w = transform(q)
        values = pa.array(w.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, SIZE), pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "w"])


def transformed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, w``: the kept vectors' transforms, written to the shared folder once for all rounds."""
    kept = _kept(vectors, id_col, vector_col)
    return C.materialize(kept.mapInArrow(_transform_rows, "vec_id long, w array<long>"), "centroid_vectors")


def seeds(w: DataFrame, clusters: int = CLUSTERS, salt: str = "3") -> list[list[int]]:
    """The vectors with the smallest SHA-256 of ``salt:vec_id`` as integer components, in that order."""
    key = F.sha2(F.concat(F.lit(salt + ":"), F.col("vec_id").cast("string")), 256)
    rows = w.orderBy(key.asc_nulls_last(), "w").limit(clusters).collect()
    return [inverse_sums(list(r.w)) for r in rows]


def _centroid_rows(centroids: list[list[int]]) -> np.ndarray:
    big = max((abs(x) for c in centroids for x in c), default=0) >= LARGEST
    return transform(np.array(centroids, object if big else np.int64).reshape(len(centroids), SIZE))


def _partial_sums(centroids: list[list[int]]):
    """(cluster, at, total, rows): sums of a task's coefficients per cluster; ``at`` SIZE has the distances."""
    def rows(batches):
        c = _centroid_rows(centroids)
        sums, count = np.zeros((len(c), SIZE + 1), object), [0] * len(c)
        for batch in batches:
            w = _matrix(batch.column("w"))
            best, total = nearest(w, c)
            wide = len(w) and np.abs(w).max() > NARROW
            for k in np.unique(best):
                own = best == k
                count[k] += int(own.sum())
                sums[k, :SIZE] += [int(x) for x in (w[own].astype(object) if wide else w[own]).sum(axis=0)]
                sums[k, SIZE] += sum(int(x) for x in total[own]) // SIZE
        cells = [(k, i, decimal.Decimal(int(sums[k, i])), count[k]) for k in range(len(c)) if count[k] for i in range(SIZE + 1)]
        cols = list(zip(*cells)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["cluster", "at", "total", "rows"])
    return rows


def _sums(w: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (rows, 64 sums of coefficients and the sum of distances); 65 rows a cluster come to the driver."""
    cells = w.select("w").mapInArrow(_partial_sums(centroids), "cluster int, at int, total decimal(38,0), rows long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in cells.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("rows").alias("n")).collect():
        out.setdefault(r.cluster, (r.n, [0] * (SIZE + 1)))[1][r["at"]] = int(r.total)
    return out


def fit(w: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "3") -> list[list[int]]:
    """The centroids after ``rounds`` rounds; an empty cluster keeps its centroid."""
    centroids = seeds(w, clusters, salt)
    if not centroids:
        return []
    for _ in range(rounds):
        sums = _sums(w, centroids)
        new = [[s // sums[k][0] for s in inverse_sums(sums[k][1][:SIZE])] if k in sums else c for k, c in enumerate(centroids)]
        if new == centroids:
            break  # every further round would repeat this one
        centroids = new
    return centroids


def _assign_rows(centroids: list[list[int]]):
    def rows(batches):
        c = _centroid_rows(centroids)
        for batch in batches:
            best, total = nearest(_matrix(batch.column("w")), c)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()),
                                              pa.array([int(x) // SIZE for x in total], pa.int64())], ["vec_id", "cluster", "distance"])
    return rows


def assign(w: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance`` (squared) for every vector."""
    return w.mapInArrow(_assign_rows(centroids), "vec_id long, cluster int, distance long")


def _per_cluster(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` for every kept vector."""
    w = transformed(vectors, id_col, vector_col)
    centroids = fit(w, clusters, rounds)
    if not centroids:
        return w.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")],
                        F.array().cast("array<long>").alias("centroid"))
    sums = _sums(w, centroids)
    inertia = [sums[k][1][SIZE] if k in sums else 0 for k in range(len(centroids))]
    return assign(w, centroids).select(
        "vec_id", "cluster", "distance", _per_cluster(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), _per_cluster(centroids).cast("array<long>").alias("centroid"))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(C.read(spark, sf_dir, "embeddings"))
    text = F.concat_ws(",", F.col("centroid").cast("array<string>"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))
