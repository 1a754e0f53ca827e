"""Sharding along a Hilbert curve over document metadata.

Several metadata dimensions (source, language, size) are quantised to
``BITS`` bits each, their Hilbert index orders the documents, and the order is
cut into runs of equal row counts (law ``rows``).  Neighbouring documents share
most of their metadata, so filters on any of the dimensions prune whole shards
and row groups.  Everything is DataFrame functions: one range-partitioned sort
of the rows, and positions from per-partition counts.

Defined results: null text has no bytes; null source or language is a category
of its own (last); ties in the curve index are ordered by doc_id, then checksum;
repeated rows get neighbouring slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.llm import common as C

SHARDS = 24
BITS = 8
ROW_OVERHEAD = 8
#: Rows of one file that ``write_shards`` writes, at most.
ROWS_PER_FILE = 100_000


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point whose coordinates are integers in [0, 2**bits).

    Folds over the bit planes from the top: rotate / reflect the lower bits of
    the axes, Gray-code the result, and interleave the axes' bits.
    """
    n = len(dims)
    names = [f"x{i}" for i in range(n)]

    def state(cols):
        return F.struct(*[c.alias(k) for k, c in zip(names, cols)])

    def turn(acc, plane):
        q = F.call_function("shiftleft", F.lit(1).cast("long"), plane)
        mask = q - 1
        x = [acc[k] for k in names]
        for i in range(n):
            is_set = x[i].bitwiseAND(q) != 0
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(mask)
            first = F.when(is_set, x[0].bitwiseXOR(mask)).otherwise(x[0].bitwiseXOR(swap))
            if i:
                x[i] = F.when(is_set, x[i]).otherwise(x[i].bitwiseXOR(swap))
            x[0] = first
        return state(x)

    planes = F.array(*[F.lit(b) for b in range(bits - 1, 0, -1)])
    all_planes = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])

    def gray(acc):
        x = [acc[k] for k in names]
        for i in range(1, n):
            x[i] = x[i].bitwiseXOR(x[i - 1])
        last = x[n - 1]
        flip = F.aggregate(planes, F.lit(0).cast("long"), lambda t, b: F.when(
            F.call_function("shiftright", last, b).bitwiseAND(F.lit(1).cast("long")) != 0,
            t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1)).otherwise(t))
        return state([c.bitwiseXOR(flip) for c in x])

    turned = F.aggregate(planes, state([d.cast("long") for d in dims]), turn, gray)

    def weave(acc, plane):
        out = acc["out"]
        for k in names:
            bit = F.call_function("shiftright", acc["p"][k], plane).bitwiseAND(F.lit(1).cast("long"))
            out = out * 2 + bit
        return F.struct(acc["p"].alias("p"), out.alias("out"))

    return F.aggregate(all_planes, F.struct(turned.alias("p"), F.lit(0).cast("long").alias("out")), weave,
                       lambda acc: acc["out"])


def category_codes(rows: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """Order-preserving codes in [0, 2**bits) of a column's distinct values (one row per value)."""
    values = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col(col).asc_nulls_last())
    rank = F.row_number().over(order) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return C.materialize(values.select(F.col(col).alias(f"{col}_value"),
                                       F.floor(rank * (1 << bits) / total).cast("long").alias(f"{col}_code")),
                         f"shard_{col}")


def size_code(size: Column, bits: int = BITS) -> Column:
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(size + 1) * 8)).cast("long")


def curve_sorted(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """Rows with size, checksum, global position ``pos`` along the curve and the row count ``n``."""
    text = C.text_or_empty(F.col("text"))
    rows = docs.select(*carry, F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"),
                       F.col("lang").cast("string").alias("_lang"),
                       (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("_size"),
                       F.crc32(text.cast("binary")).alias("_crc"))
    for c in ("_source", "_lang"):
        codes = category_codes(rows, c)
        rows = rows.join(codes, F.col(c).eqNullSafe(F.col(f"{c}_value")))
    curve = hilbert_index([F.col("_source_code"), F.col("_lang_code"), size_code(F.col("_size"))])
    kept = [c for c in rows.columns if not c.endswith(("_value", "_code"))]
    ordered = rows.select(*kept, curve.alias("_curve")).orderBy("_curve", "_id", "_crc") \
                  .withColumn("_seq", F.monotonically_increasing_id())
    ordered = C.materialize(ordered, "shard_rows").withColumn("_part", F.shiftright("_seq", 33))
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.orderBy("_part")  # one row per sort partition
    offsets = C.materialize(parts.select(F.col("_part").alias("p"), (F.sum("rows").over(upto) - F.col("rows")).alias("before"),
                                         F.sum("rows").over(Window.partitionBy()).alias("n")), "shard_offsets")
    low = F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(offsets, F.col("_part") == F.col("p")).withColumn("pos", F.col("before") + low)


def assigned(rows: DataFrame, shards: int) -> list[Column]:
    """Shard and slot: runs of floor or ceil(n / shards) rows of the curve order."""
    shard = F.floor(F.col("pos") * shards / F.col("n"))
    # integer correction of the division's rounding
    start = lambda s: F.floor((s * F.col("n") + shards - 1) / shards)
    shard = F.when(F.col("pos") < start(shard), shard - 1).when(F.col("pos") >= start(shard + 1), shard + 1).otherwise(shard)
    return [shard.cast("int").alias("shard"), (F.col("pos") - start(shard)).cast("long").alias("slot")]


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index per document."""
    rows = curve_sorted(docs, [])
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                       F.lit("rows").alias("law"), *assigned(rows, shards),
                       F.lit(None).cast("int").alias("grown_shard"), F.col("_curve").alias("curve"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with their columns plus ``shard`` and ``slot``; rows are sorted along the curve."""
    rows = curve_sorted(docs, [C.packed(docs)])
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    return rows.select(*[F.col(f"_row.`{c}`") for c in names], *assigned(rows, shards))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = ROWS_PER_FILE) -> None:
    """The shards as Parquet below ``path``, a folder each, in files of neighbours on the curve of at most ``rows_per_file`` rows.

    Ranges of (shard, slot) are dealt to the tasks, so a large shard is written by several.
    """
    rows = shard_documents(docs, shards)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(C.read(spark, sf_dir, "documents"))
