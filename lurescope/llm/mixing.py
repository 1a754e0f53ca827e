"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words (weights shared out under a cap of
``max_epochs`` times its size).  Within a source every document has an
exponential key ``-ln(u) / w`` with ``w`` its quality weight, and documents are
taken by ascending key: whole epochs first, then the prefix of the key order
that fills what is left of the target.

The prefix sum never sorts a whole source.  ``ln(key)`` of an Exp(w) variable
has a density of at most 1/e whatever w is, so equal-width buckets of it hold a
bounded share of a source's rows; bucket totals give the one bucket in which
the target is crossed, and only its rows are ordered.

Defined results: null text has size 0 and weight 1; null source is a source of
its own, last in order; an empty table gives no rows; rows that repeat share
their key and are treated alike (a budget that ends in such a tie is divided
evenly, rounded down); sources of size 0 have target 0.  Extra columns are
ignored by ``mix`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.llm import common as C

SEED = 17
SOURCE_WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Expected upper bound of rows that are ordered for one source.
ROWS_PER_BUCKET = 10_000
MIN_WEIGHT = 0.05
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """1 for plain prose, falling with the share of symbol characters, at least MIN_WEIGHT."""
    t = C.text_or_empty(text)
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return F.greatest(F.lit(MIN_WEIGHT), 1 - 4 * symbols / F.greatest(F.lit(1), F.length(t)))


def scored(docs: DataFrame, seed: int = SEED) -> list[Column]:
    """The sampling columns of a document: size, exponential key, tie-break id."""
    size = F.regexp_count(C.text_or_empty(F.col("text")), F.lit(C.WORD_PATTERN)).cast("long")
    u = C.unit_hash(F.lit(seed), F.col("doc_id"))
    return [F.col("source").cast("string").alias("source"), size.alias("size"),
            F.greatest(F.lit(1e-18), -F.log(u) / quality_weight(F.col("text"))).alias("key"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("tie")]


def source_targets(rows: DataFrame, weights=SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: size, target, whole epochs and the words left for the fractional one.

    Water-filling: sources are capped in the order of cap / weight, and what is
    left is shared by weight.  All sums are exact integers.
    """
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")).cast("long")
    src = src.withColumn("w", w).withColumn("cap", max_epochs * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()) \
                   .rowsBetween(Window.unboundedPreceding, -1)
    src = (src.withColumn("total", F.sum("source_size").over(everything))
              .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
              .withColumn("t_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("w") * F.col("t_left")))
    free_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    free_t = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    src = src.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double"))
                         .otherwise((F.col("w") * free_t).cast("double") / free_w))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (src.withColumn("epochs", F.least(epochs, F.lit(max_epochs)).cast("long"))
               .withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
               .withColumn("grain", F.greatest(F.lit(16), F.ceil(0.4 * F.col("n") / ROWS_PER_BUCKET)))
               .select("source", "source_size", "target", "epochs", "budget", "grain"))


def cut_points(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the (key, tie) at which the fractional epoch ends, and the words each row there may give."""
    t = targets.withColumnRenamed("source", "t_source")
    bucketed = rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))) \
                   .withColumn("bucket", F.floor(F.log("key") * F.col("grain")))
    per_bucket = bucketed.groupBy("t_source", "bucket", "budget").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("t_source").orderBy("bucket")
    crossing = (per_bucket.withColumn("after", F.sum("words").over(upto))
                .filter((F.col("after") >= F.col("budget")) & (F.col("after") - F.col("words") < F.col("budget")))
                .select(F.col("t_source").alias("c_source"), F.col("bucket").alias("c_bucket"),
                        (F.col("after") - F.col("words")).alias("passed")))
    inside = (bucketed.join(crossing, F.col("t_source").eqNullSafe(F.col("c_source"))
                            & (F.col("bucket") == F.col("c_bucket")))
              .groupBy("t_source", "key", "tie", "budget", "passed")
              .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    order = Window.partitionBy("t_source").orderBy("key", "tie")
    return (inside.withColumn("after", F.col("passed") + F.sum("words").over(order))
            .filter((F.col("after") >= F.col("budget")) & (F.col("after") - F.col("words") < F.col("budget")))
            .select(F.col("t_source").alias("c_source"), F.col("key").alias("cut_key"), F.col("tie").alias("cut_tie"),
                    F.floor((F.col("budget") - F.col("after") + F.col("words")) / F.col("rows")).alias("part")))


def plan_mix(docs: DataFrame, weights=SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED):
    """(narrow scored rows, one row per source with target and cut point), both written tables."""
    rows = C.materialize(docs.select("doc_id", *scored(docs, seed)), "mix_rows")
    targets = C.materialize(source_targets(rows, weights, max_epochs), "mix_targets")
    cuts = cut_points(rows, targets)
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source") \
                  .withColumnRenamed("source", "p_source")
    return rows, C.materialize(plan, "mix_plan")


def _fraction(size: Column) -> Column:
    """Words of the last, fractional epoch."""
    below = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") < F.col("cut_tie")))
    at = (F.col("key") == F.col("cut_key")) & (F.col("tie") == F.col("cut_tie"))
    return F.when(F.col("cut_key").isNull(), F.lit(0)).when(below, size) \
            .when(at, F.least(size, F.col("part"))).otherwise(F.lit(0))


def mix(docs: DataFrame, weights=SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per document its source's size and target and the words the mix takes of it.

    The document at the end of the fractional epoch gives only the words that
    fill the target, so a source's taken words are its target to the word.
    """
    rows, plan = plan_mix(docs, weights, max_epochs, seed)
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + _fraction(F.col("size"))).cast("long").alias("taken"),
                      F.col("epochs").cast("int").alias("epochs"))


def mix_documents(docs: DataFrame, weights=SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    Texts stay whole: a row per time that a document is taken; the document at
    the end of the fractional epoch is taken if at least half of it fits.
    """
    _, plan = plan_mix(docs, weights, max_epochs, seed)
    d = docs.select(C.packed(docs), *scored(docs, seed))
    out = d.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    size = F.col("size")
    copies = F.col("epochs") + F.when((size > 0) & (2 * _fraction(size) >= size), 1).otherwise(0)
    out = out.withColumn("_times", copies.cast("int")).filter("_times > 0") \
             .withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return C.unpacked(out, docs)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.read(spark, sf_dir, "documents"))
