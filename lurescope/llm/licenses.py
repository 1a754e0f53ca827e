"""License scan with ordered signature rules.

A text is reduced to its lower-case words joined by single spaces.  Keywords
decide which rules may match (most texts hold none and are done); the matches
of the rest are intervals of the word string.  A match inside another match of
a better priority, or of the same priority and at least as long, is suppressed,
which one sorted pass with running maxima per priority decides.  What is left
gives the labels.  DataFrame functions only; the rule table has a fixed size.

Defined results: null text is empty, has no words and no labels; the base
phrases are counted wherever their words stand next to each other, whether or
not a rule covers them; rows that repeat get equal results; empty tables give
no rows; extra columns are ignored.  Texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.llm import common as C
from lurescope.llm.license_rules import rules

#: Base phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_SCORE = 0.7
PRIORITIES = (0, 1, 2, 3)


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def base_columns(words: Column, n_words: Column) -> list[Column]:
    """n_base, first_word, last_word and the base labels of a space-joined word string."""
    phrase = r"(?<![^ ])(?:" + "|".join(BASE) + r")(?![^ ])"
    any_hit = F.lit(False)
    for p in BASE:
        any_hit = any_hit | F.contains(words, F.lit(p))
    found = F.regexp_extract_all(words, F.lit(phrase), F.lit(0))
    gaps = F.split(words, phrase, -1)
    last_words = _spaces(F.element_at(found, -1)) + 1
    n = F.when(any_hit, F.size(found)).otherwise(0).cast("long")
    has = any_hit & (F.size(found) > 0)
    labels = F.array_sort(F.array_compact(F.array(*[
        F.when(any_hit & F.array_contains(found, p), F.lit(label)) for p, label in BASE.items()])))
    return [n.alias("n_base"), F.when(has, _spaces(F.get(gaps, F.lit(0)))).cast("long").alias("first_word"),
            F.when(has, n_words - _spaces(F.element_at(gaps, -1)) - last_words).cast("long").alias("last_word"),
            labels.alias("base")]


def rule_table(spark: SparkSession) -> DataFrame:
    names = ("rule", "label", "keyword", "priority", "weight", "pattern")
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in zip(names, r)]) for r in rules()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def detections(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """(_id, _th, label, weight) of the matches that are not suppressed; ``texts``: _id, _th, words."""
    table = rule_table(spark)
    keywords = sorted({r[2] for r in rules()})
    padded = F.concat(F.lit(" "), F.col("words"))
    # whole-word start, any end: the rule itself checks word ends
    present = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(" " + k)), F.lit(k)) for k in keywords]))
    gated = texts.withColumn("present", present).withColumn("kw", F.explode_outer("present")).filter("kw is not null").drop("present")
    tried = gated.join(F.broadcast(table), F.col("kw") == F.col("keyword")).filter(F.rlike("words", "pattern"))
    found = F.regexp_extract_all("words", "pattern", F.lit(0))
    gaps = F.split("words", F.col("pattern"), -1)
    each = tried.select("_id", "_th", "rule", "label", "priority", "weight", F.posexplode_outer(F.transform(
        found, lambda m, i: F.struct(F.length(m).alias("len"), F.length(F.get(gaps, i)).alias("gap")))).alias("i", "m"))
    each = C.materialize(each.select("_id", "_th", "rule", "label", "priority", "weight", "i", "m.*"), "license_matches")
    each = each.dropDuplicates()  # rows that repeat have the same matches; they would add up below
    order = Window.partitionBy("_id", "_th", "rule").orderBy("i")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    doc = Window.partitionBy("_id", "_th").orderBy("start", F.col("end").desc(), "priority", "rule") \
                .rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(None).cast("long")
    for p in PRIORITIES:
        covered = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end"))).over(doc)).otherwise(covered)
    each = each.withColumn("covered", F.coalesce(covered, F.lit(-1)))
    return each.filter("covered < end").select("_id", "_th", "label", "weight")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base columns, labels and score per document."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"),
                        F.xxhash64(C.text_or_empty(F.col("text")), F.col("doc_id")).alias("_th"),
                        C.normal_words(F.col("text")).alias("words"))
    named = detections(keyed.select("_id", "_th", "words"), spark).groupBy("_id", "_th") \
        .agg(F.collect_set("label").alias("more"), F.max("weight").alias("weight"))
    named = C.materialize(named, "license_labels").withColumnRenamed("_id", "l_id").withColumnRenamed("_th", "l_th")
    n = F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long")
    base = keyed.withColumn("n_words", n)
    base = base.select("_doc", "_id", "_th", "n_words", *base_columns(F.col("words"), F.col("n_words")))
    out = base.join(named, (F.col("_id") == F.col("l_id")) & (F.col("_th") == F.col("l_th")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(0.0))
    return out.select(F.col("_doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                      score.cast("double").alias("score"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents"))
