"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of an item (all of a shorter item).  Of
every window the least hash of its word k-grams is kept as its fingerprint; equal
windows have equal fingerprints, so every shared span of at least a window is
found.  Documents keep their fingerprints as runs (neighbouring windows mostly
share one), a semi join with the items' fingerprints leaves the runs that may
match, and only those are extended: their windows are written out and joined
with the items' windows on the words themselves.  DataFrame functions only.

Defined results: null or empty texts have no words and no hits; items without
words have no windows; items that repeat count by their distinct item_id; rows
that repeat get equal results; an empty table on either side gives no hits;
a null item_id is left out of the item list; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm import common as C

WINDOW = 10


def word_array(text: Column) -> Column:
    normal = C.normal_words(text)
    return F.when(normal != "", F.split(normal, " ")).otherwise(F.array().cast("array<string>"))


def _least_hashes(words: Column, width: int) -> Column:
    """Per window start the least k-gram hash of the window of ``width`` words."""
    k = (width + 1) // 2
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - k)),
                        lambda i: F.xxhash64(F.lit(width), *[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= width, grams).otherwise(F.array().cast("array<bigint>"))


def _window_minima(grams: Column, span: int) -> Column:
    least = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(grams) - span + 1)),
                        lambda i: F.array_min(F.slice(grams, i, span)))
    return F.when(F.size(grams) > 0, least).otherwise(F.array().cast("array<bigint>"))


def _run_starts(least: Column) -> Column:
    return F.filter(F.transform(least, lambda m, i: i), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))


def _runs(starts: Column, least: Column, width: int) -> Column:
    return F.transform(starts, lambda s, i: F.struct(
        F.get(least, s).alias("print"), F.lit(width).alias("width"), s.alias("first"),
        (F.coalesce(F.get(starts, i + 1), F.size(least)) - 1).alias("last")))


def with_runs(df: DataFrame, carry: list[str], widths: list[int]) -> DataFrame:
    """``carry`` plus ``runs``: (fingerprint, width, first window, last window) of each text's ``_words``."""
    names = [*carry, "_words"]
    df = df.select(*names, *[_least_hashes(F.col("_words"), w).alias(f"_g{w}") for w in widths])
    df = df.select(*names, *[_window_minima(F.col(f"_g{w}"), w - (w + 1) // 2 + 1).alias(f"_m{w}") for w in widths])
    df = df.select(*names, *[F.col(f"_m{w}") for w in widths], *[_run_starts(F.col(f"_m{w}")).alias(f"_s{w}") for w in widths])
    return df.select(*names, F.flatten(F.array(*[_runs(F.col(f"_s{w}"), F.col(f"_m{w}"), w) for w in widths])).alias("runs"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, width, words of the window) of all items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("_words")) \
                     .filter(F.size("_words") > 0).withColumn("width", F.least(F.size("_words"), F.lit(WINDOW)))
    texts = F.transform(F.sequence(F.lit(1), F.size("_words") - F.col("width") + 1),
                        lambda s: F.array_join(F.slice(F.col("_words"), s, F.col("width")), " "))
    return items.select("item_id", "width", F.explode_outer(F.array_distinct(texts)).alias("window"))


def _keyed(docs: DataFrame, carry: list[Column]) -> DataFrame:
    return docs.select(*carry, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"),
                       F.xxhash64(C.text_or_empty(F.col("text")), F.col("doc_id")).alias("_th"), F.col("text").alias("_text"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per hit document key: hit words, and the distinct items found."""
    windows = C.materialize(item_windows(benchmark), "winnow_windows")
    widths = sorted(r.width for r in windows.select("width").distinct().collect())  # at most WINDOW values
    if not widths:
        widths = [WINDOW]
    # the same code fingerprints both sides
    own = windows.select("window", F.split("window", " ").alias("_words"))
    own = with_runs(own, ["window"], widths).select(F.inline_outer("runs"), F.size("_words").alias("n")).filter("width = n")
    prints = C.materialize(own.select(F.col("print").alias("p")).distinct(), "winnow_prints")
    keyed = _keyed(docs, []).select("_id", "_th", word_array(F.col("_text")).alias("_words"))
    # outer: the inner form adds a filter on the array's size, which is pushed down with all that makes the array
    runs = with_runs(keyed, ["_id", "_th"], widths).select("_id", "_th", F.inline_outer("runs"))
    matching = runs.join(prints, F.col("print") == F.col("p"), "left_semi")
    found = matching.groupBy("_id", "_th").agg(F.collect_set(F.struct("width", "first", "last")).alias("found"))
    found = C.materialize(found, "winnow_found")
    # extend: the words of the windows in those runs; hits grow with the corpus, so the texts move (once), not
    # a copy of all hits to each task, and only texts with hits are split again
    texts = F.flatten(F.transform("found", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda s: F.struct(
        s.alias("start"), r["width"].alias("width"), F.array_join(F.slice(F.col("_words"), s + 1, r["width"]), " ").alias("text")))))
    again = _keyed(docs, []).join(found.hint("shuffle_hash"), ["_id", "_th"]) \
                            .select("_id", "_th", "found", word_array(F.col("_text")).alias("_words"))
    spelled = again.select("_id", "_th", F.inline_outer(texts))
    same = spelled.join(windows.drop("width"), F.col("text") == F.col("window"))
    per_doc = same.groupBy("_id", "_th").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end")))).alias("places"),
        F.sort_array(F.collect_set("item_id")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("places", zero, lambda acc, p: F.struct(
        (acc["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(p["start"], acc["upto"]))).cast("long").alias("n"),
        F.greatest(p["end"], acc["upto"]).alias("upto")), lambda acc: acc["n"])
    return C.materialize(per_doc.select(F.col("_id").alias("h_id"), F.col("_th").alias("h_th"), covered.alias("n_hit"), "items"), "winnow_hits")


def _joined(keyed: DataFrame, found: DataFrame, how: str) -> DataFrame:
    return keyed.join(found, (F.col("_id") == F.col("h_id")) & (F.col("_th") == F.col("h_th")), how)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    found = hits(docs, benchmark)
    normal = C.normal_words(F.col("_text"))
    spaces = F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit("")))
    keyed = _keyed(docs, [F.col("doc_id").alias("_doc")]) \
        .withColumn("_n", F.when(normal == "", 0).otherwise(spaces + 1).cast("long")).drop("_text")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return _joined(keyed, found, "left").select(
        F.col("_doc").alias("doc_id"), F.col("_n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with the columns of ``docs``."""
    found = hits(docs, benchmark).select("h_id", "h_th")
    keyed = _keyed(docs, [C.packed(docs)]).drop("_text")
    return C.unpacked(_joined(keyed, found, "left_anti"), docs)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
