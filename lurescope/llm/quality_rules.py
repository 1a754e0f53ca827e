"""Quality rules whose thresholds adapt to each language and source.

Every document gets a few integer statistics (symbols, repeated lines, repeated
phrases, word length).  Per (language, source) a mergeable quantile sketch of
each statistic is built: a histogram with logarithmic buckets that are split
into 2**SUB_BITS equal parts, so a quantile is off by at most 1/2**SUB_BITS and
sketches merge by adding counts.  A share's threshold is a high quantile of the
group's sketch plus one bucket, and at most that of the merged sketch of its
language, so a source full of junk can't raise its own limit (nor can a source that
is unlike the rest of its language).  Word length, which every text has, gets the
upper quartile plus FENCE interquartile ranges plus a slack.  Groups with fewer than
MIN_GROUP documents use the merged sketch of their language, or of the whole
corpus.  Documents are then filtered by a join with the thresholds.

Defined results: null or empty text has no words and fails the base rule; null
language or source is a group of its own; an empty table gives no rows; repeated
rows are judged alike (each counts in the sketch).  Every text is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.llm import common as C

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
SUB_BITS = 5
FENCE = 3
MIN_GROUP = 30
#: Share (in 1/10,000) -> its quantile in thousandths.  Most documents have none of these, so
#: quartiles say nothing about them; at most the rest to 1,000 of a language is over its limit.
QUANTILES = {"symbol_share": 950, "dup_line_share": 990, "repeat_share": 990}
#: Slack of the word length's fence, in 1/100 characters.
LENGTH_SLACK = 200
STATISTICS = [*QUANTILES, "word_length"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(windows: Column, ordered: Column) -> Column:
    """Words covered by windows that occur twice or more.

    ``windows``: hash of the window at each start; ``ordered``: the same as
    (hash, start) pairs in order, so equal windows are neighbours.
    """
    same = F.filter(ordered, lambda e, i: F.coalesce(F.get(ordered, i - 1)["h"] == e["h"], F.lit(False))
                    | F.coalesce(F.get(ordered, i + 1)["h"] == e["h"], F.lit(False)))
    starts = F.sort_array(F.transform(same, lambda e: e["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, zero, lambda acc, p: F.struct(
        (acc["n"] + (p + WINDOW - F.greatest(p, acc["end"]))).cast("long").alias("n"), (p + WINDOW).alias("end")),
        lambda acc: acc["n"])
    return F.when(F.size(ordered) == 0, F.lit(0).cast("long")).otherwise(covered)


def with_statistics(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` plus the base counts and the statistics of each text."""
    text = C.text_or_empty(F.col("text"))
    d = docs.select(*carry, F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"),
                    text.alias("_text"), C.space_words(F.col("text")).alias("_words"))
    has_word = lambda line: F.length(F.btrim(line, F.lit(" " + C.SPACE_CHARS))) > 0
    w, i = F.col("_words"), F.size("_words")
    hashes = F.when(i >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), i - WINDOW)), lambda k: F.xxhash64(
        F.get(w, k), F.get(w, k + 1), F.get(w, k + 2)))).otherwise(F.array().cast("array<bigint>"))
    names = [c for c in d.columns if c not in ("_text", "_words")]
    d = d.select(*names, i.cast("long").alias("n_words"),
                 F.length(F.translate("_text", " " + C.SPACE_CHARS, "")).cast("long").alias("word_chars"),
                 (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 F.filter(F.split("_text", "\n"), has_word).alias("_lines"), hashes.alias("_hashes"))
    pairs = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform(
        "_hashes", lambda h, k: F.struct(h.alias("h"), k.alias("i"))))) \
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    names += ["n_words", "word_chars", "n_symbols"]
    d = d.select(*names, F.size("_lines").cast("long").alias("_n_lines"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 "_hashes", pairs.alias("_pairs"))
    d = d.select(*names, "_n_lines", "n_dup_lines", repeated_words(F.col("_hashes"), F.col("_pairs")).alias("n_repeat_words"))
    share = lambda a, b: F.floor(10_000 * F.col(a) / F.greatest(F.lit(1), F.col(b))).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.select(*names, "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    share("n_symbols", "word_chars").alias("symbol_share"),
                    share("n_dup_lines", "_n_lines").alias("dup_line_share"),
                    share("n_repeat_words", "n_words").alias("repeat_share"),
                    F.floor(100 * F.col("word_chars") / F.greatest(F.lit(1), F.col("n_words"))).cast("long").alias("word_length"))


def sketch_bucket(value: Column) -> Column:
    """Largest integer of the value's sketch bucket (exact below 2**(SUB_BITS + 1))."""
    bits = F.when(value > 0, F.length(F.bin(value))).otherwise(0)
    shift = F.greatest(F.lit(0), bits - (SUB_BITS + 1))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return (value - value % step + step - 1).cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """Counts per (language, source, statistic, bucket) over documents that pass the base rule."""
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), sketch_bucket(F.col(s)).alias("bucket")) for s in STATISTICS]))
    return stats.filter(~F.col("base_failed")).select("_lang", "_source", each) \
                .groupBy("_lang", "_source", "stat", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys`` and statistic: number of documents and threshold, from the merged sketch."""
    merged = sketch.groupBy(*keys, "stat", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "stat")
    merged = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    permille = F.element_at(F.create_map(*[F.lit(x) for kv in QUANTILES.items() for x in kv]), F.col("stat"))
    high = F.min(F.when(1000 * F.col("upto") >= permille * F.col("total"), F.col("bucket")))
    out = merged.groupBy(*keys, "stat").agg(F.max("total").alias("docs"), quartile(1).alias("q1"), quartile(3).alias("q3"),
                                            high.alias("high"))
    fence = F.col("q3") + FENCE * (F.col("q3") - F.col("q1")) + LENGTH_SLACK
    return out.select(*keys, "stat", "docs", F.when(F.col("high").isNull(), fence)
                      .otherwise(sketch_bucket(F.col("high") + 1)).alias("fence"))


def thresholds(stats: DataFrame) -> DataFrame:
    """One row per (language, source) with a threshold for each statistic (``max_<statistic>``)."""
    sketch = C.materialize(sketches(stats), "quality_sketch")
    by_group = _fences(sketch, ["_lang", "_source"])
    by_lang = _fences(sketch, ["_lang"]).select(F.col("_lang").alias("l"), F.col("stat").alias("ls"),
                                                F.col("docs").alias("l_docs"), F.col("fence").alias("l_fence"))
    by_all = _fences(sketch, []).select(F.col("stat").alias("as"), F.col("fence").alias("a_fence"))
    t = by_group.join(by_lang, F.col("_lang").eqNullSafe(F.col("l")) & (F.col("stat") == F.col("ls"))) \
                .join(by_all, F.col("stat") == F.col("as"))
    own = F.when(F.col("stat").isin(*QUANTILES), F.least("fence", "l_fence")).otherwise(F.col("fence"))
    fence = F.when(F.col("docs") >= MIN_GROUP, own).when(F.col("l_docs") >= MIN_GROUP, F.col("l_fence")) \
             .otherwise(F.col("a_fence"))
    t = t.groupBy(F.col("_lang").alias("t_lang"), F.col("_source").alias("t_source")).agg(
        *[F.max(F.when(F.col("stat") == s, fence)).alias(f"max_{s}") for s in STATISTICS])
    return C.materialize(t, "quality_thresholds")


def judged(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry``, base counts, ``base_failed`` and ``kept`` per document."""
    stats = C.materialize(with_statistics(docs, carry), "quality_stats")
    limits = thresholds(stats)
    out = stats.join(limits, F.col("_lang").eqNullSafe(F.col("t_lang")) & F.col("_source").eqNullSafe(F.col("t_source")), "left")
    over = F.lit(False)
    for s in STATISTICS:
        over = over | F.coalesce(F.col(s) > F.col(f"max_{s}"), F.lit(False))
    return out.withColumn("kept", ~(F.col("base_failed") | over))


def quality_table(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the statistics behind the verdict."""
    out = judged(docs, [F.col("doc_id").alias("_id")])
    return out.select(F.col("_id").alias("doc_id"), *BASE, "base_failed", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    return C.unpacked(judged(docs, [C.packed(docs)]).filter("kept"), docs)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(C.read(spark, sf_dir, "documents"))
