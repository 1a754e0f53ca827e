"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.session import register_scratch, scratch_path

#: Fixed values of the word contracts (bytes 0x09-0x0D and 0x20 separate words).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = "\t\n\x0b\x0c\r"
#: ASCII letters and digits (after lower-casing A-Z) and everything non-ASCII.
ALNUM_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (``spark.checkpoint.dir``), read back.

    Cuts the lineage, survives lost executors, and shows the planner the real
    size.  The shuffle files of the write are removed when it is done, so the
    disk holds one step's shuffles at a time.  Inside a ``scratch_scope`` the table is
    deleted at its end.
    """
    path = scratch_path(df.sparkSession, name)
    register_scratch(path)
    return write_table(df, path)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back; the caller deletes it."""
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, by a path that only Spark needs to be able to open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def space_words(text: Column) -> Column:
    """Words between bytes 0x09-0x0D / 0x20, in order; null text has none."""
    spaced = F.translate(text_or_empty(text), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.array_remove(F.split(spaced, " "), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other alphabets)."""
    return F.translate(text_or_empty(text), UPPER, LOWER)


def normal_words(text: Column) -> Column:
    """The lower-cased alphanumeric words joined by single spaces."""
    return F.btrim(F.regexp_replace(lower_ascii(text), ALNUM_GAP_PATTERN, " "))


def unit_hash(*parts: Column) -> Column:
    """Uniform in (0, 1]: 52 bits of an MD5 over the parts joined by '|' (null: empty)."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double")
    return (bits + 1) / F.lit(float(1 << 52))


def packed(docs: DataFrame, name: str = "_row") -> Column:
    """All columns of ``docs`` as one struct, so added names can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def unpacked(df: DataFrame, docs: DataFrame, name: str = "_row") -> DataFrame:
    return df.select(*[F.col(f"{name}.`{c}`") for c in docs.columns])


__all__ = ["ALNUM_GAP_PATTERN", "ALNUM_PATTERN", "LOWER", "SPACE_CHARS", "UPPER", "WORD_PATTERN", "lower_ascii",
           "materialize", "normal_words", "packed", "read", "space_words", "text_or_empty", "unit_hash", "unpacked", "write_table"]
