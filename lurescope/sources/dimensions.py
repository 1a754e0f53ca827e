"""Dimension tables built from the fixed values.

All of them have a size fixed by this repository (85 keywords, 43 suffixes,
24 look-alikes, 21 action words), so broadcasting them is always safe.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as FV

BRAND_KEYWORD_SCHEMA = T.StructType([
    T.StructField("brand", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("kw_len", T.IntegerType(), False),
    T.StructField("ord", T.IntegerType(), False),
])

TLD_RISK_SCHEMA = T.StructType([
    T.StructField("suffix", T.StringType(), False),
    T.StructField("risk", T.DoubleType(), False),
    T.StructField("n_labels", T.IntegerType(), False),
])

CONFUSABLE_SCHEMA = T.StructType([
    T.StructField("ch", T.StringType(), False),
    T.StructField("codepoint", T.StringType(), False),
    T.StructField("looks_like", T.StringType(), False),
    T.StructField("char_name", T.StringType(), False),
])


def sql_literal(v) -> str:
    """A Spark SQL literal for a fixed value (strings escaped for the parser)."""
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return repr(v) + "D"
    return str(v)


def literal_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small fixed table as a SQL ``VALUES`` relation.

    Parsed once on the JVM side into a local relation: no Python worker is
    needed on executors to decode it (unlike ``createDataFrame`` on a Python
    list) and no per-value round trips from the driver.
    """
    names = [f.name for f in schema.fields]
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST({n} AS {f.dataType.simpleString()}) AS {n}" for n, f in zip(names, schema.fields))
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({', '.join(names)})")


def array_literal(values) -> Column:
    """``array(...)`` of fixed scalars or ``dict`` rows (as named structs), parsed once."""
    def one(v):
        if isinstance(v, dict):
            return "named_struct(" + ", ".join(f"'{k}', {sql_literal(x)}" for k, x in v.items()) + ")"
        return sql_literal(v)
    return F.expr("array(" + ", ".join(one(v) for v in values) + ")")


def brand_keyword_rows() -> list[tuple[str, str, int, int]]:
    rows, i = [], 0
    for brand, kws in FV.BRAND_KEYWORDS.items():
        for kw in kws:
            rows.append((brand, kw, len(kw), i))
            i += 1
    return rows


def brand_keywords(spark: SparkSession) -> DataFrame:
    """``(brand, keyword, kw_len, ord)``; ``ord`` is dictionary order."""
    return literal_table(spark, brand_keyword_rows(), BRAND_KEYWORD_SCHEMA)


def tld_risk(spark: SparkSession) -> DataFrame:
    rows = [(s, float(r), s.count(".") + 1) for s, r in FV.TLD_RISK.items()]
    return literal_table(spark, rows, TLD_RISK_SCHEMA)


def confusable_rows() -> list[tuple[str, str, str, str]]:
    return [(ch, f"U+{ord(ch):04X}", like, unicodedata.name(ch, "UNKNOWN"))
            for ch, like in FV.CONFUSABLES.items()]


def confusables(spark: SparkSession) -> DataFrame:
    return literal_table(spark, confusable_rows(), CONFUSABLE_SCHEMA)


def action_words_array() -> Column:
    return array_literal(FV.ACTION_WORDS)


def keyword_bands(keywords: DataFrame, max_dist: int = FV.MAX_TYPOSQUAT_DISTANCE) -> DataFrame:
    """Keywords repeated for every token length within ``max_dist`` of theirs,
    so the typosquat join is an equi join on length instead of a nested loop."""
    offsets = F.sequence(F.lit(-max_dist), F.lit(max_dist))
    return (keywords.select("*", F.explode(offsets).alias("_off"))
                    .withColumn("band_len", F.col("kw_len") + F.col("_off"))
                    .drop("_off")
                    .filter(F.col("band_len") >= F.lit(FV.MIN_TYPOSQUAT_TOKEN_LENGTH)))


def brand_keyword_bands(spark: SparkSession, max_dist: int = FV.MAX_TYPOSQUAT_DISTANCE) -> DataFrame:
    """The fixed dictionary banded: 85 keywords x 5 lengths (409 rows after the
    minimum token length)."""
    return keyword_bands(brand_keywords(spark), max_dist)


# ------------------------------------------------- S2 / S3: dictionary files

def read_brand_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file ``{"Brand": ["kw", ...], ...}`` -> ``(brand, keyword, kw_len, ord)``.

    Read as one text value, parsed with ``from_json`` and exploded twice;
    ``ord`` keeps file order (brand position, then keyword position).
    """
    m = F.from_json(F.col("value"), "map<string,array<string>>")
    brands = (spark.read.text(path, wholetext=True)
              .select(F.posexplode(F.map_entries(m)).alias("_bpos", "_e"))
              .select("_bpos", F.col("_e.key").alias("brand"), F.col("_e.value").alias("_kws")))
    kws = brands.select("_bpos", "brand", F.posexplode("_kws").alias("_kpos", "keyword"))
    return kws.select("brand", "keyword", F.length("keyword").cast("int").alias("kw_len"),
                      (F.col("_bpos").cast("long") * (1 << 32) + F.col("_kpos")).alias("ord"))


def read_tld_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: a JSON file ``{"suffix": risk, ...}`` -> ``(suffix, risk, n_labels)``."""
    m = F.from_json(F.col("value"), "map<string,double>")
    e = spark.read.text(path, wholetext=True).select(F.explode(m).alias("suffix", "risk"))
    return e.select("suffix", "risk", (F.size(F.split("suffix", r"\.")).cast("int")).alias("n_labels"))
