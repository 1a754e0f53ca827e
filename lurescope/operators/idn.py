"""IDN homograph: look-alike characters and punycode labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_round, py_strip
from ..sources import dimensions as dims
from ..sources.fixed_values import CONFUSABLES

IDN_COLUMNS = ["idn_is_homograph", "idn_confusable_count", "idn_risk_score", "idn_punycode_flag"]

# All look-alikes are non-ASCII, so one character class counts every occurrence.
_CONFUSABLE_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in CONFUSABLES) + "]"


def idn_normal(domain: Column) -> Column:
    return F.lower(py_strip(domain))


def idn_columns(domain: Column) -> dict[str, Column]:
    d = idn_normal(domain)
    n = F.regexp_count(d, F.lit(_CONFUSABLE_CLASS)).cast("int")
    puny = d.contains("xn--")
    risk = (F.when(n > 0, F.least(F.lit(0.5) + F.lit(0.15) * n, F.lit(1.0)))
             .when(puny, F.lit(0.6)).otherwise(F.lit(0.0)))
    return {
        "idn_is_homograph": ((n > 0) | puny).cast("int"),
        "idn_confusable_count": n,
        "idn_risk_score": py_round(risk, 4),
        "idn_punycode_flag": puny.cast("int"),
    }


def with_idn(df: DataFrame, domain_col: str = "domain") -> DataFrame:
    cols = idn_columns(F.col(domain_col))
    return df.select("*", *[cols[k].alias(k) for k in IDN_COLUMNS])


def confusable_details(df: DataFrame, domain_col: str = "domain") -> DataFrame:
    """One row per look-alike occurrence: ``(domain, pos, ch, codepoint, looks_like, script)``
    (``script`` is the Unicode character name, as the detector reports it).

    Characters are exploded and equi-joined to the fixed 24-row look-alike
    table (broadcast); only non-ASCII characters are exploded, which keeps
    the probe side small for ordinary domains.
    """
    conf = F.broadcast(dims.confusables(df.sparkSession))
    chars = (df.select(F.col(domain_col).alias("domain"))
               .filter(F.col("domain").rlike("[^\\x00-\\x7F]"))
               .select("domain", F.posexplode(F.split(idn_normal(F.col("domain")), "")).alias("pos", "ch")))
    return chars.join(conf, "ch").select("domain", (F.col("pos") + 1).alias("pos"), "ch",
                                         "codepoint", "looks_like", F.col("char_name").alias("script"))
