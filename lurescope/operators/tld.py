"""TLD risk: longest listed suffix (two labels, then last label), default 0.5.

Two broadcast left equi joins against the fixed 43-row suffix table; the
two-label candidate wins over the last label (longest suffix first).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import host_of_netloc, netloc_of
from ..sources import dimensions as dims
from ..sources.fixed_values import UNKNOWN_TLD_RISK


def tld_host(domain: Column) -> Column:
    """Host for the suffix lookup: netloc when the text has ``://``, no userinfo,
    no port, ``www.`` dropped (case-sensitive), then lower-cased."""
    d = F.when(domain.contains("://"), netloc_of(domain)).otherwise(domain)
    h = host_of_netloc(d)
    h = F.when(h.startswith("www."), F.substring(h, 5, 1 << 30)).otherwise(h)
    return F.lower(h)


def with_tld_risk(df: DataFrame, domain_col: str = "domain", suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``tld`` STRING, ``tld_risk_score`` DOUBLE, ``tld_known`` INT.

    One left equi join per suffix length (longest first wins): the fixed
    table has one- and two-label suffixes, a custom ``suffixes`` table
    ``(suffix, risk, n_labels)`` may have more (its label counts are read
    first -- a handful of values).
    """
    if suffixes is None:
        suffixes = F.broadcast(dims.tld_risk(df.sparkSession))
        label_counts = [2, 1]
    else:
        label_counts = sorted({r[0] for r in suffixes.select("n_labels").distinct().collect()} | {1},
                              reverse=True)
    out = df.withColumn("_h", tld_host(F.col(domain_col)))
    found, risks = [], []
    for n in label_counts:
        side = suffixes.filter(F.col("n_labels") == n).select(
            F.col("suffix").alias(f"_s{n}"), F.col("risk").alias(f"_r{n}"))
        out = (out.withColumn(f"_c{n}", F.substring_index("_h", ".", -n))
                  .join(side, F.col(f"_c{n}") == F.col(f"_s{n}"), "left"))
        found.append(F.col(f"_s{n}"))
        risks.append(F.col(f"_r{n}"))
    tmp = ["_h"] + [f"_{x}{n}" for n in label_counts for x in ("c", "s", "r")]
    return (out.withColumn("tld", F.coalesce(*found, F.col("_c1")))
               .withColumn("tld_risk_score", F.coalesce(*risks, F.lit(UNKNOWN_TLD_RISK)))
               .withColumn("tld_known", reduce(lambda a, b: a | b, [f.isNotNull() for f in found]).cast("int"))
               .drop(*tmp))
