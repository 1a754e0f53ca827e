"""URL lexical features (12 columns) and host entropy -- row-local expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_DIGIT_CLASS, count_char, py_round
from ..functions.url import host_of_netloc, split_url, with_default_scheme

LEXICAL_COLUMNS = [
    "url_length", "hyphen_count", "dot_count", "digit_count", "entropy",
    "subdomain_depth", "has_https", "is_ip_address", "has_at_symbol",
    "path_length", "query_param_count", "special_char_count",
]

# Python's ``\d`` (Unicode decimal digits) for the dotted-quad test.
_IP_RE = r"^\p{Nd}{1,3}(\.\p{Nd}{1,3}){3}\z"


def shannon_entropy(s: Column) -> Column:
    """Bits per character of ``s``, summed over distinct characters in first-seen
    order (the order Python's ``Counter`` uses); 0.0 for the empty string."""
    n = F.length(s).cast("double")
    chars = F.array_distinct(F.split(s, ""))
    shares = F.transform(
        chars, lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / n)
    ent = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(ent)


def digit_count(s: Column) -> Column:
    """``sum(c.isdigit() for c in s)``; ASCII text takes the cheap ``[0-9]`` class,
    anything else the exact Unicode class (a long range list, slow per char)."""
    return (F.when(s.rlike(r"^[\x00-\x7F]*$"), F.regexp_count(s, F.lit("[0-9]")))
             .otherwise(F.regexp_count(s, F.lit(PY_DIGIT_CLASS)))).cast("int")


def lexical_columns(url: Column, parts: dict[str, Column] | None = None,
                    host: Column | None = None) -> dict[str, Column]:
    """The 12 lexical features of ``url`` (the URL as given).

    ``parts`` / ``host`` may be columns computed in an earlier projection, so
    the split regex runs once per row instead of once per feature.
    """
    parts = parts or split_url(with_default_scheme(url))
    host = host if host is not None else host_of_netloc(parts["netloc"])
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    query = parts["query"]
    return {
        "url_length": F.length(url).cast("int"),
        "hyphen_count": count_char(host, "-"),
        "dot_count": count_char(host, "."),
        "digit_count": digit_count(host),
        "entropy": py_round(shannon_entropy(host), 4),
        "subdomain_depth": F.greatest(F.size(labels) - 2, F.lit(0)).cast("int"),
        "has_https": (parts["scheme"] == "https").cast("int"),
        "is_ip_address": host.rlike(_IP_RE).cast("int"),
        "has_at_symbol": url.contains("@").cast("int"),
        "path_length": F.length(parts["path"]).cast("int"),
        "query_param_count": F.when(query == "", F.lit(0))
                              .otherwise(F.size(F.split(query, "&", -1))).cast("int"),
        "special_char_count": F.regexp_count(url, F.lit(r"[^a-zA-Z0-9.\-/:]")).cast("int"),
    }


_TMP = ["_lx_scheme", "_lx_netloc", "_lx_path", "_lx_query", "_lx_host"]


def with_lexical_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the 12 lexical columns.  Three projections: split, host, features
    (Catalyst keeps them apart rather than repeat the regex per feature)."""
    parts = split_url(with_default_scheme(F.col(url_col)))
    staged = df.select("*", *[parts[k].alias("_lx_" + k) for k in ("scheme", "netloc", "path", "query")])
    staged = staged.withColumn("_lx_host", host_of_netloc(F.col("_lx_netloc")))
    cols = lexical_columns(F.col(url_col), {k: F.col("_lx_" + k) for k in ("scheme", "netloc", "path", "query")},
                           F.col("_lx_host"))
    return staged.select(*df.columns, *[cols[k].alias(k) for k in LEXICAL_COLUMNS])
