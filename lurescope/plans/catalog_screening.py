"""Named queries of screening and scoring: listed parent domains, bracketed hosts, a fitted scorer."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import domain_key, join_host
from ..operators import blacklist, features, fitted, scoring
from ..session import materialize, scratch_path
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import catalog


def parent_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of every 97th request without their first label, where two labels are left."""
    req = catalog.valid_requests(spark, sf_dir).filter("request_id % 97 = 0")
    host = join_host(domain_key(F.col("url")))
    parent = F.regexp_replace(host, "^[^.]*[.]", "")
    return req.select(F.when(parent.contains("."), F.upper(parent)).otherwise(host).alias("domain"))


def q_zero_day_parents(spark, sf_dir):
    """A listed domain covers the hosts below it."""
    req = catalog.valid_requests(spark, sf_dir).withColumn("domain", domain_key(F.col("url"))).select("request_id", "domain")
    return scoring.with_zero_day(req, blacklist.screen(parent_blacklist(spark, sf_dir)))


def q_url_validate_brackets(spark, sf_dir):
    """IPv6 and IPvFuture literals of every shape, with group values from the page ids (some too long)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id")
    n, text = F.col("page_id"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    g = [F.lower(F.hex(n * k % 70_000)) for k in (1, 7, 31, 127, 509, 2_039, 8_191, 32_749)]
    run = lambda k: F.concat_ws(":", *g[:k])
    raw = [text("[", run(8), "]/x"), text("http://u@[", g[1], "::", g[3], "]:80/"),
           text("[::ffff:", n % 300, ".", n % 7, ".0.", n % 256, "]"), text("[", run(7), "]"),
           text("https://[", g[1], "::", g[2], "::", g[3], "]"), text("[fe80::", g[1], "%", F.repeat(F.lit("z"), (n % 3).cast("int")), "]"),
           text("[v", g[0], ".", F.repeat(F.lit("x"), (n % 2).cast("int")), "]:1?q"), text("a[::", g[1], "]"), text("[::", g[1], "]x"),
           text("[", g[0], "::", run(6), "]"), text("[", run(4), "::", run(4), "]"), text("[", run(7), "::]#f"),
           text("[", run(6), ":10.0.", n % 260, ".1]"), text("u[1]@[::", g[2], "]"), text("[", run(3), ":]")]
    variants = F.array(*[F.struct(F.lit(i).alias("variant"), r.alias("url")) for i, r in enumerate(raw)])
    v = scoring.validate(pages.select("page_id", F.inline(variants)))
    return v.select("page_id", "variant", "url", "reject_reason")


def train_fixture(spark: SparkSession, sf_dir: str):
    """A model of the rule verdict, fitted on the requests of the first half of the month."""
    dns, who, tls_obs = catalog._records(spark, sf_dir)
    early = catalog.valid_requests(spark, sf_dir).filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    fv = materialize(features.feature_vector(early, dns, who, tls_obs, fx.AGES_AS_OF), "training_features")
    return fitted.fit(fv.withColumn("hit", scoring.rule_score(F.col("domain")) >= 70), "hit")


def q_scan_results_fitted(spark, sf_dir):
    """A saved pipeline scores; base and contributions add up to each row's score."""
    path = scratch_path(spark, "fitted_model")
    train_fixture(spark, sf_dir).write().overwrite().save(path)
    dns, who, tls_obs = catalog._records(spark, sf_dir)
    s = scoring.scan_results(catalog.valid_requests(spark, sf_dir), dns, who, tls_obs, fx.AGES_AS_OF,
                             scorer=fitted.LinearScorer.load(path))
    shap = F.from_json("shap_json", scoring.SHAP_SCHEMA)
    total = F.aggregate(shap, F.lit(0.0), lambda acc, e: acc + e["shap_value"])
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    return s.select("id", "domain", F.size(shap).alias("n_shap"), F.element_at(shap, 1)["value"].alias("first_value"),
                    (F.abs(chance - F.col("confidence")) < 1e-9).alias("adds_up"),
                    (F.abs(chance * 100 - F.col("score")) < 0.500001).alias("scored"),
                    (F.col("verdict") == scoring.verdict(F.col("score"))).alias("judged"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "zero_day_parents": q_zero_day_parents,
    "url_validate_brackets": q_url_validate_brackets,
    "scan_results_fitted": q_scan_results_fitted,
}
