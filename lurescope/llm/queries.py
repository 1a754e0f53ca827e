"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lurescope.llm import (alignment, centroids, licenses, minhash, mixing, pii, quality_rules, rule_ensemble, sharding, suffix,
                           toxicity, warc, winnowing)
from lurescope.llm.oracle import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sharding": sharding.op2_sharding,
    "op3_crf_toxicity": toxicity.op3_crf_toxicity,
    "op4_rule_ensemble": rule_ensemble.op4_rule_ensemble,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_winnowing": winnowing.op6_winnowing,
    "op7_suffix": suffix.op7_suffix,
    "op8_licenses": licenses.op8_licenses,
    "op9_minhash": minhash.op9_minhash,
    "op10_warc": warc.op10_warc,
    "op11_centroids": centroids.op11_centroids,
    "op12_alignment": alignment.op12_alignment,
    "op13_pii": pii.op13_pii,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
