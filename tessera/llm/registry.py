"""The queries of this subpackage and the SQL that some can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, url_filters, warc
from tessera.llm.decontamination import op7_benchmark_decontamination
from tessera.llm.near_dedup import op10_minhash_near_dedup
from tessera.llm.packing import op1_best_fit_packing
from tessera.llm.pii import op4_pii
from tessera.llm.quality_rules import op5_quality_rules
from tessera.llm.rule_ensemble import op3_rule_ensemble
from tessera.llm.token_counts import op9_token_counts
from tessera.llm.toxicity import op6_toxicity
from tessera.llm.url_filters import op2_url_filters
from tessera.llm.warc import op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_url_filters": op2_url_filters,
        "op3_rule_ensemble": op3_rule_ensemble,
        "op4_pii": op4_pii,
        "op5_quality_rules": op5_quality_rules,
        "op6_toxicity": op6_toxicity,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_warc": op8_warc,
        "op9_token_counts": op9_token_counts,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": url_filters.ORACLE,
        "op7_benchmark_decontamination": decontamination.ORACLE,
        "op8_warc": warc.ORACLE,
    }
