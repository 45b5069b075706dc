"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import chat, embedding_dedup, mixing, packing, quality, repair, separator_scan, simhash, substring, term_prints, token_output, toxicity, whitening

_MODULES = {
    "op1_token_output": token_output,
    "op2_toxicity": toxicity,
    "op3_separator_scan": separator_scan,
    "op4_mixing": mixing,
    "op5_packing": packing,
    "op6_embedding_dedup": embedding_dedup,
    "op7_simhash": simhash,
    "op8_substring_dedup": substring,
    "op9_quality_rules": quality,
    "op10_chat_format": chat,
    "op11_whitening": whitening,
    "op12_term_prints": term_prints,
    "op13_repair": repair,
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(module.query) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
