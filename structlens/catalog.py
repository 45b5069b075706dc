"""Every query of the library by name, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import code, project, stars, states, texts, trees, varied


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**texts.Q, **stars.Q, **states.Q, **code.Q, **project.Q, **varied.Q, **trees.Q}


def oracle_sql() -> dict[str, str]:
    return {**texts.O, **stars.O, **states.O, **code.O, **project.O, **varied.O, **trees.O}
