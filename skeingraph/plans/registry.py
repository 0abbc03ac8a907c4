"""Every query of the engine by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code, feeds, pages, plain, records, searches, stored, walks

MODULES = [walks, searches, records, code, stored, plain, feeds, pages]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.callees_three_levels(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
