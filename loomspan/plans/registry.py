"""All registered queries outside the corpus operators, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import query
from .frames import FRAMES
from .suites import SUITE
from .tpch import TPCH


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(sql) for name, (sql, _) in {**TPCH, **SUITE}.items()} | {name: run for name, (run, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duck for name, (_, duck) in {**TPCH, **SUITE}.items()} | {name: duck for name, (_, duck) in FRAMES.items()}
