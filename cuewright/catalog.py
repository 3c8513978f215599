"""Every query of the library, by name, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewright.plans import folded, records, rules, selections, sequences, texts, units

FLAGSHIP = "quality_rank"
MODULES = (folded, records, rules, selections, sequences, texts, units)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for module in MODULES for name in module.SQL}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for module in MODULES for name, sql in module.SQL.items() if sql}
