"""All registered queries outside the optional subpackages, with their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from faultlens.bindings import registry
from faultlens.plans import search
from faultlens.session import table

for _name in ("relational", "scalar", "retrieval", "quality", "knowledge", "more", "state", "stored"):
    import_module(f"faultlens.bindings.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.flagship(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
