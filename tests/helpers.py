"""Small builders for hand-written table sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from migrata.spec import Schema, log_from_dicts


def tables(spark: SparkSession, spec: dict[str, tuple[str, list[tuple]]]) -> dict[str, DataFrame]:
    """{name: (ddl schema, rows)} -> {name: DataFrame}."""
    return {k: spark.createDataFrame(rows, ddl) for k, (ddl, rows) in spec.items()}


def schema(d: dict) -> Schema:
    return Schema.from_dict(d)


def log(items: list[dict]):
    return log_from_dicts(items)
