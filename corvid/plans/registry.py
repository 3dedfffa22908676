"""Registered queries: each applies one operator to whole tables; most have DuckDB SQL for the same rows."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("functions", "sources", "rows", "joins", "reports", "search", "streams", "lifecycle", "health")


class Tables:
    """Tables of one folder by name. Times without a zone are taken as UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under ``name``, with its SQL if there is one."""

    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"corvid.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for n, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five messages for each benchmark query by keywords."""
    _load()
    return _QUERIES["c06_flagship_keyword_search"](Tables(spark, sf_dir))
