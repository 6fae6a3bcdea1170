"""Registry of named queries; each has a Spark form and, where SQL can say it, a checking statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from emberscope.catalog.telemetry import view, with_views


@dataclass
class Data:
    """The tables and telemetry views a query reads."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(data) -> DataFrame`` under ``name``."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if check is not None:
            CHECKS[name] = with_views(check)
        return fn

    return register
