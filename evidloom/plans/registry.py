"""Registered queries: a Spark builder and, where SQL can say the same, a DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from evidloom.plans import views
from evidloom.session import tune


class Inputs:
    """Tables and views of one scale-factor folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        tune(spark)

    def path(self, table: str) -> str:
        return f"{self.sf_dir.rstrip('/')}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def _loaded(self) -> dict[str, DataFrame]:
        return {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            if name in views.VIEWS:
                text = views.spark_text(name)
                for t in [*views.TABLES, *views.needed(text)]:
                    if f"FROM {t}" in text or f"JOIN {t}" in text:
                        self(t).createOrReplaceTempView(t)
                self._loaded[name] = self.spark.sql(text)
            else:
                self._loaded[name] = self.table(name)
        return self._loaded[name]


Builder = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = views.with_views(oracle)
        return build

    return register


def load_all() -> None:
    from evidloom.plans import (  # noqa: F401
        evaluation_queries, governance_queries, linkage_queries, operations_queries,
        retrieval_queries, streaming_queries,
    )


def spark_callable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = QUERIES[name]
    return lambda spark, sf_dir: build(Inputs(spark, sf_dir))
