"""Registry of runnable queries: name -> operator call, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens import adapters
from runlens.session import prepare

_QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, and the adapter views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._registered: set[str] = set()

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        full = adapters.with_views(text, spark=True)
        for name in adapters.BASE_TABLES:
            if name not in self._registered and name in full:
                self.base(name).createOrReplaceTempView(name)
                self._registered.add(name)
        return self.spark.sql(full)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")


def query(name: str, oracle: str | None = None):
    """Register an operator run over the given tables; ``oracle`` is the checking SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = adapters.with_views(oracle)
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(Tables(spark, folder))

        return run

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
