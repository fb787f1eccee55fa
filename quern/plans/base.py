"""How queries are registered and how they read tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver tables of one directory, read when asked for, and SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A projection that reads the same in both dialects; tables are named in braces."""
        names = {n for n in TABLE_NAMES if "{" + n + "}" in text}
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


TABLE_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(text: str) -> str:
    """The same SQL with plain table names, for DuckDB."""
    for n in TABLE_NAMES:
        text = text.replace("{" + n + "}", n)
    return text


def query(name: str, oracle: str | None = None):
    """Register a function of :class:`Tables` under ``name``, with the DuckDB SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = plain(oracle)
        return f

    return add
