"""Registered queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from fieldmanual.operators.search_index import SearchIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# Tables whose rows are long texts, with their key.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


class Tables:
    """The given tables of one scale folder, read on demand.

    A text table stored in fewer splits than there are cores is spread by its key, because parsing
    text costs more than moving it.  A large table has splits enough and is read in place.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores, TEXT_TABLES[name])
        return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that is read in fewer splits than there are cores, dealt over all of them by its key: for queries that compute much per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


_indexes: dict[tuple, SearchIndex] = {}


def stored_index(t: Tables, name: str, passages: DataFrame, cols: Sequence[str] = ("text",)) -> SearchIndex:
    """The search index of a table, built by the first query of an application that asks for it and read by all others."""
    key = (t.spark.sparkContext.applicationId, t.folder, name, *cols)
    if key not in _indexes:
        _indexes[key] = SearchIndex.build(passages, cols=cols)
    return _indexes[key]


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under a name, with the SQL that checks it."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return fn

    return add
