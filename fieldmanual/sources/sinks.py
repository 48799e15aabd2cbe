"""Sinks: whole-document replace, deletes, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_documents(current: DataFrame, incoming: DataFrame, key: str = "doc_name") -> DataFrame:
    """Next snapshot: rows of the incoming documents replace all their earlier rows."""
    names = incoming.select(key).distinct()
    return current.join(names, key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete_documents(current: DataFrame, doomed: DataFrame, key: str = "doc_name") -> tuple[DataFrame, DataFrame]:
    """(next snapshot, deleted row count per document)."""
    names = doomed.select(key).distinct()
    gone = current.join(names, key, "left_semi").groupBy(key).agg(F.count("*").alias("deleted"))
    return current.join(names, key, "left_anti"), gone


def clear(current: DataFrame, doc_type: str | None = None, kind: str = "doc_type") -> DataFrame:
    return current.limit(0) if doc_type is None else current.filter(F.coalesce(kind, F.lit("")) != doc_type)


def write_snapshot(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a new snapshot folder; readers switch to it once it is complete."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def export_bundle(df: DataFrame, path: str, key: str = "doc_name", files: int | None = None) -> None:
    """Portable bundle of documents, clustered by name and split by size, not one file per document."""
    out = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    out.sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def import_bundle(spark: SparkSession, path: str, current: DataFrame, key: str = "doc_name") -> DataFrame:
    """Idempotent import: documents of the bundle replace same-named ones."""
    return replace_documents(current, spark.read.parquet(path), key)
