"""Set-wise family tagging of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmanual.functions import equipment as eq


def infer_multi(paths: DataFrame, key: str, inferred: Column, content: str | None = None) -> DataFrame:
    """Union of the families of all paths of one file, in order; families from content beat paths.

    The distinct families of a file are few, so its list stays short.
    """
    each = paths.select(key, F.explode(F.split(inferred, ",")).alias("family")).distinct()
    by_path = each.groupBy(key).agg(F.array_sort(F.collect_list("family")).alias("families"))
    if not content:
        return by_path
    body = (paths.select(key, F.explode(content).alias("family")).distinct()
            .groupBy(key).agg(F.array_sort(F.collect_list("family")).alias("from_content")))
    return by_path.join(body, key, "left").select(key, F.coalesce("from_content", "families").alias("families"))


def retag_diff(current: DataFrame, inferred: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """Documents whose tag would change, old and new; rows under ``keep`` are left alone."""
    rows = current.filter(~keep) if keep is not None else current
    j = rows.join(inferred.withColumnRenamed("families", "__new"), key)
    old = F.array_join(F.array_sort(F.coalesce("families", F.array().cast("array<string>"))), ",")
    new = F.array_join(F.array_sort("__new"), ",")
    return j.select(key, old.alias("old_tags"), new.alias("new_tags")).filter(F.col("old_tags") != F.col("new_tags"))


def primary_model(acl: DataFrame, name: str = "filename", default: str = "COMMON") -> DataFrame:
    """Per file the greatest family list and its first specific family."""
    top = acl.groupBy(name).agg(F.max(F.array_join("models", ",")).alias("m"))
    return top.select(name, eq.first_specific(F.split("m", ","), default).alias("primary_model"))


def tag_counts(diff: DataFrame, by: Sequence[str] = ("new_tags",)) -> DataFrame:
    return diff.groupBy(*by).agg(F.count("*").alias("n"))
