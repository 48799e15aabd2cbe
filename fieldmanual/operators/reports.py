"""Audit, inventory and measurement reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmanual.functions.text import ip_is_internal
from fieldmanual.operators.ordered import top_k


def recent_events(log: DataFrame, n: int = 200, ts: str = "ts", ident: str = "id") -> DataFrame:
    return log.orderBy(F.desc(ts), F.desc(ident)).limit(n)


def enrich_geo(log: DataFrame, geo: DataFrame, ip: str = "ip") -> DataFrame:
    """Location label per address: internal first, then the cached one, a dash without address."""
    cached = geo.select(ip, F.concat_ws(" ", "geo", "isp").alias("__geo"))
    label = (F.when(F.coalesce(ip, F.lit("")) == "", "—").when(ip_is_internal(ip), "internal")
             .otherwise(F.coalesce("__geo", F.lit(""))))
    return log.join(cached, ip, "left").withColumn("location", label).drop("__geo")


def permission_overview(users: DataFrame, scopes: DataFrame, now: Column) -> DataFrame:
    """Every account with its unexpired scopes.  Expiry is applied here, as in access checks."""
    live = (scopes.filter(F.col("valid_until") > now).groupBy("uid")
            .agg(F.array_join(F.array_sort(F.collect_set("scope")), ", ").alias("scopes")))
    return users.select("uid", "role", "status").join(live, "uid", "left").withColumn("scopes", F.coalesce("scopes", F.lit("—")))


def document_inventory(points: DataFrame, order: str, name: str = "doc_name", fields: Sequence[str] = ("doc_type",)) -> DataFrame:
    """Chunks per document with type and location of its first point, by name."""
    return points.groupBy(name).agg(F.count("*").alias("chunks"), *[F.min_by(f, order).alias(f) for f in fields]).orderBy(name)


def pin_recent(inventory: DataFrame, recent: DataFrame, name: str = "doc_name", finished: str = "finished_at") -> DataFrame:
    """Recently finished documents first, latest on top, then the rest by name."""
    last = recent.groupBy(name).agg(F.max(finished).alias("__f"))
    return (inventory.join(last, name, "left").withColumn("pinned", F.col("__f").isNotNull())
            .orderBy(F.desc_nulls_last("__f"), name).withColumnRenamed("__f", "finished"))


def acl_distribution(acl: DataFrame, by: Sequence[str] = ("owner_scope", "sec_level", "review_status")) -> DataFrame:
    return acl.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def entry_distribution(acl: DataFrame) -> DataFrame:
    models = F.array_join(F.array_sort("models"), ",").alias("models")
    return acl.groupBy("category", "customer", models).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category", "customer")


def query_logs(days: DataFrame, log: str = "log_id", day: str = "day", recent: int | None = 7, date_from=None,
               date_to=None, title: str | None = None, site: str | None = None) -> DataFrame:
    """Last N days of each log or an inclusive date range, with the range available."""
    df = days if not (title and site) else days.filter(F.lower(title).contains(site.lower()))
    span = df.groupBy(log).agg(F.min(day).alias("available_from"), F.max(day).alias("available_to"))
    if date_from is not None or date_to is not None:
        if date_from is not None:
            df = df.filter(F.col(day) >= date_from)
        if date_to is not None:
            df = df.filter(F.col(day) <= date_to)
    else:
        df = top_k(df, [log], [F.desc(day)], recent, "__r").drop("__r")
    return df.join(span, log)


def residual_stats(df: DataFrame, group: Sequence[str], raw: str = "raw", residual: str = "residual") -> DataFrame:
    """Mean, three population sigmas of raw and residual values, and R squared."""
    var = F.var_pop(raw) * F.count(raw)
    return df.groupBy(*group).agg(
        F.avg(raw).alias("mean_raw"), (3 * F.stddev_pop(raw)).alias("sigma3_raw"), (3 * F.stddev_pop(residual)).alias("sigma3_res"),
        F.when(var > 0, 1 - F.sum(F.col(residual) * F.col(residual)) / var).alias("r2"))


def auto_scale(df: DataFrame, dx: str = "dx", dy: str = "dy", pitch: str = "pitch", group: Sequence[str] = ()) -> DataFrame:
    """Arrow scale from the smallest pitch and the 75th percentile of the non-zero magnitudes.

    Magnitudes are counted by value first, so the percentile reads a frequency table.
    """
    mag = F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy))
    per = df.groupBy(*group, mag.alias("m")).agg(F.count("*").alias("n"), F.min(pitch).alias("p"))
    q = F.percentile(F.when(F.col("m") > 0, F.col("m")), F.lit(0.75), F.when(F.col("m") > 0, F.col("n")).otherwise(0))
    return per.groupBy(*group).agg(q.alias("p75"), F.min("p").alias("pitch")).withColumn(
        "scale", F.when(F.col("p75").isNull(), F.lit(1000.0)).otherwise(
            F.greatest(F.lit(0.3) * F.col("pitch") / 1000 / F.col("p75"), F.lit(1e-3))))


def measurement_listing(rows: DataFrame, file: str = "file", corrupt: str = "_corrupt_record") -> DataFrame:
    """One row per file: type, date, machine, readable rows; unreadable files are flagged, not fatal."""
    bad = F.count_if(F.col(corrupt).isNotNull()) if corrupt in rows.columns else F.lit(0)
    good = F.count_if(F.col(corrupt).isNull()) if corrupt in rows.columns else F.count("*")
    return rows.groupBy(file).agg(F.max("type").alias("type"), F.max("day").alias("day"), F.max("machine").alias("machine"),
                                  good.alias("n_rows"), (bad > 0).alias("unreadable"))


