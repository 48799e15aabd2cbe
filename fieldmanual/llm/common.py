"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of local sessions that name none, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; an own one only in local mode where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="fieldmanual-shared-")
    return _own_folders[app]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_text(key: str) -> Column:
    """The key as text, empty where it is null."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def held_out(key: str) -> Column:
    """True for the fifth of the keys that no model learns from (a null key is held out)."""
    return F.crc32(key_text(key)) % 5 == 0


def part_of(df: DataFrame, key: str, wanted: int) -> DataFrame:
    """About ``wanted`` rows (all, if there are fewer), chosen by a hash of the key."""
    step = max(1, df.count() // max(1, wanted))
    return df if step == 1 else df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(step)) == 0)


def sent_whole(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """``df`` (stored, narrow rows) as a broadcast side while it has at most ``most_rows`` rows; beyond, left to shuffle."""
    return F.broadcast(df) if df.count() <= most_rows else df


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most ``rows`` rows at once to Python functions in the jobs run inside; texts then need little memory there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
