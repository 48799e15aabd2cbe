"""Streams give the batch result."""

from __future__ import annotations

import datetime as dt
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from fieldmanual.operators import cases
from fieldmanual.streaming import streams


def folder():
    return tempfile.mkdtemp(prefix="fieldmanual-stream-")


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"u{i % 3}", t0 + dt.timedelta(seconds=17 * i), i % 11 != 0) for i in range(200)]
    return spark.createDataFrame(rows, "id long, uid string, ts timestamp, ok boolean")


def test_throttle_stream_equals_batch(spark):
    src, ck, df = folder(), folder(), events(spark)
    df.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (streams.throttle_stream(stream, ["uid"]).writeStream.format("memory").queryName("thr").option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert {r.id for r in spark.table("thr").collect()} == {r.id for r in streams.throttle_events(df, ["uid"]).collect()}


def test_throttle_carries_state_between_batches(spark):
    df = events(spark)
    whole = {r.id for r in streams.throttle_events(df, ["uid"]).collect()}
    first = streams.throttle_events(df.filter("id < 90"), ["uid"])
    last = first.groupBy("uid").agg(F.max("ts").alias("ts"))
    second = streams.throttle_events(df.filter("id >= 90"), ["uid"], last_kept=last)
    assert {r.id for r in first.collect()} | {r.id for r in second.collect()} == whole


def test_occurrence_stream_equals_batch_when_closed(spark):
    days = [(1, 1), (1, 3), (1, 9), (2, 2), (2, 20)]
    rows = [(f"e{e}", "s", dt.datetime(2024, 1, d)) for e, d in days] + [("far", "s", dt.datetime(2030, 1, 1))]
    df = spark.createDataFrame(rows, "entry_key string, site string, ts timestamp")
    src, ck = folder(), folder()
    df.coalesce(1).write.mode("overwrite").parquet(src)
    out = streams.stream_occurrences(spark.readStream.schema(df.schema).parquet(src))
    q = out.writeStream.format("memory").queryName("occ").option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.entry_key, r.occ_start) for r in spark.table("occ").collect()}
    batch = cases.occurrences(df.withColumn("day", F.to_date("ts"))).filter("entry_key <> 'far'")
    assert got == {(r.entry_key, r.occ_start) for r in batch.collect()}


def test_ingest_keeps_newest_version(spark):
    src, out, ck = Path(folder()), folder() + "/out", folder()
    (src / "a.md").write_text("first text")
    streams.stream_ingest(spark, str(src), out, ck).awaitTermination(120)
    (src / "sub").mkdir()
    (src / "sub" / "a.md").write_text("second text")
    (src / "b.md").write_text("other text")
    streams.stream_ingest(spark, str(src), out, ck).awaitTermination(120)
    assert {(r.doc_name, r.text) for r in streams.current_documents(spark, out, "doc_name").collect()} == {("a.md", "second text"), ("b.md", "other text")}
    # Files of one base name are documents of their own; a tombstone ends one of them.
    now = streams.current_documents(spark, out)
    assert {r.text for r in now.collect()} == {"first text", "second text", "other text"}
    first = now.filter("text = 'first text'").select("doc_id", F.lit(0).alias("batch"))
    assert {r.text for r in streams.current_documents(spark, out, deleted=first).collect()} == {"second text", "other text"}


def test_throttle_keeps_negative_ids(spark):
    rows = [(-5, "k", 0, True), (7, "k", 100, True), (-9, "k", 101, True), (-2, "k", 102, False)]
    events = spark.createDataFrame(rows, "id long, uid string, s int, ok boolean").selectExpr("id", "uid", "timestamp_seconds(s) as ts", "ok")
    last = spark.createDataFrame([("k", -200)], "uid string, s int").selectExpr("uid", "timestamp_seconds(s) as ts")
    kept = streams.throttle_events(events, ["uid"], 60, last_kept=last)
    assert sorted(r.id for r in kept.collect()) == [-5, -2, 7]


def test_settled_occurrences(spark):
    rows = [("e1", 1), ("e1", 4), ("e2", 2), ("e2", 9), ("e3", 5)]
    days = spark.createDataFrame([(k, dt.date(2024, 1, d)) for k, d in rows], "entry_key string, day date")
    # The stream saw e1 only from the 4th, closed e2's first session, never closed e2's second, and missed e3.
    seen = spark.createDataFrame([("e1", dt.date(2024, 1, 4)), ("e2", dt.date(2024, 1, 2))], "entry_key string, occ_start date")
    done = streams.settle_occurrences(seen, streams.reconcile_occurrences(seen, days, ["entry_key"]), ["entry_key"])
    assert {(r.entry_key, r.occ_start.day, r.streamed) for r in done.collect()} == {("e1", 1, False), ("e2", 2, True), ("e2", 9, False), ("e3", 5, False)}
