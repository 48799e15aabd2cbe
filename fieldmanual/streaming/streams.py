"""Event operators in batch and as Structured Streaming queries.

Streams write one folder per micro-batch (``batch=<id>``), overwritten on a retry, and readers take
the newest version of each document or day.  Nothing is rewritten when a document changes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmanual.functions.text import short_id, whole_or_sections
from fieldmanual.operators import cases
from fieldmanual.operators.ordered import WIDTH, keep_spaced

def throttle_events(events: DataFrame, keys: Sequence[str] = ("uid", "ip", "action"), seconds: int = 60, ts: str = "ts",
                    ok: str = "ok", ident: str = "id", last_kept: DataFrame | None = None,
                    width: int = WIDTH) -> DataFrame:
    """Keep a success only ``seconds`` after the last kept event of its key; failures are always kept.

    Keys are cut into blocks of ``width`` events, so one busy key or day is spread over many tasks.
    ``last_kept`` (keys, ts) carries the state of an earlier batch.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(*keys, us.alias("__us"), F.col(ident).cast("long").alias("__id"), (~F.col(ok)).alias("__fail"), F.lit(False).alias("__past"))
    if last_kept is not None:
        past = last_kept.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"),
                                F.lit(-1).cast("long").alias("__id"), F.lit(True).alias("__fail"), F.lit(True).alias("__past"))
        rows = rows.unionByName(past)
    marked = keep_spaced(rows, keys, "__us", F.col("__us"), F.col("__us"), seconds * 1_000_000,
                         force=F.col("__fail"), out="__kept", width=width, tie="__id")
    kept = marked.filter("__kept and not __past").select(F.col("__id").alias(ident))
    return events.join(kept, ident, "left_semi")


def throttle_stream(stream: DataFrame, keys: Sequence[str] = ("uid", "ip", "action"), seconds: int = 60, ts: str = "ts",
                    ok: str = "ok", ident: str = "id") -> DataFrame:
    """The same rule with one timestamp of keyed state, for streams whose keys stay moderate."""
    names = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in (*names, ident, ts, ok))
    gap = seconds * 1_000_000

    def step(key, batches, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values([ts, ident], kind="stable")
        kept = []
        for i, (t, good) in enumerate(zip(rows[ts].astype("datetime64[us]").astype("int64"), rows[ok], strict=True)):
            if not good or last is None or t - last >= gap:
                kept.append(i)
                last = int(t)
        if last is not None:
            state.update((last,))
        yield rows.iloc[kept][[*names, ident, ts, ok]]

    return (stream.select(*names, ident, ts, ok).groupBy(*names)
            .applyInPandasWithState(step, schema, "last long", "append", "NoTimeout"))


def stream_occurrences(events: DataFrame, gap: str = "3 days", watermark: str = "1 day", ts: str = "ts",
                       keys: Sequence[str] = ("entry_key", "site")) -> DataFrame:
    """Occurrences as event-time sessions; a session is emitted once the watermark has closed it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return (timed.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events"))
            .select(*keys, F.to_date("w.start").alias("occ_start"), "n_events"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None,
                  available_now: bool = True):
    """Append each micro-batch to ``path/batch=<id>``; a retried batch overwrites its own folder."""
    def put(df: DataFrame, batch_id: int) -> None:
        (shape(df) if shape else df).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_ingest(spark: SparkSession, folder: str, path: str, checkpoint: str, patterns: str = "*.md",
                  doc_type: str = "manual"):
    """New and changed files become passages; read them back with :func:`current_documents`."""
    raw = (spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", patterns).load(folder).select(F.col("_metadata.file_path").alias("file_path"), "value"))

    def passages(df: DataFrame) -> DataFrame:
        docs = df.filter(F.length("value") >= 5).withColumn("doc_name", F.element_at(F.split("file_path", "/"), -1))
        return (docs.select(short_id("file_path").alias("doc_id"), "doc_name", F.lit(doc_type).alias("doc_type"), "file_path",
                            F.posexplode(whole_or_sections("value")).alias("seq", "s"))
                .select("doc_id", "doc_name", "doc_type", "file_path", F.col("seq").cast("long").alias("seq"),
                        F.col("s.title").alias("section_title"), F.col("s.body").alias("text")))

    return write_batches(raw, path, checkpoint, passages)


def current_documents(spark: SparkSession, path: str, key: str = "doc_id", deleted: DataFrame | None = None) -> DataFrame:
    """Rows of the newest version of each document.

    ``deleted`` (key, batch) holds tombstones: versions up to that batch are gone, a later one lives again.
    """
    rows = spark.read.parquet(path)
    newest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    if deleted is not None:
        gone = deleted.groupBy(key).agg(F.max("batch").alias("__until"))
        newest = newest.join(gone, key, "left").filter("__until is null or batch > __until").drop("__until")
    return rows.join(newest, [key, "batch"], "left_semi").drop("batch")


def latest_day_text(days: DataFrame, log: str = "log_id", day: str = "day", text: str = "text", version: str = "batch") -> DataFrame:
    """Newest text of each day of a log; ``text`` breaks ties so the result is fixed."""
    return days.groupBy(log, day).agg(F.max_by(text, F.struct(version, text)).alias(text))


def reconcile_occurrences(streamed: DataFrame, events: DataFrame, keys: Sequence[str] = ("entry_key", "site"),
                          day: str = "day") -> DataFrame:
    """Batch recomputation against streamed starts: what late data the watermark dropped must repair."""
    batch = cases.occurrences(events, list(keys), "__site", day) if "__site" in events.columns else cases.occurrences(
        events.withColumn("__site", F.lit("")), list(keys), "__site", day)
    a = batch.filter(F.col("occ_start").isNotNull()).select(*keys, "occ_start").withColumn("in_batch", F.lit(True))
    b = streamed.select(*keys, "occ_start").distinct().withColumn("in_stream", F.lit(True))
    j = a.join(b, [*keys, "occ_start"], "full_outer").fillna(False, ["in_batch", "in_stream"])
    return j.filter("in_batch <> in_stream")


def settle_occurrences(streamed: DataFrame, repairs: DataFrame, keys: Sequence[str] = ("entry_key", "site")) -> DataFrame:
    """Starts after the repairs of :func:`reconcile_occurrences`: (keys, occ_start, streamed), ``streamed`` where the stream had them.

    Starts that late rows moved or joined away go, starts the stream did not close or never saw come in.
    """
    on = [*keys, "occ_start"]
    kept = streamed.select(*on).distinct().join(repairs.filter("in_stream").select(*on), on, "left_anti").withColumn("streamed", F.lit(True))
    return kept.unionByName(repairs.filter("in_batch").select(*on, F.lit(False).alias("streamed")))
