"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

Documents arrive in batches.  A batch's line keys become one run: a table of (hash, documents), hashed into buckets and
sorted in them.  A new batch first loses, in a merge anti-join over the same buckets, every key that the runs already
know as frequent, and adds the rest as its own run of level 0.  When a level holds ``fanout`` runs they are merged into
one run of the next level, so a key is rewritten once per level and few runs are open at any time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmanual.llm.common import stored

BLANKS = b" \t\n\x0b\x0c\r"
HASH = ["a", "b"]


def line_digests(text: bytes, least: int = 1) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the 128-bit hash of each line's key (None where the key has under ``least`` code points).

    A key is the line without blanks at its ends, A-Z in lower case.
    """
    lines = text.split(b"\n")
    keys = [line.strip(BLANKS).lower() for line in lines]
    long = [len(k) >= least and (least < 2 or len(k.decode()) >= least) for k in keys]
    return lines, [hashlib.blake2b(k, digest_size=16).digest() if ok else None for k, ok in zip(keys, long)]


def count_lines(documents: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """(a, b, docs): number of rows of ``documents`` in which each line key stands, summed within a batch of rows only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(set(line_digests(raw or b"", least)[1]) - {None})
            if seen:
                pair = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(list(seen.values()), pa.int64())], [*HASH, "docs"])

    return documents.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "a long, b long, docs long")


class LineRuns:
    """Runs of line hashes by level, kept as bucketed and sorted tables of the session's warehouse.

    Every run is split into keys known as ``often`` (in ``min_docs`` documents or more) and others.  Counts of frequent
    keys are lower bounds: once known, a key is not counted any further.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, least: int = 1, fanout: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.least, self.fanout = spark, min_docs, least, max(2, fanout)
        # As many buckets as shuffled partitions: a batch then meets the runs without a second exchange.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, counted: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (counted.withColumn("often", F.col("docs") >= self.min_docs).write.partitionBy("often").bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .format("parquet").saveAsTable(name))
        return name

    def _merged(self, runs: list[str]) -> DataFrame:
        every = reduce(DataFrame.unionByName, [self.spark.table(run).select(*HASH, "docs") for run in runs])
        return every.groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def add(self, documents: DataFrame, text: str = "text") -> None:
        """Count a batch's lines, leave out those that the runs know as frequent, and add the rest as a run."""
        fresh = count_lines(documents, text, self.least).groupBy(*HASH).agg(F.sum("docs").alias("docs"))
        for run in self.runs():
            fresh = fresh.join(self.spark.table(run).where("often").select(*HASH).hint("merge"), HASH, "left_anti")
        self._push(self._write(fresh), 0)

    def _push(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._push(self._write(self._merged(merged)), level + 1)
            self._drop(merged)

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")

    def frequent(self) -> DataFrame:
        """(a, b) of the keys in at least ``min_docs`` documents of all batches."""
        if not self.runs():
            return self.spark.createDataFrame([], "a long, b long")
        return self._merged(self.runs()).where(F.col("docs") >= self.min_docs).select(*HASH)

    def close(self) -> None:
        """Drop the runs; tables read from :meth:`frequent` must be stored before."""
        self._drop(self.runs())
        self.levels = []


def drop_lines(documents: DataFrame, frequent: DataFrame, key: str = "doc_id", text: str = "text", least: int = 1, most_sent: int = 500_000) -> DataFrame:
    """``doc_id``, ``kept_text``, ``n_lines``, ``n_dropped`` of every row, without the lines whose hash is in ``frequent``.

    Up to ``most_sent`` hashes (16 bytes each) are sent to the tasks and texts stay where they are.  Beyond that the line
    hashes of each distinct text meet ``frequent`` in a join, and the found ones join back to the texts.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", documents.schema[key].dataType), T.StructField("kept_text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    few = frequent.count() <= most_sent
    sent = None
    if few:
        pairs = frequent.select(*HASH).toPandas()
        sent = documents.sparkSession.sparkContext.broadcast(np.stack([pairs["a"], pairs["b"]], axis=1).astype("<i8").tobytes())
    else:
        own = [F.xxhash64(F.lit(1), "text").alias("x"), F.xxhash64(F.lit(2), "text").alias("y")]
        rows = rows.select("*", *own)
        met = _text_lines(rows.select("x", "y", "text"), least).join(frequent, HASH, "left_semi")
        lost = met.groupBy("x", "y").agg(F.collect_set(F.struct(*HASH)).alias("lost"))
        rows = rows.join(lost, ["x", "y"], "left").select("doc_id", "text", F.transform("lost", lambda h: h["a"]).alias("la"), F.transform("lost", lambda h: h["b"]).alias("lb"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if few:
            flat = sent.value
            shared = {flat[i:i + 16] for i in range(0, len(flat), 16)}
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            if not few:
                halves = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            for i, raw in enumerate(texts):
                lines, digests = line_digests(raw, least)
                gone = shared if few else {np.array(p, "<i8").tobytes() for p in zip(*halves[i])} if halves[i][0] else ()
                left = [line for line, d in zip(lines, digests) if d not in gone]
                kept.append(b"\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             [f.name for f in schema])

    return rows.mapInArrow(cut, schema)


def _text_lines(texts: DataFrame, least: int) -> DataFrame:
    """(x, y, a, b): the distinct line hashes of each text named by (x, y); a text repeated in a batch is taken once."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            distinct = dict(zip(names, batch.column(2).cast(pa.binary()).to_pylist()))
            xs, ys, flat = [], [], []
            for (x, y), raw in distinct.items():
                found = set(line_digests(raw, least)[1]) - {None}
                xs += [x] * len(found)
                ys += [y] * len(found)
                flat += found
            pair = np.frombuffer(b"".join(flat), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["x", "y", *HASH])

    return texts.mapInArrow(spread, "x long, y long, a long, b long")


def split_batches(documents: DataFrame, batches: int, key: str = "doc_id") -> list[DataFrame]:
    """``documents`` in at most ``batches`` parts: whole input files where it reads several, else by a hash of the key."""
    spark, files = documents.sparkSession, sorted(documents.inputFiles())
    if len(files) > 1:
        groups = [files[i::batches] for i in range(min(batches, len(files)))]
        return [spark.read.schema(documents.schema).parquet(*group) for group in groups]
    return [documents.where(F.pmod(F.xxhash64(F.col(key)), F.lit(batches)) == i) for i in range(batches)]


def dedup_lines(documents: DataFrame, batches: list[DataFrame] | None = None, min_docs: int = 10, least: int = 1, fanout: int = 3,
                key: str = "doc_id", text: str = "text", most_sent: int = 500_000) -> DataFrame:
    """Every document without the lines whose key stands in at least ``min_docs`` documents: ``doc_id``, ``kept_text``, ``n_lines``, ``n_dropped``.

    ``batches`` are the parts in which ``documents`` arrived (one part, if not given).  Every row is a document of its own,
    also with a repeated or null key; a key that one document repeats counts once.  Null and empty texts are one empty
    line, which stays.  A document may lose all lines; its kept text is then empty.  An empty table gives no rows.
    """
    runs = LineRuns(documents.sparkSession, min_docs, least, fanout)
    for batch in batches or [documents]:
        runs.add(batch, text)
    frequent = stored(runs.frequent())
    runs.close()
    return drop_lines(documents, frequent, key, text, least, most_sent)


def line_digest(kept: DataFrame) -> DataFrame:
    """The kept texts as hashes."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
