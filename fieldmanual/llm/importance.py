"""Importance resampling towards a target distribution, over hashed word n-grams.

A task joins a batch's texts with sentinels and finds all words in one regular-expression pass.  The document of a word
is looked up among the document offsets; n-grams whose words belong to different documents are masked before they are
counted by bucket.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmanual.llm.common import key_text, stored

# In UTF-8 every character outside ASCII is made of bytes from 0x80 on.  The group keeps the words between the gaps.
WORD = re.compile(rb"([0-9a-z\x80-\xff]+)")
SENTINEL = b"\n"
ROW_BITS = 33  # monotonically_increasing_id() holds the row of a partition in its low 33 bits


class Buckets(dict):
    """Bucket of a feature, remembered for words seen before."""

    def __init__(self, count: int, most: int = 500_000):
        super().__init__()
        self.count, self.most = count, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        made = self[feature] = zlib.crc32(feature) % self.count
        return made


def batch_features(texts: list[bytes], longest: int, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and of every feature (runs of 1 to ``longest`` words) its text's place and its bucket."""
    parts = WORD.split(SENTINEL.join(texts).lower())  # gap, word, gap, word, ..., gap
    words = parts[1::2]
    starts = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[0:-1:2]  # a word starts where the gap before it ends
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + len(SENTINEL))
    owner = np.searchsorted(ends, starts, side="right")
    owners, cells = [owner], [np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))]
    for n in range(2, longest + 1):
        inside = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:])
        owners.append(owner[inside])
        cells.append(np.fromiter((zlib.crc32(b" ".join(words[i:i + n])) % buckets.count for i in inside.tolist()), np.int64, len(inside)))
    return np.bincount(owner, minlength=len(texts)), np.concatenate(owners), np.concatenate(cells)


def _chunks(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in runs of about ``most_bytes``, each with the row it starts at; a null text is empty."""
    low, size, run = 0, 0, []
    for row, text in enumerate(batch.column(column).cast(pa.binary()).to_pylist()):
        run.append(text or b"")
        size += len(run[-1])
        if size >= most_bytes:
            yield low, run
            low, size, run = row + 1, 0, []
    if run:
        yield low, run


def bucket_counts(rows: DataFrame, buckets: int = 10_000, longest: int = 1, text: str = "text") -> np.ndarray:
    """Features per bucket over all ``rows``; a task sends at most one row per bucket, the driver gets ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch, 0):
                total += np.bincount(batch_features(texts, longest, known)[2], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    parts = rows.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and corpus shares, per bucket, rounded down."""
    cells, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + cells) / ((s + 1.0) * (t_all + cells)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def importance_weights(documents: DataFrame, gains: np.ndarray, longest: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (sum of the gains of all features) of every row."""
    sent = documents.sparkSession.sparkContext.broadcast(gains)
    schema = T.StructType([T.StructField("doc_id", documents.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        known = Buckets(len(gain))
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for low, texts in _chunks(batch, 1):
                n_words, owner, cell = batch_features(texts, longest, known)
                span = slice(low, low + len(texts))
                out[0, span], out[1, span] = n_words, np.bincount(owner, minlength=len(texts))
                out[2, span] = np.bincount(owner, weights=gain[cell], minlength=len(texts))  # whole numbers below 2^53: exact
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], [f.name for f in schema])

    return documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(weigh, schema)


def gumbel_noise(key: str = "doc_id", seed: int = 2024):
    """Thousandths of a Gumbel variate that depends on the seed and the key alone, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key_text(key)), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def with_ranks(rows: DataFrame, order: list, drawn: int, partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (from 1, in ``order``) to the first ``drawn`` rows, null to the others.

    Rows are sorted over range partitions; a row's rank is its place in its partition plus the sizes of those before.  Only
    one number per partition is summed outside the sort.  ``order`` should end in a column that tells equal rows apart.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row per partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    met = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return met.withColumn("rank", F.when(rank <= drawn, rank)).drop("__part", "__at", "__before")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024,
             key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``documents``.

    Scores are weights plus Gumbel noise, so the highest ones are a draw without replacement in proportion to the
    weights' exponentials.  Of the rows with ``least_words`` words or more the highest ``percent`` are drawn and ranked;
    ties go to the smaller key, null keys last, then to any order.  Every row is a document of its own, also with a
    repeated or null key (a null key is hashed as empty text).  Null texts and texts without a word have no feature and
    weight 0.  With an empty target all shares are smoothed ones; an empty table gives no rows.
    """
    gains = bucket_gains(bucket_counts(documents, buckets, longest, text), bucket_counts(target, buckets, longest, target_text))
    weighed = importance_weights(documents, gains, longest, key, text)
    # Rows get a number when they are stored, which tells rows with one key and score apart.
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel_noise("doc_id", seed)).withColumn("__row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = with_ranks(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")], drawn)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
