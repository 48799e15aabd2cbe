"""Sharding by minimax contiguous partition.

Texts are atomic groups, ordered by a 64-bit hash.  The smallest capacity for which a greedy left-to-right
fill needs no more than the wanted shards is found by binary search; the shards are cut where that fill
cuts.  The search runs on cells of the hash axis: sums of a bounded number of cells come to the driver,
and only cells in which a cut can still fall are divided further, until the capacity is certain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmanual.llm.common import stored


def _fill(prefix, capacity, shards, atomic=None):
    """Bytes before each of the ``shards - 1`` cuts of a greedy fill, and whether everything found room.

    Cells are not divided, or with ``atomic`` only those that are not atomic.
    """
    at, cuts, total = 0, [], int(prefix[-1])
    for _ in range(shards - 1):
        i = int(np.searchsorted(prefix, at + capacity, side="right")) - 1
        if i >= len(prefix) - 1:
            at = total
        elif atomic is None or atomic[i]:
            at = max(at, int(prefix[i]))
        else:
            at = at + capacity
        cuts.append(at)
    return cuts, at + capacity >= total


def _smallest(prefix, low, shards, atomic=None):
    """The smallest capacity of at least ``low`` with which a greedy fill finds room, by binary search."""
    high = max(low, int(prefix[-1]))
    while low < high:
        middle = (low + high) // 2
        if _fill(prefix, middle, shards, atomic)[1]:
            high = middle
        else:
            low = middle + 1
    return low


def _cells(groups: DataFrame, bits: int) -> list[tuple[int, int, bool]]:
    """(first key, bytes, holds one group) of the non-empty cells that ``bits`` leading bits make, in order."""
    found = groups.groupBy(F.shiftright("order_key", 64 - bits).alias("cell")).agg(
        F.sum("size").alias("bytes"), F.min("order_key").alias("first"), F.max("order_key").alias("last")).collect()
    return sorted((r["first"], r["bytes"], r["first"] == r["last"]) for r in found)


def contiguous_cuts(groups: DataFrame, shards: int, first_bits: int = 14, step_bits: int = 10) -> tuple[list[int], int]:
    """Cut keys (the first key of each later shard) and capacity of the minimax partition.

    ``groups`` holds ``order_key`` (long, one value per atomic group; rows of a group may repeat) and ``size``.
    At most ``2 ** first_bits`` sums are gathered first; each further level divides only cells that a cut may
    fall into.  Empty input has no cuts and capacity 0.
    """
    bits, cells = first_bits, _cells(groups, first_bits)
    if not cells:
        return [], 0
    while True:
        prefix = np.concatenate([[0], np.cumsum([c[1] for c in cells], dtype=np.int64)])
        atomic = np.array([c[2] for c in cells])
        least = max(-(-int(prefix[-1]) // shards), max((c[1] for c in cells if c[2]), default=1))
        low = _smallest(prefix, least, shards, atomic)
        high = _smallest(prefix, low, shards)
        if low == high or bits == 64:
            break
        nearest, furthest = _fill(prefix, low, shards)[0], _fill(prefix, high, shards, atomic)[0]
        to_open = {i for a, b in zip(nearest, furthest)
                   for i in range(max(0, int(np.searchsorted(prefix, a, side="right")) - 1), min(len(cells), int(np.searchsorted(prefix, b, side="right"))))
                   if not atomic[i]}
        if not to_open:
            break
        wider = min(64, bits + step_bits)
        wanted = [cells[i][0] >> (64 - bits) for i in sorted(to_open)]
        inner = _cells(groups.where(F.shiftright("order_key", 64 - bits).isin(wanted)), wider)
        cells, bits = sorted([c for i, c in enumerate(cells) if i not in to_open] + inner), wider
    first_key = dict(zip(prefix[:-1].tolist(), (c[0] for c in cells)))
    return [first_key[c] for c in _fill(prefix, high, shards)[0] if c in first_key], high


def shard_documents(documents: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Give every document a shard and a slot; sizes of shards are as near equal as whole text groups allow.

    A document's size is the UTF-8 length of its text (0 where null) plus ``overhead``.  Equal texts stay
    together, null ones with empty ones.  Rows with equal keys are separate documents.  Slots count from 0 in each shard without
    a gap.  An empty table gives no rows; a shard may stay empty where one group is larger than its share.
    Columns besides key and text are ignored.
    """
    slim = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = stored(slim.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("order_key"),
        F.spark_partition_id().alias("split")))
    cuts, _ = contiguous_cuts(base, shards)
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("order_key"))) if cuts else F.lit(0)
    placed = base.withColumn("shard", shard.cast("int"))
    # A split holds as many rows as a task has read, so numbering inside (shard, split) never meets a large group.
    counts = placed.groupBy("shard", "split").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select("shard", "split", F.coalesce(F.sum("rows").over(
        W.partitionBy("shard").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("shard", "split").orderBy("order_key", "doc_id", "size")) - 1
    return placed.withColumn("inside", inside).join(before, ["shard", "split"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
