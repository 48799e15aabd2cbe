"""Exact top-k inner products by pivot-table elimination.

Distances of every vector to the pivots are computed once.  For a query they give, by the triangle inequality, the
least possible distance and so the greatest possible score of each candidate.  Candidates are taken in the order of
that bound, best first, until no remaining bound can reach the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmanual.llm.common import part_of, stored

BOUND = 1 << 26  # components beyond this would not fit the integer score of 64 dimensions
SLACK = 1e-6     # relative; distances are rounded, scores are not


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``vec_id``, ``v`` (array of long): floor(scale * x); without vectors that are null or hold null or non-finite components.

    Of several rows with one id the smallest vector stays.  Vectors of a length other than the most frequent one take
    no part, nor do rows with a null id.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    rows = vectors.where(sound).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v")).where(F.size("v") > 0)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of each row of ``x`` with ``q``; beyond 64 bits they saturate."""
    if not len(x) or max(np.abs(q).max(), np.abs(x).max()) < BOUND:
        return x @ q
    exact = x.astype(object) @ q.astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_tile(qid, q, qd, qn, floor_score, ids, x, xd, xn, k: int, step: int = 512):
    """The best k of one tile for one query, evaluated in bound order; and how many candidates were evaluated."""
    apart = np.abs(xd - qd).max(axis=1)
    norms = qn * qn + xn * xn
    bound = np.minimum((norms - apart * apart) / 2, qn * xn) + SLACK * (norms + 1)
    order = np.argsort(-bound, kind="stable")
    held_s, held_i, done = np.empty(0, np.int64), np.empty(0, np.int64), 0
    least = floor_score
    while done < len(order) and bound[order[done]] >= least:
        some = order[done:done + step]
        done += len(some)
        some = some[(bound[some] >= least) & (ids[some] != qid)]
        held_s, held_i = np.append(held_s, _score(q, x[some])), np.append(held_i, ids[some])
        best = _best(held_s, held_i, k)
        held_s, held_i = held_s[best], held_i[best]
        if len(held_s) == k:
            least = max(least, held_s[-1])
    keep = held_s >= floor_score
    return held_s[keep], held_i[keep], done


TILE = "tile long, ids binary, vectors binary, distances binary, norms binary"


def _unpack(row, dims: int, pivots: int):
    return (np.frombuffer(row.ids, np.int64), np.frombuffer(row.vectors, np.int64).reshape(-1, dims),
            np.frombuffer(row.distances, np.float64).reshape(-1, pivots), np.frombuffer(row.norms, np.float64))


def pivot_tiles(rows: DataFrame, pivots: np.ndarray, tile_rows: int, label: str) -> DataFrame:
    """Rows packed into tiles: near the same pivot, at most about ``tile_rows`` each, with distances to all pivots.

    Rows of one region are dealt over as many tiles as its size asks for, by a hash of the id.
    """

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].tolist()).astype(float)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "region": ((x[:, None, :] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)})

    placed = stored(rows.mapInPandas(near, "vec_id long, v array<long>, region long"))
    sizes = placed.groupBy("region").agg((F.floor(F.count(F.lit(1)) / tile_rows) + 1).alias("parts"))  # one row per pivot
    dealt = placed.join(F.broadcast(sizes), "region").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x = np.stack(group["v"].tolist())
        f = x.astype(float)
        d = np.sqrt(((f[:, None, :] - pivots[None]) ** 2).sum(axis=2))
        return pd.DataFrame({"tile": [int(group["region"].iloc[0]) << 40 | int(group["part"].iloc[0])], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                             "vectors": [x.astype(np.int64).tobytes()], "distances": [d.tobytes()], "norms": [np.sqrt((f * f).sum(axis=1)).tobytes()]})

    return dealt.groupBy("region", "part").applyInPandas(pack, TILE).select(*[F.col(c).alias(f"{label}_{c}") for c in ("tile", "ids", "vectors", "distances", "norms")])


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, pivots: int = 16,
                pivot_sample: int = 2048, tile_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k highest integer inner products of every query, ties to the smaller id.

    Queries are the rows for which ``is_query`` (a column of ``vec_id``) holds; candidates are all rows but the query's
    own.  With fewer than k candidates all are returned.  Pivots come from a sample of about ``pivot_sample`` rows, each
    the furthest from those before; any pivots give the same result.  First every query meets the tiles of its own
    region, which sets the score to beat; then blocks of queries meet the other tiles whose bounds still reach it.
    """
    rows = stored(quantised(vectors, key, vector, scale))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = lengths[0]["n"]
    rows = rows.where(F.size("v") == dims)
    sample = np.array([r["v"] for r in part_of(rows, "vec_id", pivot_sample).orderBy(F.xxhash64("vec_id")).limit(2 * pivot_sample).collect()] or [rows.first()["v"]], float)
    chosen = [sample[0]]
    far = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < pivots and far.max() > 0:
        chosen.append(sample[far.argmax()])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
    table = np.stack(chosen)
    width = len(table)
    tiles = stored(pivot_tiles(rows, table, tile_rows, "t"))
    blocks = stored(pivot_tiles(rows.where(is_query), table, query_rows, "q").withColumn("region", F.shiftright("q_tile", 40)))

    def meet(with_floor: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    q = _unpack(pd.Series({"ids": row.q_ids, "vectors": row.q_vectors, "distances": row.q_distances, "norms": row.q_norms}), dims, width)
                    t = _unpack(pd.Series({"ids": row.t_ids, "vectors": row.t_vectors, "distances": row.t_distances, "norms": row.t_norms}), dims, width)
                    floors = np.frombuffer(row.floors, np.int64) if with_floor else np.full(len(q[0]), -(1 << 63), np.int64)
                    out = []
                    for i, qid in enumerate(q[0].tolist()):
                        scores, ids, _ = search_tile(qid, q[1][i], q[2][i], q[3][i], floors[i], *t, k)
                        out += zip([qid] * len(ids), ids.tolist(), scores.tolist())
                    yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
        return run

    best = lambda found: found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    found_type = "query_id long, vec_id long, score long"
    home = blocks.join(tiles, F.col("region") == F.shiftright("t_tile", 40)).repartition("q_tile", "t_tile")
    first = stored(best(home.mapInPandas(meet(False), found_type)))
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(-(1 << 63))).alias("floor"))

    def ranges(prefix: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for tile, d, n in zip(batch[f"{prefix}_tile"], batch[f"{prefix}_distances"], batch[f"{prefix}_norms"]):
                    d = np.frombuffer(d, np.float64).reshape(-1, width)
                    out.append((tile, d.min(axis=0).tolist(), d.max(axis=0).tolist(), float(np.frombuffer(n, np.float64).max())))
                yield pd.DataFrame(out, columns=[f"{prefix}_tile", f"{prefix}_low", f"{prefix}_high", f"{prefix}_norm"])
        return run

    spans = lambda df, p: df.select(f"{p}_tile", f"{p}_distances", f"{p}_norms").mapInPandas(ranges(p), f"{p}_tile long, {p}_low array<double>, {p}_high array<double>, {p}_norm double")

    def with_floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"q_tile": batch["q_tile"], "query_id": batch["q_ids"].map(lambda b: np.frombuffer(b, np.int64))})

    asked = blocks.select("q_tile", "q_ids").mapInPandas(with_floors, "q_tile long, query_id array<long>").select("q_tile", F.explode("query_id").alias("query_id"))
    to_beat = asked.join(floors, "query_id", "left").select("q_tile", "query_id", F.coalesce("floor", F.lit(-(1 << 63))).alias("floor"))
    block_floor = to_beat.groupBy("q_tile").agg(F.min("floor").alias("least"), F.array_sort(F.collect_list(F.struct("query_id", "floor"))).alias("floors"))
    # Blocks of the stated query set against tiles: one row per block and tile, cut by their bounds before any vector moves.
    gaps = F.zip_with(F.zip_with("q_low", "t_high", lambda a, b: a - b), F.zip_with("t_low", "q_high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    gap = F.array_max(gaps)
    square = F.col("q_norm") * F.col("q_norm") + F.col("t_norm") * F.col("t_norm")
    reach = F.least((square - gap * gap) / 2, F.col("q_norm") * F.col("t_norm")) + SLACK * (square + 1)
    pairs = spans(blocks, "q").join(block_floor.select("q_tile", "least"), "q_tile").crossJoin(spans(tiles, "t")).where(
        (F.shiftright("q_tile", 40) != F.shiftright("t_tile", 40)) & (reach >= F.col("least"))).select("q_tile", "t_tile")

    def line_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"q_tile": batch["q_tile"], "floors": batch["floors"].map(lambda rows: np.array([r["floor"] for r in rows], np.int64).tobytes())})

    lined = block_floor.select("q_tile", "floors").mapInPandas(line_up, "q_tile long, floors binary")
    met = stored(pairs).join(blocks.drop("region").join(lined, "q_tile"), "q_tile").join(tiles, "t_tile").repartition("q_tile", "t_tile")
    every = first.select("query_id", "vec_id", "score").unionByName(met.mapInPandas(meet(True), found_type))
    return best(every).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
