"""Documents scored by the difference of cross-entropy under two matched n-gram models.

The target model learns from wanted documents, the background model from all others.  Both have the same form and
one vocabulary: every word of the corpus.  All words and all pairs of adjacent words are counted; the counts are
tables that grow with the corpus.  A word stands there as 64 bits of its hash, a pair as those of both words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmanual.llm.common import sent_whole, stored

TOKEN = re.compile(r"\w+|[^\w\s]")
START = 0  # stands before the first word of a text


@dataclass
class MatchedModels:
    """Stored counts (target ``t``, background ``b``) of words ``w`` and of pairs ``w1``, ``w2``, and their sums."""

    words: DataFrame
    pairs: DataFrame
    size: int
    totals: tuple[int, int]
    keep: float = 0.7
    smooth: float = 0.5


def _pairs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, second word and text number of every adjacent pair; the first word of a text follows ``START``."""
    rows = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    words = np.array([w for r in rows for w in r], object)
    second = np.maximum(pd.util.hash_array(words, categorize=True), np.uint64(1)).view(np.int64) if len(words) else np.zeros(0, np.int64)
    first = np.concatenate(([START], second[:-1])).astype(np.int64) if len(words) else second
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return first, second, np.repeat(np.arange(len(texts)), sizes)


def _mixed(first: np.ndarray, second: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of a pair, to sort by; equal bits say nothing about equal pairs."""
    mixed = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) + second.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Positions at which any of the columns changes."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return np.flatnonzero(new)


def fit_models(flagged: DataFrame, text: str = "text", wanted: str = "wanted", held_tokens: int = 3_000_000) -> MatchedModels:
    """Fit both models on all rows; ``wanted`` (boolean, null counts as false) says which rows teach the target.

    A task adds up ``held_tokens`` tokens before it sends their counts on; this does not change the result.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def summed(parts) -> pd.DataFrame:
            first, second, target = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(_mixed(first, second))
            first, second, target = first[order], second[order], target[order]
            at = _starts(first, second)
            t = np.add.reduceat(target.astype(np.int64), at)
            return pd.DataFrame({"w1": first[at], "w2": second[at], "t": t, "b": np.diff(np.append(at, len(first))) - t})

        parts, held = [], 0
        for batch in batches:
            first, second, row = _pairs_of(batch["text"].tolist())
            if len(first):
                parts.append((first, second, batch["wanted"].to_numpy(bool)[row]))
                held += len(first)
            if held >= held_tokens:
                yield summed(parts)
                parts, held = [], 0
        if parts:
            yield summed(parts)

    slim = flagged.select(F.col(text).alias("text"), F.coalesce(F.col(wanted), F.lit(False)).alias("wanted"))
    sums = [F.sum("t").alias("t"), F.sum("b").alias("b")]
    pairs = stored(slim.mapInPandas(count, "w1 long, w2 long, t long, b long").groupBy("w1", "w2").agg(*sums))
    words = stored(pairs.groupBy(F.col("w2").alias("w")).agg(*sums))  # every token is the second of one pair
    r = words.agg(F.count("*").alias("n"), *[F.coalesce(s, F.lit(0)).alias(k) for s, k in zip(sums, "tb")]).first()
    return MatchedModels(words, pairs, r["n"] + 1, (r["t"], r["b"]))  # one more for a word that no text holds


def _alone(models: MatchedModels, model: int, count: Column) -> Column:
    return (F.coalesce(count, F.lit(0)) + models.smooth) / (models.totals[model] + models.smooth * models.size)


def pair_losses(models: MatchedModels, pairs: DataFrame) -> DataFrame:
    """``w1``, ``w2`` and the losses ``lt``, ``lb`` of the second word after the first, for counted pairs."""
    one, two = (models.words.select(F.col("w").alias(w), F.col("t").alias(f"t_{w}"), F.col("b").alias(f"b_{w}")) for w in ("w1", "w2"))
    met = pairs.join(one, "w1", "left").join(two, "w2", "left")

    def loss(model: int, k: str) -> Column:
        alone, after = _alone(models, model, F.col(f"{k}_w2")), F.col(k) / F.greatest(F.col(f"{k}_w1"), F.lit(1))
        return -F.log(F.when(F.col("w1") == START, alone).otherwise(models.keep * after + (1 - models.keep) * alone))

    return met.select("w1", "w2", loss(0, "t").alias("lt"), loss(1, "b").alias("lb"))


def _frequent(models: MatchedModels, most: int) -> int:
    """The least count that at most ``most`` pairs reach."""
    steps = models.pairs.groupBy(F.least(F.col("t") + F.col("b"), F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, held = 10_001, 0
    for r in steps:
        held += r["count"]
        if held > most:
            break
        least = r["n"]
    return least


def score_documents(documents: DataFrame, models: MatchedModels, key: str = "doc_id", text: str = "text", learnt: bool = False,
                    most_sent: int = 500_000) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss``, ``score`` (mean per-token difference; low is like the target).

    Losses of the most frequent pairs (at most ``most_sent``) are sent to the tasks, all others are joined; where the
    line falls does not change the scores.  ``learnt``: the models learnt from all these texts, so no pair is unknown.
    """
    many = F.col("t") + F.col("b") >= _frequent(models, most_sent)
    head = pair_losses(models, models.pairs.where(many)).toPandas()
    first, second, seed = head["w1"].to_numpy(np.int64), head["w2"].to_numpy(np.int64), 0
    while len(np.unique(_mixed(first, second, seed))) < len(first):
        seed += 1
    order = np.argsort(_mixed(first, second, seed))
    first, second, both = first[order], second[order], head[["lt", "lb"]].to_numpy(float)[order]
    shared = documents.sparkSession.sparkContext.broadcast((seed, _mixed(first, second, seed), first, second, both))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed, mixed, known_first, known_second, losses = shared.value
        for batch in batches:
            rows = batch["row"].to_numpy(np.int64)
            w1, w2, row = _pairs_of(batch["text"].tolist())
            mine = _mixed(w1, w2, seed)
            at = np.minimum(np.searchsorted(mixed, mine), max(len(mixed) - 1, 0))
            sent = (known_first[at] == w1) & (known_second[at] == w2) if len(mixed) else np.zeros(len(w1), bool)
            own = [np.bincount(row[sent], losses[at[sent], m], len(rows)) if sent.any() else np.zeros(len(rows)) for m in (0, 1)]
            # One sum for every row; its own hash stands for a pair that does not exist, so that sums are spread.
            yield pd.DataFrame({"row": rows, "w1": rows, "w2": rows, "n": np.bincount(row[sent], minlength=len(rows)), "own_t": own[0], "own_b": own[1]})
            w1, w2, row, mine = w1[~sent], w2[~sent], row[~sent], mine[~sent]
            order = np.lexsort((mine, row))
            w1, w2, row = w1[order], w2[order], row[order]
            at = _starts(row, w1, w2)
            yield pd.DataFrame({"row": rows[row[at]], "w1": w1[at], "w2": w2[at], "n": np.diff(np.append(at, len(row))), "own_t": np.nan, "own_b": np.nan})

    slim = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("row", F.xxhash64("doc_id", "text"))
    asked = slim.select("row", "text").mapInPandas(ask, "row long, w1 long, w2 long, n long, own_t double, own_b double")
    met = asked.join(pair_losses(models, models.pairs.where(~many)), ["w1", "w2"], "left")
    if learnt:
        losses = [F.col("lt"), F.col("lb")]
    else:
        met = met.join(models.words.withColumnRenamed("w", "w2"), "w2", "left")
        weight = F.when(F.col("w1") == START, 1.0).otherwise(1 - models.keep)
        losses = [F.coalesce(F.col(known), -F.log(weight * _alone(models, m, F.col(k)))) for m, (known, k) in enumerate((("lt", "t"), ("lb", "b")))]
    own = [F.when(~F.isnan(c), F.col(c)) for c in ("own_t", "own_b")]
    sums = [F.sum(F.coalesce(o, F.col("n") * loss)).alias(name) for o, loss, name in zip(own, losses, ("st", "sb"))]
    # Equal rows share a hash and add the same sums and numbers of tokens, so their means stay.
    per_row = met.groupBy("row").agg(F.sum("n").alias("all"), F.count(own[0]).alias("copies"), *sums).select(
        "row", F.expr("all div copies").alias("n_tokens"), *[F.when(F.col("all") > 0, F.col(s) / F.col("all")).alias(c) for s, c in (("st", "target_loss"), ("sb", "background_loss"))])
    out = slim.select("doc_id", "row").join(per_row, "row", "left")
    return out.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def cross_entropy_difference(documents: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Score all documents; those whose key is in ``wanted`` (one column of that name) teach the target model.

    A null, empty or blank text has 0 tokens and null losses.  Repeated rows count and are scored as often as they
    stand there; null keys are never wanted; an empty table gives no rows.  Without a wanted document the target
    model is uniform.
    """
    slim = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    marks = wanted.select(F.col(key).alias("doc_id")).where("doc_id is not null").distinct().withColumn("wanted", F.lit(True))
    flagged = slim.join(sent_whole(stored(marks)), "doc_id", "left").select("text", "wanted")
    return score_documents(documents, fit_models(flagged, **options), key, text, learnt=True)
