"""Mixing sources to target weights by entropy balancing.

Document rates are the least departure (relative entropy, weighted by tokens) from taking each document once
that meets token constraints.  The dual is convex: one multiplier per constraint, and a document's rate is the
exponential of the sum of its multipliers.  Newton steps run as aggregations over cells of equal constraints;
inside one margin the Hessian is diagonal, so each step updates all of its multipliers at once.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmanual.llm.common import WORD, stored


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``source``, ``source_size``, ``target``: sources by code point (null last) weigh ``weights``, repeating.

    Targets share the whole size, stop at ``cap`` times their source, and the excess is shared again by weight.
    That ends where every source has the smaller of its cap and one common level times its weight; the level
    follows from the order in which sources reach their cap.  One row per source meets in the ordered windows.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int")))
    by_cap = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    table = table.withColumn("limit", F.col("source_size") * float(cap))
    table = table.withColumn("earlier", F.coalesce(F.sum("limit").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    table = table.withColumn("later_weight", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
    level = (F.sum("source_size").over(everything) - F.col("earlier")) / F.col("later_weight")
    table = table.withColumn("level", level)
    reached = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    table = table.withColumn("common", F.first(reached, ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return table.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("common") * F.col("weight"), F.col("limit"))).alias("target"))


def entropy_balance(cells: DataFrame, margins: Mapping[str, DataFrame], mass: str = "mass", tolerance: float = 1e-9, most_steps: int = 60) -> DataFrame:
    """Add ``rate`` to cells so that rate times mass meets ``margins[column](column, target)`` in every margin.

    A cell is a combination of margin values with the tokens of its documents.  Values without a target and
    values with target 0 get rate 0.  Steps go on until no constraint is off by more than ``tolerance`` of its
    target, or ``most_steps`` are done (margins that contradict each other have no solution); a warning then tells how
    far the worst constraint is off.  A step raises a rate by the factor e at most, so that far targets do not overflow.
    """
    named = cells.withColumn("log_rate", F.lit(0.0))
    multipliers = {}
    for i, (column, targets) in enumerate(margins.items()):
        goal = targets.select(F.col(column).alias(f"__m{i}"), F.col("target").cast("double").alias(f"__t{i}"))
        named = named.join(goal, F.col(column).eqNullSafe(F.col(f"__m{i}")), "left").drop(f"__m{i}")
        multipliers[i] = column
    allowed = [F.coalesce(F.col(f"__t{i}"), F.lit(0.0)) > 0 for i in multipliers]
    live = allowed[0]
    for more in allowed[1:]:
        live = live & more
    named = stored(named.withColumn("live", live & (F.col(mass) > 0)))
    done, worst = 0, 0.0
    while done < most_steps:
        worst = 0.0
        for i, column in multipliers.items():
            held = named.where("live").groupBy(column).agg(
                F.sum(F.col(mass) * F.exp("log_rate")).alias("__held"), F.first(f"__t{i}").alias("__goal"))
            step = held.select(F.col(column).alias("__key"), F.least((F.col("__goal") - F.col("__held")) / F.col("__held"), F.lit(1.0)).alias("__step"),
                               (F.abs(F.col("__held") - F.col("__goal")) / F.col("__goal")).alias("__off"))
            step = stored(step)
            off = step.agg(F.max("__off")).first()[0]
            worst = max(worst, off or 0.0)
            named = named.join(step, F.col(column).eqNullSafe(F.col("__key")), "left").withColumn(
                "log_rate", F.col("log_rate") + F.coalesce("__step", F.lit(0.0))).drop("__key", "__step", "__off")
        done += 1
        if worst <= tolerance:
            break
        if done % 4 == 0:
            named = stored(named)
    if worst > tolerance:
        warnings.warn(f"after {done} steps a constraint is off by {worst:.3g} of its target", stacklevel=2)
    rate = F.when(F.col("live"), F.exp("log_rate")).otherwise(F.lit(0.0))
    return named.withColumn("rate", rate).drop("log_rate", "live", *[f"__t{i}" for i in multipliers])


def round_rates(rated: DataFrame, bucket_rows: int = 8192) -> DataFrame:
    """Add ``copies`` to rows with ``source``, ``source_rows``, ``size``, ``rate`` and ``order``: whole numbers next to the rate.

    All rows of a source have one rate.  In the order of a hash, rows take the higher number until they hold the words that
    the lower number leaves open, so a source is off by half a document at most.  The hash axis of each source is cut into
    ranges of about ``bucket_rows`` rows; what is taken in one range enters the next as a running sum of the ranges.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / bucket_rows))
    place = (F.col("order").cast("double") / float(2 ** 64) + 0.5) * parts
    rated = rated.withColumn("bucket", F.least(F.floor(place), parts - 1))
    sums = rated.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("start"))
    met = rated.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b"))).drop("__s", "__b")
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("order", "size").rowsBetween(W.unboundedPreceding, 0))
    low = F.floor(F.col("rate") + 1e-12)
    share = F.when(F.col("rate") - low > 1e-12, F.col("rate") - low).otherwise(0.0)
    up = (F.col("size") > 0) & (F.col("start") + inside - F.col("size") / 2 <= share * F.col("source_size")) & (share > 0)
    return met.withColumn("copies", (low + up.cast("int")).cast("long")).drop("bucket", "start")


def mix_sources(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, bucket_rows: int = 8192, key: str = "doc_id",
                text: str = "text", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Copies per document that bring every source near its target number of words.

    A document's size is its number of words (null text: 0).  A null source is a source of its own, last in order.
    Repeated rows are separate documents.  No document gets more than ``ceil(cap)`` copies.  Rounding goes by a hash of
    key and size, in ranges of about ``bucket_rows`` rows of one source (see :func:`round_rates`), so a large source
    spreads over many tasks, a source ends within half a document of its target, and reruns agree.  An empty table gives no rows; a source without words takes none.
    """
    slim = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = stored(slim)
    targets = stored(source_targets(sizes, weights, cap))
    cells = targets.select("source", F.col("source_size").alias("mass"))
    rates = entropy_balance(cells, {"source": targets}).select("source", "rate")
    plan = targets.join(rates.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    plan = stored(plan.withColumnRenamed("source", "__s"))
    rows = sizes.groupBy(F.col("source").alias("__n")).agg(F.count("*").alias("source_rows"))
    plan = stored(plan.join(rows, F.col("__s").eqNullSafe(F.col("__n"))).drop("__n"))
    rated = sizes.join(F.broadcast(plan) if plan.count() <= 100_000 else plan, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rounded = round_rates(rated.withColumn("order", F.xxhash64(F.col("doc_id"), F.col("size"))), bucket_rows)
    return rounded.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
