"""Ordered computations over groups of any size, as prefix scans by a tree of summaries.

A plain window sorts a whole group in one task.  Where one group may hold a third of the table, the
order axis is cut into blocks: the work runs inside ``(keys, block)`` and leaves one summary row per
block (up-sweep).  Summaries are summarised again by runs of blocks until what is left of a group is
few rows; then every level takes over what lies before it (down-sweep) and hands it to the level below.

Sums and carried values cut by value, ``width`` values a block: a block holds at most ``width`` rows and
a run at most ``2 ** FAN_BITS`` blocks, however sparse or dense the axis.  Walks that need a program
(``keep_spaced``, ``finite_scan``) cut by row rank, so sparse axes do not give blocks of one row and
crowded ones no overfull block.  Order columns are not null; null keys form a group of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 65_536
FAN_BITS = 24  # summaries that one window of the tree streams through: 2 ** FAN_BITS
FAN = 4_096  # summaries that one task of a walk takes
_BLOCK = "__block"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def _checkpoint_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    import tempfile

    return str(Path(tempfile.mkdtemp(prefix="fieldmanual-checkpoint-")))


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder below the one that ``spark.checkpoint.dir`` names; in local mode without it, below one of this application."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = _checkpoint_dir(spark)
    return f"{_folders[app]}/{name}"


_folders: dict[str, str] = {}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below :func:`shared_path` and read from there: smaller than a checkpoint, and a reader takes only its columns."""
    path = shared_path(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocked(df: DataFrame, seq: str, width: int) -> DataFrame:
    return df.withColumn(_BLOCK, F.floor(F.col(seq) / F.lit(width)).cast("long"))


def _same(keys: Sequence[str]) -> list[str]:
    return [*keys, _BLOCK]


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on columns of one name where null meets null."""
    for c in on:
        right = right.withColumnRenamed(c, f"__on_{c}")
    same = [left[c].eqNullSafe(right[f"__on_{c}"]) for c in on]
    return left.join(right, reduce(and_, same), how).drop(*[f"__on_{c}" for c in on])


def _before(parts: DataFrame, keys: Sequence[str], names: Sequence[str], total: Callable[[str], Column],
            along: Callable[[str], Column], merge: Callable[[Column, Column], Column], bits: int,
            back: bool = False) -> DataFrame:
    """For each (keys, block) the combined summaries of all earlier blocks of its group (later ones if ``back``).

    ``bits`` is the size of the range of block numbers.  While it is too large for one window, runs of
    ``2 ** FAN_BITS`` blocks are combined by ``total``, solved in the same way, and given to their members.
    """
    order = F.col(_BLOCK).desc() if back else F.col(_BLOCK).asc()

    def frame(by: Sequence[str]):
        return W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)

    if bits <= FAN_BITS:
        return parts.select(*_same(keys), *[along(n).over(frame(keys)).alias(n) for n in names])
    runs = parts.withColumn("__run", F.shiftright(_BLOCK, FAN_BITS))
    sums = runs.groupBy(*keys, "__run").agg(*[total(n).alias(n) for n in names]).withColumnRenamed("__run", _BLOCK)
    above = _before(sums, keys, names, total, along, merge, bits - FAN_BITS, back).withColumnRenamed(_BLOCK, "__run")
    above = above.withColumnsRenamed({n: f"{n}_up" for n in names})
    inside = runs.select(*keys, "__run", _BLOCK, *[along(n).over(frame([*keys, "__run"])).alias(n) for n in names])
    return _meet(inside, above, [*keys, "__run"]).select(
        *_same(keys), *[merge(F.col(n), F.col(f"{n}_up")).alias(n) for n in names])


def _bits(width: int) -> int:
    return 65 - int(width).bit_length()


def running_sum(df: DataFrame, keys: Sequence[str], seq: str, value, out: str,
                inclusive: bool = True, width: int = WIDTH, tie: str | None = None) -> DataFrame:
    """Add the running sum of ``value`` in ``seq`` order of each group.

    ``seq`` is unique in a group, or ``tie`` orders the rows of one ``seq``.
    """
    b = _blocked(df.withColumn("__v", F.coalesce(value if isinstance(value, Column) else F.col(value), F.lit(0)).cast("long")),
                 seq, width)
    totals = b.groupBy(*_same(keys)).agg(F.sum("__v").alias("__c"))
    before = _before(totals, keys, ["__c"], F.sum, F.sum,
                     lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)), _bits(width))
    by = [seq, tie] if tie else [seq]
    inside = F.sum("__v").over(W.partitionBy(*_same(keys)).orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    done = _meet(b.withColumn("__in", inside), before, _same(keys))
    total = F.col("__in") + F.coalesce("__c", F.lit(0))
    if not inclusive:
        total = total - F.col("__v")
    return done.withColumn(out, total).drop("__v", "__in", "__c", _BLOCK)


def row_positions(df: DataFrame, keys: Sequence[str], seq: str, out: str, width: int = WIDTH,
                  tie: str | None = None) -> DataFrame:
    """Dense position (from 0) of each row in its group."""
    return running_sum(df, keys, seq, F.lit(1), out, inclusive=False, width=width, tie=tie)


def carry(df: DataFrame, keys: Sequence[str], seq: str, value: Column, out: str,
          direction: str = "last", inclusive: bool = True, width: int = WIDTH) -> DataFrame:
    """Last non-null ``value`` at or before each row (``direction='next'``: at or after it)."""
    return carry_many(df, keys, seq, {out: value}, direction, inclusive, width)


def carry_many(df: DataFrame, keys: Sequence[str], seq: str, values: dict[str, Column],
               direction: str = "last", inclusive: bool = True, width: int = WIDTH) -> DataFrame:
    """Carry several values along each group in one pass."""
    back = direction == "next"
    b = _blocked(df, seq, width)
    for i, v in enumerate(values.values()):
        b = b.withColumn(f"__v{i}", v)
    n = range(len(values))
    pick = F.min_by if back else F.max_by
    ends = b.groupBy(*_same(keys)).agg(*[
        pick(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), F.col(seq))).alias(f"__c{i}") for i in n])
    prior = _before(ends, keys, [f"__c{i}" for i in n],
                    lambda c: pick(c, F.when(F.col(c).isNotNull(), F.col(_BLOCK))),
                    lambda c: F.last(c, ignorenulls=True), lambda x, y: F.coalesce(x, y), _bits(width), back)
    by_seq = F.col(seq).desc() if back else F.col(seq).asc()
    inside = W.partitionBy(*_same(keys)).orderBy(by_seq).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    for i in n:
        b = b.withColumn(f"__i{i}", F.last(f"__v{i}", ignorenulls=True).over(inside))
    done = _meet(b, prior, _same(keys))
    for i, name in enumerate(values):
        done = done.withColumn(name, F.coalesce(f"__i{i}", f"__c{i}"))
    return done.drop(_BLOCK, *[f"__{x}{i}" for i in n for x in "vic"])


def previous(df: DataFrame, keys: Sequence[str], seq: str, value: Column, out: str,
             width: int = WIDTH) -> DataFrame:
    """Value of the row just before, NULL at the start of a group.  ``value`` may itself be NULL."""
    boxed = carry(df, keys, seq, F.struct(value.alias("v")), "__box", inclusive=False, width=width)
    return boxed.withColumn(out, F.col("__box.v")).drop("__box")


def _ranked(lean: DataFrame, keys: Sequence[str], width: int, tie: str | None = None) -> DataFrame:
    """Blocks of ``width`` rows by rank (``__q``, then ``tie``), the row's rank, and the run of blocks."""
    placed = row_positions(lean, keys, "__q", "__pos", tie=tie)
    return (placed.withColumn(_BLOCK, F.floor(F.col("__pos") / F.lit(width)).cast("long"))
            .withColumn("__run", F.floor(F.col(_BLOCK) / F.lit(FAN)).cast("long")))


def _long(lean: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of groups of more than one block; a group of one block is entered at its start and needs no map."""
    return _meet(lean, lean.filter(F.col(_BLOCK) > 0).select(*keys).distinct(), keys, "left_semi")


def _fields(df: DataFrame, keys: Sequence[str], *more: str) -> list[T.StructField]:
    by_name = {f.name: f for f in df.schema.fields}
    return [*[by_name[k] for k in keys], *[T.StructField(c, T.LongType()) for c in more]]


def _entries(maps: DataFrame, keys: Sequence[str], value: T.DataType, compose, follow) -> DataFrame:
    """(keys, block, ``entry``): the state in which every block is entered, from the map of every block.

    Runs of blocks are composed into one map each, the maps of a group's runs are followed from its start,
    then every run follows its blocks from its own entry.  ``compose(pdf)`` gives the rows of the map of a
    run, ``follow(pdf, entry)`` the entries of the blocks of ``pdf`` in order, ``entry`` None at the start.
    """
    names = list(keys)
    entry = T.StructField("entry", value)

    def join_run(pdf):
        return compose(pdf.sort_values([_BLOCK, "__at"], kind="stable"))

    def top(pdf):
        return placed(pdf, "__run", None)

    def down(pdf):
        first = pdf["entry"].iloc[0]
        return placed(pdf.drop(columns="entry"), _BLOCK, None if first is None or first != first else int(first))

    def placed(pdf, by, start):
        import pandas as pd

        blocks, states = follow(pdf.sort_values([by, "__at"], kind="stable"), by, start)
        out = pd.DataFrame({by: blocks, "entry": pd.array(states, dtype="Int64")})
        for n in reversed(names):
            out.insert(0, n, pd.Series([pdf[n].iloc[0]] * len(out), dtype=pdf[n].dtype))
        return out

    run_schema = T.StructType([f for f in maps.schema.fields if f.name != _BLOCK])
    runs = maps.groupBy(*names, "__run").applyInPandas(join_run, run_schema)
    starts = runs.groupBy(*names).applyInPandas(top, T.StructType([*_fields(maps, names, "__run"), entry]))
    return (_meet(maps, starts, [*names, "__run"]).groupBy(*names, "__run")
            .applyInPandas(down, T.StructType([*_fields(maps, names, _BLOCK), entry])))


def keep_spaced(df: DataFrame, keys: Sequence[str], seq: str, start: Column, reach: Column, gap: int,
                force: Column | None = None, out: str = "opens", width: int = WIDTH,
                tie: str | None = None) -> DataFrame:
    """Mark the rows that open a new span, walking each group in ``seq`` order.

    A row opens a span when it is the first of its group, when ``force`` holds, or when its
    ``reach`` is at least the ``start`` of the row that opened the current span plus ``gap``.
    ``start`` and ``reach`` must not fall along ``seq``.  ``tie`` orders rows of equal ``seq``.

    The walk depends on where the last span opened, so blocks of ``width`` rows are solved for every way
    they can be entered: only rows whose ``reach`` lies within ``gap`` of the block start can be the first
    to open inside it, and each leads to one last opener.  These few rows are the map of the block; maps are
    composed over runs of blocks, and every block is walked once from its true entry.
    """
    names = list(keys)
    forced = F.coalesce(force, F.lit(False)) if force is not None else F.lit(False)
    tied = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    lean = _ranked(df.select(*names, F.col(seq).cast("long").alias("__q"), tied.alias("__t"), start.cast("long").alias("__s"),
                             reach.cast("long").alias("__r"), forced.alias("__f")), names, width, "__t")
    paths_schema = T.StructType([*_fields(lean, names, "__run", _BLOCK, "__at", "since", "reach", "last"),
                                 T.StructField("forced", T.BooleanType())])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("__pos")
        s, r, f = (pdf[c].to_numpy() for c in ("__s", "__r", "__f"))
        last = s[_last_openers(_next_openers(s, r, f, gap))]
        # Candidate first openers: distinct reaches up to the first row that any earlier span must
        # yield to.  Spans opened before this block start no later than its first start.
        sure = np.flatnonzero(f | (r >= s[0] + gap))
        stop = sure[0] + 1 if len(sure) else len(s)
        first = np.flatnonzero(np.r_[True, r[1:stop] > r[:stop - 1]] | f[:stop])
        rows = pd.concat([pdf.iloc[[0]][[*names, "__run", _BLOCK]]] * len(first), ignore_index=True)
        rows["__at"], rows["since"], rows["reach"], rows["last"], rows["forced"] = first, s[0], r[first], last[first], f[first]
        return rows

    def compose(pdf):
        import numpy as np

        parts = [p for _, p in pdf.groupby(_BLOCK, sort=True)]
        reach_, last_, forced_ = (parts[-1][c].to_numpy() for c in ("reach", "last", "forced"))
        for p in reversed(parts[:-1]):
            r, x, f = (p[c].to_numpy() for c in ("reach", "last", "forced"))
            x = _leave(reach_, last_, forced_, x, gap)
            # What enters this run late enough to pass all of p meets the rows after it.
            yields = f.any() or r[-1] >= p["since"].iloc[0] + gap
            more = np.zeros(len(reach_), dtype=bool) if yields else (reach_ > r[-1]) | forced_
            hits = np.flatnonzero(more & (forced_ | (reach_ >= p["since"].iloc[0] + gap)))
            if len(hits):
                more[hits[0] + 1:] = False
            reach_, last_, forced_ = np.r_[r, reach_[more]], np.r_[x, last_[more]], np.r_[f, forced_[more]]
        rows = pdf.iloc[[0] * len(reach_)].drop(columns=_BLOCK).reset_index(drop=True)
        rows["__at"], rows["reach"], rows["last"], rows["forced"] = np.arange(len(reach_)), reach_, last_, forced_
        return rows

    def follow(pdf, by, state):
        import numpy as np

        blocks, states = [], []
        for block, p in pdf.groupby(by, sort=True):
            blocks.append(block)
            states.append(state)
            r, x, f = (p[c].to_numpy() for c in ("reach", "last", "forced"))
            state = int(x[0]) if state is None else int(_leave(r, x, f, np.array([state]), gap)[0])
        return blocks, states

    paths = _long(lean, names).groupBy(*names, "__run", _BLOCK).applyInPandas(solve, paths_schema)
    entries = _entries(paths, names, T.LongType(), compose, follow)
    opened_schema = T.StructType(_fields(lean, names, "__q", "__t"))

    def walk(pdf):
        import numpy as np

        pdf = pdf.sort_values("__pos")
        s, r, f = (pdf[c].to_numpy() for c in ("__s", "__r", "__f"))
        entry = pdf["entry"].iloc[0]
        at = 0
        if not (entry is None or entry != entry):
            hits = np.flatnonzero(f | (r >= int(entry) + gap))
            at = hits[0] if len(hits) else len(s)
        return pdf.iloc[_openers_from(_next_openers(s, r, f, gap), at)][[*names, "__q", "__t"]]

    opened = _meet(lean, entries, _same(names)).groupBy(*_same(names)).applyInPandas(walk, opened_schema)
    marks, on = opened.withColumnRenamed("__q", seq).withColumn(out, F.lit(True)), [*names, seq]
    if tie:
        marks, on = marks.withColumnRenamed("__t", tie), [*on, tie]
    else:
        marks = marks.drop("__t")
    return _meet(df, marks, on).withColumn(out, F.coalesce(out, F.lit(False)))


def _next_openers(s, r, f, gap):
    """Index of the row that opens the span after the one opened at each row."""
    import numpy as np

    n = len(s)
    by_gap = np.searchsorted(r, s + gap, side="left")
    by_gap = np.maximum(by_gap, np.arange(n) + 1)
    forced = np.flatnonzero(f)
    at = np.searchsorted(forced, np.arange(n), side="right")
    by_force = np.where(at < len(forced), forced[np.minimum(at, max(len(forced) - 1, 0))], n) if len(forced) else n
    return np.minimum(by_gap, by_force)


def _last_openers(nxt):
    """The last row reached from each row along ``nxt`` (``len(nxt)``: none), by doubling the jumps."""
    import numpy as np

    n = len(nxt)
    jump = np.where(nxt < n, nxt, np.arange(n))
    while True:
        far = jump[jump]
        if (far == jump).all():
            return jump
        jump = far


def _openers_from(nxt, at):
    """All rows reached from ``at`` along ``nxt``, in order: the rows reached double with every length of jump."""
    import numpy as np

    n = len(nxt)
    jumps = [np.r_[nxt, n]]
    while (jumps[-1][:n] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    reached = np.array([at])
    for jump in reversed(jumps):
        reached = np.r_[reached, jump[reached]]
    return np.unique(reached[reached < n])


def _leave(reach, last, forced, entry, gap):
    """Last opener after a block for each ``entry``; an entry that meets no candidate passes unchanged."""
    import numpy as np

    at = np.searchsorted(reach, entry + gap, side="left")
    must = np.flatnonzero(forced)
    if len(must):
        at = np.minimum(at, must[0])
    return np.where(at < len(reach), last[np.minimum(at, len(reach) - 1)], entry)


def finite_scan(df: DataFrame, keys: Sequence[str], seq: str, symbol: str, table, start: int,
                out: str = "state", width: int = WIDTH) -> DataFrame:
    """Run a small finite automaton over each group and add the state *before* and *after* each row.

    ``table[state][symbol]`` is the next state.  A row is a map of states; the maps of each block of ``width``
    rows are composed, the maps of blocks again over runs of blocks, and blocks are replayed from their entry.
    """
    table = [list(map(int, row)) for row in table]
    names = list(keys)
    lean = _ranked(df.select(*names, F.col(seq).cast("long").alias("__q"), F.col(symbol).cast("int").alias("__y")), names, width)
    map_schema = T.StructType([*_fields(lean, names, "__run", _BLOCK, "__at"), T.StructField("exits", T.ArrayType(T.IntegerType()))])

    def solve(pdf):
        import numpy as np

        pdf = pdf.sort_values("__pos")
        head = pdf.iloc[[0]][[*names, "__run", _BLOCK]].copy()
        head["__at"] = 0
        head["exits"] = [_prefix_maps(np.asarray(table).T[pdf["__y"].to_numpy()])[-1].tolist()]
        return head

    def compose(pdf):
        import numpy as np

        head = pdf.iloc[[0]].drop(columns=_BLOCK)
        head["exits"] = [_prefix_maps(np.array(pdf["exits"].tolist()))[-1].tolist()]
        return head

    def follow(pdf, by, state):
        import numpy as np

        first = start if state is None else state
        after = _prefix_maps(np.array(pdf["exits"].tolist()))[:, first].tolist()
        return pdf[by].tolist(), [first, *after[:-1]]

    maps = _long(lean, names).groupBy(*names, "__run", _BLOCK).applyInPandas(solve, map_schema)
    entries = _entries(maps, names, T.LongType(), compose, follow)
    state_schema = T.StructType([*_fields(lean, names, "__q"), T.StructField(f"{out}_before", T.IntegerType()),
                                 T.StructField(f"{out}_after", T.IntegerType())])

    def replay(batches):
        """All blocks of a task in order; the first row of a block is a map that forgets what lies before it."""
        import numpy as np

        steps, state = np.asarray(table).T, start
        for pdf in batches:
            y, fresh, entry = (pdf[c].to_numpy() for c in ("__y", "__fresh", "entry"))
            if not len(pdf):
                continue
            first = np.flatnonzero(fresh)
            maps = steps[y]
            maps[0] = maps[0][state]
            maps[first] = steps[y[first], entry[first]][:, None]
            after = _prefix_maps(maps)[:, 0]
            before = np.r_[state, after[:-1]]
            before[first] = entry[first]
            state = after[-1]
            yield pdf[[*names, "__q"]].assign(**{f"{out}_before": before.astype("int32"), f"{out}_after": after.astype("int32")})

    entered = _meet(lean, entries, _same(names)).select(*_same(names), "__q", "__pos", "__y", F.coalesce("entry", F.lit(start)).cast("int").alias("entry"),
                                                        (F.col("__pos") % width == 0).alias("__fresh"))
    states = (entered.repartition(*_same(names)).sortWithinPartitions(*_same(names), "__pos").mapInPandas(replay, state_schema)
              .withColumnRenamed("__q", seq))
    return _meet(df, states, [*names, seq], "inner")


def _prefix_maps(maps):
    """Row i: maps 0 to i applied one after another; pairs are composed first, so the work stays linear."""
    import numpy as np

    n = len(maps)
    if n == 1:
        return maps
    odd = _prefix_maps(np.take_along_axis(maps[1::2], maps[0:n - 1:2], axis=1))
    out = np.empty_like(maps)
    out[0], out[1::2] = maps[0], odd
    out[2::2] = np.take_along_axis(maps[2::2], odd[:len(maps[2::2])], axis=1)
    return out


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; Spark prunes to k per task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
