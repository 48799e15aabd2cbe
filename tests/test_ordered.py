"""Block-wise ordered operators against a plain walk, with blocks far smaller than the groups."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fieldmanual.operators import ordered as od


def walk(rows, gap):
    kept, last = [], None
    for q, start, reach, force in rows:
        if last is None or force or reach >= last + gap:
            kept.append(q)
            last = start
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_keep_spaced_equals_walk(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], []
    for key in ("hot", "b", "c"):
        at, group = 0, []
        for q in range(300 if key == "hot" else 7):
            at += rnd.choice([0, 1, 5, 40])
            group.append((q, at, at, rnd.random() < 0.05))
        rows += [(key, *r) for r in group]
        want += [(key, q) for q in walk(group, 60)]
    df = spark.createDataFrame(rows, "k string, q long, s long, r long, f boolean")
    got = od.keep_spaced(df, ["k"], "q", F.col("s"), F.col("r"), 60, force=F.col("f"), width=16).filter("opens").select("k", "q").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_running_sum_carry_previous(spark):
    rows = [("a", i, i % 3, None if i % 5 else f"v{i}") for i in range(97)] + [("b", 4, 9, "x")]
    df = spark.createDataFrame(rows, "k string, q long, n int, v string")
    out = {(r.k, r.q): r for r in od.previous(od.carry(od.running_sum(df, ["k"], "q", "n", "total", width=8), ["k"], "q", F.col("v"), "last", width=8),
                                             ["k"], "q", F.col("v"), "prev", width=8).collect()}
    total, last = 0, None
    for k, q, n, v in rows[:97]:
        prev = rows[q - 1][3] if q else None
        total, last = total + n, v or last
        assert (out[k, q].total, out[k, q].last, out[k, q].prev) == (total, last, prev)
    assert out["b", 4].total == 9
    nxt = {(r.k, r.q): r.n for r in od.carry(df, ["k"], "q", F.col("v"), "n", direction="next", width=8).collect()}
    assert nxt["a", 1] == "v5" and nxt["a", 95] == "v95" and nxt["a", 96] is None


def test_finite_scan_equals_walk(spark):
    rnd = random.Random(1)
    table = [[0, 1, 0], [1, 2, 0], [2, 0, 1]]
    rows = [("a", q, rnd.randrange(3)) for q in range(120)]
    df = spark.createDataFrame(rows, "k string, q long, y int")
    got = {r.q: (r.state_before, r.state_after) for r in od.finite_scan(df, ["k"], "q", "y", table, 0, width=10).collect()}
    state = 0
    for _, q, y in rows:
        before, state = state, table[state][y]
        assert got[q] == (before, state)


@pytest.mark.parametrize("width", [1, 7, 65_536])
def test_sparse_ids_of_one_key(spark, monkeypatch, width):
    """Ids in steps of 10^9, below and above zero, all rows under one null key, runs of three blocks."""
    monkeypatch.setattr(od, "FAN", 3)
    rnd = random.Random(width)
    rows, at = [], 0
    for i in range(40):
        at += rnd.choice([0, 3, 25])
        rows.append((None, (i - 20) * 10**9, at, rnd.randrange(3), rnd.choice([None, "v", "w"]), rnd.random() < 0.03))
    df = spark.createDataFrame(rows, "k string, q long, at long, y int, v string, f boolean")
    one = od.running_sum(df, ["k"], "q", "y", "total", width=width)
    got = {r.q: r for r in od.carry(one, ["k"], "q", F.col("v"), "last", width=width).collect()}
    nxt = {r.q: r.n for r in od.carry(df, ["k"], "q", F.col("v"), "n", direction="next", width=width).collect()}
    total, last = 0, None
    for i, (_, q, _, y, v, _) in enumerate(rows):
        total, last = total + y, v or last
        assert (got[q].total, got[q].last) == (total, last)
        assert nxt[q] == next((r[4] for r in rows[i:] if r[4]), None)
    spaced = od.keep_spaced(df, ["k"], "q", F.col("at"), F.col("at"), 60, force=F.col("f"), width=width).filter("opens")
    assert sorted(r.q for r in spaced.collect()) == walk([(r[1], r[2], r[2], r[5]) for r in rows], 60)
    table = [[0, 1, 0], [1, 2, 0], [2, 0, 1]]
    scan = {r.q: (r.state_before, r.state_after) for r in od.finite_scan(df, ["k"], "q", "y", table, 2, width=width).collect()}
    state = 2
    for _, q, _, y, _, _ in rows:
        before, state = state, table[state][y]
        assert scan[q] == (before, state)


@pytest.mark.parametrize("width", [1, 7, 65_536])
def test_one_day_of_one_key(spark, monkeypatch, width):
    """Many events of one second, ties settled by id: as the plain walk."""
    from fieldmanual.streaming import streams

    monkeypatch.setattr(od, "FAN", 3)
    rnd = random.Random(5)
    rows = sorted(((rnd.randrange(-500, 500), 1_700_000_000_000_000 + rnd.randrange(40) * 250_000, rnd.random() < 0.9) for _ in range(40)),
                  key=lambda r: (r[1], r[0]))
    rows = list({r[0]: r for r in rows}.values())
    rows.sort(key=lambda r: (r[1], r[0]))
    events = spark.createDataFrame([(i, "u", us, ok) for i, us, ok in rows], "id long, uid string, us long, ok boolean").selectExpr(
        "id", "uid", "timestamp_micros(us) as ts", "ok")
    got = streams.throttle_events(events, ["uid"], 2, width=width)
    assert sorted(r.id for r in got.collect()) == sorted(walk([(i, us, us, not ok) for i, us, ok in rows], 2_000_000))


def test_jumps_by_doubling():
    import numpy as np

    rnd = np.random.default_rng(3)
    for n in (1, 2, 50):
        nxt = np.minimum(np.arange(n) + rnd.integers(1, 4, n), n)
        for at in range(n):
            seen, i = [], at
            while i < n:
                seen.append(i)
                i = int(nxt[i])
            assert od._openers_from(nxt, at).tolist() == seen and od._last_openers(nxt)[at] == seen[-1]
