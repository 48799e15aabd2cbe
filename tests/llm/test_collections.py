"""Phrases, importance resampling and line runs against brute force, on small and hostile tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fieldmanual.llm import collocations, importance, line_runs
from tests.llm.test_operators import docs_of, empty


@pytest.fixture(scope="module")
def mixed(spark):
    random.seed(11)
    words = ["Alpha", "beta", "É", "der", "x1", " q", "Aİ"]
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t", "de", "b"), (None, "Alpha beta. alpha BETA", "en", "a"), (None, None, None, None),
            (4, "\x0b\x0c\r\x00 ;;", "en", "a"), (5, "one line\n one LINE \r\nother\n", None, "c"), (5, "one line\n one LINE \r\nother\n", None, "c")]
    for i in range(60):
        body = "".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", ". ", "\n", "\x00"]) for _ in range(random.randrange(90)))
        rows.append((10 + i, body, random.choice(["en", "de", None, "und"]), "hot"))
    rows += [(90, "same text here. Same text\nshared line", "en", "hot")] * 25
    rows.append((200, "Alpha beta der " * 9_000 + "tail", "en", "a"))
    return docs_of(spark, rows), rows


def brute_phrases(rows, least, order, top, cover, scale=2_000_000):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", fold(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, order + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = []
    cand = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= least}
    for (lang, p), a in cand.items():
        longer = [n for (other, q), n in cand.items() if other == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * n >= cover * a for n in longer):
            continue
        score, _, l, r = min((scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    found = []
    for lang in total:
        for rank, (_, s, a, p, l, r) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(found)


@pytest.mark.parametrize("least, order, top, bits", [(3, 4, 2000, 1 << 16), (1, 3, 7, 64), (30, 2, 2000, 1 << 16), (2, 5, 50, 1 << 10)])
def test_collocations(mixed, least, order, top, bits, monkeypatch):
    docs, rows = mixed
    monkeypatch.setattr(collocations, "MANY", 2_000)
    out = collocations.mine_collocations(docs, least, order, top, 80, screen_bits=bits).collect()
    assert sorted(tuple(r) for r in out) == brute_phrases(rows, least, order, top, 80)


@pytest.mark.parametrize("held", [40, 5_000_000])
def test_windows_are_summed_over_a_task(spark, held, monkeypatch):
    """However small the runs that a task reads, it sends an equal window once, unless it holds too many."""
    monkeypatch.setattr(collocations, "MANY", 20)
    monkeypatch.setattr(collocations, "HELD", held)
    texts = spark.createDataFrame([("en", "a b c d, e f, g")] * 50 + [("fr", "a b")] * 3, "lang string, text string").coalesce(1)
    every = collocations.Screen(np.full(1 << 4, ~np.uint64(0)), 1 << 10)
    runs, windows = collocations.count_runs(texts, [every]).collect(), collocations.lead_windows(texts, [every] * 3).collect()
    assert sorted(r.n for r in runs) == [3, 50, 50, 50, 50]
    sums = {}
    for *words, n in windows:
        sums[tuple(words)] = sums.get(tuple(words), 0) + n
    assert sorted(sums.values()) == [3, 3, *[50] * 7]
    assert held == 40 or len(windows) == len(sums)


def test_kept_hashes_are_bounded(monkeypatch):
    """A task forgets hashes of words beyond ``KNOWN``, whatever the size of its runs, and finds the same ones again."""
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([f"a w{i} x{i}"])], ["lang", "text"]) for i in range(200)]
    whole = np.concatenate(list(collocations._positions(iter(batches))))
    kept = []

    class Hashes(collocations._Hashes):
        def __init__(self, lang):
            super().__init__(lang)
            kept.append(self)

    monkeypatch.setattr(collocations, "_Hashes", Hashes)
    monkeypatch.setattr(collocations, "KNOWN", 30)
    assert np.array_equal(whole, np.concatenate(list(collocations._positions(iter(batches)))))
    assert max(map(len, kept)) <= 40


def test_collocations_count_beyond_long(spark):
    phrases = spark.createDataFrame([([1, 2], 2, 9 * 10 ** 17), ([1], 1, 9 * 10 ** 17), ([2], 1, 9 * 10 ** 17 + 1)], "phrase array<long>, size int, f long")
    assert collocations.weakest_cuts(phrases, 2_000_000).first().score == 2_000_000 * 9 * 10 ** 17 // (18 * 10 ** 17 + 1)


def brute_resample(rows, target, percent, least_words, buckets, longest):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def features(text):
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    all_of = lambda texts: collections.Counter(b for t in texts for b in features(t)[1])
    s, t = all_of(r[1] for r in rows), all_of(target)
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    out = []
    for d, text, *_ in rows:
        n, bs = features(text)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append([d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least_words])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return sorted(map(str, [(*x[:4], None) for x in out if not any(x is y for y in drawn)] + [(*x[:4], i) for i, x in enumerate(drawn, 1)]))


@pytest.mark.parametrize("percent, longest, buckets", [(10, 1, 10_000), (50, 3, 97), (100, 2, 7)])
def test_resampling(spark, mixed, percent, longest, buckets):
    docs, rows = mixed
    target = ["alpha beta x1", None, "der der É", ""]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    out = importance.resample(docs, benchmark, percent, 5, buckets, longest)
    assert sorted(str(tuple(r)) for r in out.collect()) == brute_resample(rows, target, percent, 5, buckets, longest)


def test_batch_boundaries_hide_no_words():
    texts = [b"", b"one two", b"", b"three", b"\xc3\xa9A 7"]
    n, owner, _ = importance.batch_features(texts, 2, importance.Buckets(1000))
    assert n.tolist() == [0, 2, 0, 1, 2] and sorted(owner.tolist()) == [1, 1, 1, 3, 4, 4, 4]


def brute_lines(rows, min_docs, least):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blank))
    count = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if len(k) >= least)
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if count[key(x)] < min_docs]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


@pytest.mark.parametrize("min_docs, least, parts, fanout, sent", [(10, 1, 1, 3, 500_000), (2, 1, 5, 2, 500_000), (2, 4, 5, 2, 0), (1, 0, 2, 3, 0), (10, 1, 7, 3, 0)])
def test_line_dedup(mixed, min_docs, least, parts, fanout, sent):
    docs, rows = mixed
    got = line_runs.dedup_lines(docs, line_runs.split_batches(docs, parts, "text"), min_docs, least, fanout, most_sent=sent)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_lines(rows, min_docs, least)


def test_runs_are_merged_by_level(spark, mixed):
    docs, _ = mixed
    runs = line_runs.LineRuns(spark, min_docs=5, fanout=2, buckets=2)
    for i in range(5):
        runs.add(docs)
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    # The fifth batch holds no key that the merged runs know as frequent.
    known = spark.table(runs.levels[2][0]).where("often")
    assert spark.table(runs.levels[0][0]).join(known.select("a", "b"), ["a", "b"]).count() == 0 < known.count()
    runs.close()


def test_batches_are_whole_files(spark, tmp_path, mixed):
    docs, rows = mixed
    docs.repartition(5).write.parquet(str(tmp_path / "docs"))
    parts = line_runs.split_batches(spark.read.parquet(str(tmp_path / "docs")), 3)
    assert len(parts) == 3 and sum(p.count() for p in parts) == len(rows)


def test_empty_tables(spark):
    none = empty(spark)
    assert collocations.mine_collocations(none).count() == 0
    assert importance.resample(none, none).count() == 0
    assert line_runs.dedup_lines(none).count() == 0
    assert line_runs.LineRuns(spark).frequent().count() == 0


def test_screen_finds_every_key(spark):
    keys = np.random.default_rng(5).integers(-2 ** 63, 2 ** 63 - 1, 3000)
    screen = collocations.build_screen(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 1 << 18)
    assert screen(keys).all() and screen(np.arange(5000)).mean() < 0.05
