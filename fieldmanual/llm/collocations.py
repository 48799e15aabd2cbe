"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: the words at a position and at its next places, taken as lead columns inside a piece
and padded where the piece ends.  ROLLUP over the lead columns sums the windows by ever shorter prefixes, which gives the
count of every shorter phrase without exploding it.

Screens end windows early without changing any count that is wanted: a phrase in ``least`` places has only words, and
only shorter runs of words, that stand in as many.  A screen is a bit map of fixed size, filled from runs of one length
under the screens before it; what it lets through by mistake is counted in full and falls under ``least`` afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmanual.llm.common import batches_of, stored

#: Every byte as the tokens need it: A-Z in lower case, a tab as a blank, marks and line ends as one break.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
BREAK, SKIP = 0, 1  # values that no word's hash takes
SCREEN_BITS = 1 << 26
MANY = 4_000_000  # bytes of text, and counted keys, that a task holds at once
KNOWN = 200_000  # words whose hashes a task keeps
BATCH = 2048  # texts sent to a Python function at once
HELD = 2_000_000  # numbers in the counted runs or windows that a task adds up before it sends them on


def _tokens(texts: list[bytes]) -> list[bytes]:
    """Words, a line feed between pieces, and empty strings from repeated blanks."""
    return b"\n".join(texts).translate(FOLD).replace(b"\n", b" \n ").split(b" ")


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit key of two hashes; it serves the screens only, never a count."""
    a, b = first.view(np.uint64), second.view(np.uint64)
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


class Screen:
    """A bit map with two places per key: keys put in are always found, others seldom."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.mask, self.shift = words, np.uint64(bits - 1), np.uint64(bits.bit_length() - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        found = np.ones(len(k), bool)
        for place in (k & self.mask, (k >> self.shift) & self.mask):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def build_screen(keys: DataFrame, key: str, bits: int = SCREEN_BITS) -> Screen:
    """Fill a screen from a column of 64-bit hashes; Spark joins the bits, the driver gets ``bits / 64`` longs at most."""
    shift = bits.bit_length() - 1
    place = F.explode(F.array(F.col(key).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(bits - 1)))).alias("place")
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    filled = keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    return Screen(words.view(np.uint64), bits)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Runs of about ``MANY`` bytes of texts of one language; a row's two columns are language and text."""
    for batch in batches:
        waiting: dict[bytes, tuple[list[bytes], list[int]]] = {}
        for lang, text in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            texts, size = waiting.setdefault(lang, ([], [0]))
            texts.append(text)
            size[0] += len(text)
            if size[0] >= MANY:
                yield lang, waiting.pop(lang)[0]
        for lang, (texts, _) in waiting.items():
            yield lang, texts


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of ``texts`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}

        def out():
            for lang, seen in held.items():
                seen.pop(b"", None), seen.pop(b"\n", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.binary()).cast(pa.string()), pa.array(list(seen), pa.binary()).cast(pa.string()),
                                                  pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for lang, run in _by_language(batches):
            held.setdefault(lang, Counter()).update(_tokens(run))
            if sum(map(len, held.values())) > MANY // 10:
                yield from out()
        yield from out()

    found = texts.mapInArrow(count, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Hashes(dict):
    """Spark's 64-bit hash of (language, word), as an unsigned number."""

    def __init__(self, lang: bytes):
        super().__init__({b"": SKIP, b"\n": BREAK})
        self.seed = xxhash.xxh64_intdigest(lang, seed=42)

    def __missing__(self, word: bytes) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word, seed=self.seed)
        return made


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashes of the words in order, with a break behind every piece."""
    known: dict[bytes, _Hashes] = {}
    for lang, run in _by_language(batches):
        if sum(map(len, known.values())) > KNOWN:
            known.clear()
        look = known.setdefault(lang, _Hashes(lang))
        tokens = _tokens(run)
        tokens.append(b"\n")
        h = np.fromiter(map(look.__getitem__, tokens), np.uint64, len(tokens)).view(np.int64)
        yield h[h != SKIP]


def _live_runs(h: np.ndarray, screens: list[Screen], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``longest`` words: where they start, and their keys, as far as the screens let them through.

    A run can be frequent only if both runs that are shorter by one word are, so each length starts from the last.
    """
    at = np.flatnonzero(h != BREAK)
    key = h[at]
    for k in range(1, longest + 1):
        if k > 1:
            on = np.zeros(len(h) + 1, bool)
            on[at] = True
            go = on[at + 1]
            at = at[go]
            key = _pair_hash(key[go], h[at + k - 1])
        if k <= len(screens):
            go = screens[k - 1](key)
            at, key = at[go], key[go]
        yield at, key


def _summed(columns: np.ndarray) -> np.ndarray:
    """Equal columns of ``columns`` as one, their last row (counts) added up."""
    columns = columns[:, np.lexsort(columns[-2::-1])]
    new = np.ones(columns.shape[1], bool)
    new[1:] = (columns[:-1, 1:] != columns[:-1, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return np.vstack([columns[:-1, first], np.add.reduceat(columns[-1], first)[None]]) if len(first) else columns


def _gathered(parts: Iterator[np.ndarray], most: int) -> Iterator[np.ndarray]:
    """The counts of ``parts``, added up over a task; what is held is sent on when it stays at half of ``most`` numbers or more."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.size
        if size >= most:
            held = [_summed(np.hstack(held))]
            size = held[0].size
            if size >= most // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield _summed(np.hstack(held)) if len(held) > 1 else held[0]


def count_runs(texts: DataFrame, screens: list[Screen]) -> DataFrame:
    """(run, n): occurrences of runs of words, one word longer than there are screens, by a hash of the run."""
    sent = texts.sparkSession.sparkContext.broadcast(screens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[np.ndarray]:
            for h in _positions(batches):
                *_, (_, key) = _live_runs(h, sent.value, len(sent.value) + 1)
                yield np.stack(np.unique(key, return_counts=True))

        for runs, n in _gathered(counted(), HELD):
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(n)], ["run", "n"])

    return texts.mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def lead_windows(texts: DataFrame, screens: list[Screen], order: int = 4) -> DataFrame:
    """(w1, ..., n): windows of ``order`` words in lead columns, padded with 0 behind the last word of a piece; counted per task."""
    sent, names = texts.sparkSession.sparkContext.broadcast(screens), [f"w{i}" for i in range(1, order + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[np.ndarray]:
            for h in _positions(batches):
                columns = np.zeros((order + 1, len(h)), np.int64)
                columns[order] = 1
                for lead, (at, _) in enumerate(_live_runs(h, sent.value, order)):
                    columns[lead, at] = h[at + lead]
                alone, n_alone = np.unique(columns[0, (columns[0] != BREAK) & (columns[1] == BREAK)], return_counts=True)
                single = np.zeros((order + 1, len(alone)), np.int64)
                single[0], single[order] = alone, n_alone
                yield np.hstack([_summed(columns[:, columns[1] != BREAK]), single])

        for rows in _gathered(counted(), HELD):
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows)], [*names, "n"])

    return texts.mapInArrow(count, ", ".join(f"{c} long" for c in [*names, "n"]))


def marginal_counts(windows: DataFrame, order: int, least: int) -> DataFrame:
    """(phrase, size, f): ROLLUP of windows to all their prefixes, as arrays of word hashes; ``least`` or more."""
    names = [f"w{i}" for i in range(1, order + 1)]
    rolled = windows.rollup(*names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g")).where(F.col("f") >= least)
    size = F.lit(order) - F.expr("bit_count(g)")
    phrase = F.slice(F.array(*[F.coalesce(c, F.lit(BREAK)) for c in names]), 1, F.col("size"))
    # A prefix that ends in padding is its shorter prefix over again.
    return rolled.withColumn("size", size.cast("int")).where("size > 0").withColumn("phrase", phrase).where(F.element_at("phrase", -1) != BREAK).select("phrase", "size", "f")


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(26,0)")


def weakest_cuts(phrases: DataFrame, scale: int) -> DataFrame:
    """(phrase, a, l, r, score) of every phrase of two words or more, by the cut with the least score, the earliest of equals."""
    cuts = phrases.where("size > 1").select("phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("head"), F.slice("phrase", F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    met = (cuts.join(phrases.select(F.col("phrase").alias("head"), F.col("f").alias("l")), "head")
           .join(phrases.select(F.col("phrase").alias("tail"), F.col("f").alias("r")), "tail"))
    score = F.expr(f"cast(a AS decimal(26,0)) * {scale} div (cast(l AS decimal(26,0)) + cast(r AS decimal(26,0)))").cast("long")
    best = met.groupBy("phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("phrase", "a", "cut.l", "cut.r", "cut.score")


def covered_by_longer(phrases: DataFrame) -> DataFrame:
    """(phrase, longer): the count of the most frequent longer phrase that holds each phrase's words contiguously."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.slice("phrase", at, n))))
    return phrases.where("size > 2").select(F.explode(inner).alias("phrase"), "f").groupBy("phrase").agg(F.max("f").alias("longer"))


def mine_collocations(documents: DataFrame, least: int = 30, order: int = 4, top: int = 2000, cover_percent: int = 80, scale: int = 2_000_000,
                      lang: str = "lang", text: str = "text", screen_bits: int = SCREEN_BITS) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to ``order`` words of one piece and ``least`` occurrences (two at the least); ``a``, ``l`` and ``r`` count the
    phrase and the two parts of its weakest cut, ``n`` all words of the language, and the score is ``scale * a / (l + r)``
    rounded down, in exact decimals.  Phrases that a longer one holds in ``cover_percent`` of their occurrences are dropped.
    Every row is a document of its own; null texts are empty and a null language is ``und``.  Ties go to the higher
    count, then to the phrase in byte order.  Words are named by 64-bit hashes until the end.  An empty table gives no rows.
    """
    least = max(1, least)
    texts = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("text <> ''")
    # Frequent words, and one row per language with the number of all others.
    with batches_of(documents.sparkSession, BATCH):
        vocabulary = stored(count_words(texts).groupBy("lang", F.when(F.col("n") >= least, F.col("word")).alias("word")).agg(F.sum("n").alias("n")))
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    known = vocabulary.where("word is not null").withColumn("h", F.xxhash64("lang", "word"))
    screens = [build_screen(known, "h", screen_bits)]
    with batches_of(documents.sparkSession, BATCH):
        while len(screens) < order - 1:
            screens.append(build_screen(count_runs(texts, screens).where(F.col("n") >= least), "run", screen_bits))
        phrases = stored(marginal_counts(lead_windows(texts, screens, order), order, least))
    held = weakest_cuts(phrases, scale).join(covered_by_longer(phrases), "phrase", "left")
    held = held.where(F.coalesce(_exact("longer") * 100 < _exact("a") * cover_percent, F.lit(True))).drop("longer")
    spelt = held.select("*", F.posexplode("phrase").alias("at", "h")).join(known.select("h", "lang", "word"), "h")
    spelt = spelt.groupBy("phrase", "lang", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelt = spelt.withColumn("phrase", F.array_join(F.transform("words", lambda w: w["word"]), " ")).drop("words").join(totals, "lang")
    ranks = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return spelt.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
