"""Exact Jaccard self-join of documents over word shingles, in metric space.

Jaccard distance is a metric, but over long shingles almost every document is at distance 1 from any document
pivot, and the triangle inequality would copy everything everywhere.  The pivots of the first level are therefore
single shingles, taken in one global order: a set lies nearest to the pivots it holds, and a set within the radius
of it must hold one of the first ``n - ceil(t n) + 1`` of them as well.  That window is what a document is copied
into.  Regions are joined at once where they are small.  A large region is joined around document pivots: members
at most the radius away join the pivot's class, a region whose members are all in one class is done, and what is
left is joined again around further pivots, with more of them each time, until nothing is left.  A pair meets only in
the first large region that both stand in, and only if what lies behind that pivot in both sets can reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmanual.llm.common import batches_of, part_of, sent_whole, stored

SMALL_REGION = 32
SLICES = 64
BATCH = 1024  # texts and sketches sent to a Python function at once
LEAD = 16  # large regions of a set, first ones first, by which a pair of sets is told to have met already
ORDERS = [np.uint64(m) for m in (1, 0xD1342543DE82EF95, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]  # random orders of the shingles
SKETCH, FINE = 256, 2048  # cells of a sketch; the finer one for sets of more than FINE / 3 shingles


class Shingler:
    """Sorted distinct 64-bit hashes of word shingles (ASCII letters lowered, ASCII white space between words).

    A word's hash is a polynomial over its bytes with random coefficients, taken from running sums over many texts
    at once; a long text is read in segments, so memory does not grow with it beyond its own words.
    """

    SEGMENT = 1 << 20

    def __init__(self, width: int):
        import xxhash

        random = np.random.default_rng(5)
        self.letter = random.integers(0, 1 << 64, 256, np.uint64)
        self.letter[65:91] = self.letter[97:123]
        self.white = np.zeros(256, bool)
        self.white[[32, *range(9, 14)]] = True
        self.width, self.odd = width, random.integers(0, 1 << 64, width, np.uint64) | np.uint64(1)
        self.base = int(random.integers(0, 1 << 62)) * 4 + 3
        self.digest, self.power, self.inverse = xxhash.xxh3_64_intdigest, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def _words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of every word."""
        letters = np.frombuffer(raw, np.uint8)
        n = len(letters)
        if len(self.power) <= n:
            for name, b in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                setattr(self, name, np.cumprod(np.append(np.uint64(1), np.full(max(n, self.SEGMENT), b, np.uint64)), dtype=np.uint64))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], self.white[letters], [True]])))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letter[letters] * self.inverse[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.power[starts]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93), starts

    def _mixed(self, words: np.ndarray, width: int) -> np.ndarray:
        mixed = words[:len(words) - width + 1] * self.odd[0]
        for k in range(1, width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) + words[k:len(words) - width + 1 + k] * self.odd[k]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> np.uint64(32))

    def _set(self, mixed: np.ndarray) -> np.ndarray:
        mixed = np.sort(mixed)
        return mixed[np.append(True, mixed[1:] != mixed[:-1])]

    def _long(self, raw: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(raw):
            end = at + self.SEGMENT
            while end < len(raw) and not self.white[raw[end]]:
                end += 1
            parts.append(self._words(raw[at:end])[0])
            at = end
        words = np.concatenate(parts)
        return self._set(self._mixed(words, min(self.width, len(words)))) if len(words) else words

    def sets(self, texts) -> list[np.ndarray]:
        """One array per text; empty for null, empty and blank texts."""
        out: list = [None] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            if len(raw) > self.SEGMENT:
                out[i] = self._long(raw)
                continue
            held.append((i, raw))
            size += len(raw) + 1
            if size > self.SEGMENT // 2:
                self._flush(held, out)
                held, size = [], 0
        self._flush(held, out)
        return out

    def _flush(self, held, out) -> None:
        if not held:
            return
        words, starts = self._words(b"\n".join(raw for _, raw in held))
        sizes = np.cumsum([0, *[len(raw) + 1 for _, raw in held]])
        bounds = np.searchsorted(starts, sizes).tolist()
        mixed = self._mixed(words, self.width) if len(words) >= self.width else words[:0]
        for (i, _), low, high in zip(held, bounds, bounds[1:]):
            n = high - low
            out[i] = words[:0] if not n else self._set(mixed[low:high - self.width + 1]) if n >= self.width else self._mixed(words[low:high], n)

    def node(self, shingles: np.ndarray) -> int:
        """Signed 64-bit name of a set."""
        return int(np.uint64(self.digest(shingles.tobytes())).astype(np.int64))


def _window(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _alike(a, b, percent: int):
    """Sizes that a pair above the threshold can have."""
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * percent


def _sketch(shingles: np.ndarray) -> bytes:
    """Shingles per cell of the hash space.  The sum of differences of two sketches never exceeds the sets' difference."""
    bits, cells = (53, FINE) if len(shingles) * 3 > FINE else (56, SKETCH)
    return np.minimum(np.bincount((shingles >> np.uint64(bits)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sum of differences of each two sketches; a fine one is folded where the other is not."""
    out = np.zeros(len(a), np.int64)
    fine = np.array([[len(s) == FINE for s in a], [len(s) == FINE for s in b]], bool).reshape(2, -1)
    for fa, fb in ((False, False), (False, True), (True, False), (True, True)):
        rows = np.flatnonzero((fine[0] == fa) & (fine[1] == fb))
        for low in range(0, len(rows), 2048):
            some = rows[low:low + 2048]
            x, y = (np.frombuffer(b"".join(s[i] for i in some), np.uint8).reshape(len(some), -1).astype(np.int16) for s in (a, b))
            if fa != fb:
                x, y = (np.minimum(s.reshape(len(some), SKETCH, -1).sum(axis=2), 255) for s in (x, y))
            out[some] = np.abs(x.astype(np.int32) - y).sum(axis=1)
    return out


def frequent_shingles(texts: DataFrame, width: int, sample_rows: int) -> np.ndarray:
    """Shingles of a sample of about ``sample_rows`` rows that seem to stand in more sets than a small region holds.

    They come last in the global order, so that windows hold rare shingles.  Any order gives the same result; the
    sample bounds the size of this list.
    """
    rows = texts.count()
    least = max(3, -(-2 * SMALL_REGION * min(rows, sample_rows) // max(1, rows)))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            sets = list({s.tobytes(): s for s in shingle.sets(batch["text"].tolist())}.values())
            yield pd.DataFrame({"h": np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)})

    hashes = part_of(texts, "doc_id", sample_rows).select("text").mapInPandas(explode, "h long")
    found = hashes.groupBy("h").count().where(F.col("count") >= least).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def shingle_windows(texts: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (name of the set), ``n_shingles``, ``pivots`` (the window), ``common`` (how many of them are frequent), ``sketch``, ``keys``.

    ``keys`` are minima of the random orders ``ORDERS``; sets with an equal one are likely alike.  The last four are null for a set that the task has seen before.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, seen = Shingler(width), set()
        for batch in batches:
            nodes, sizes, windows, common, sketches, keys = [], [], [], [], [], []
            for s in shingle.sets(batch["text"].tolist()):
                n = len(s)
                node = shingle.node(s) if n else 0
                window = many = sketch = key = None
                if n and node not in seen:
                    seen.add(node)
                    sketch, size, many = _sketch(s), _window(n, percent), 0
                    key = np.array([(s * odd).min() for odd in ORDERS], np.uint64).view(np.int64)
                    if len(frequent):
                        often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                        rare = s[~often]
                        many = max(0, size - len(rare))
                        s = np.concatenate([rare[:size], s[often][:many]]) if many else rare
                    window = s[:size].view(np.int64)
                nodes.append(node)
                sizes.append(n)
                windows.append(window)
                common.append(many)
                sketches.append(sketch)
                keys.append(key)
            rows = {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "node": np.array(nodes, np.int64), "n_shingles": np.array(sizes, np.int64)}
            more = {"pivots": pd.Series(windows, dtype=object, index=batch.index), "common": pd.Series(common, dtype="Int32", index=batch.index),
                    "sketch": pd.Series(sketches, dtype=object, index=batch.index), "keys": pd.Series(keys, dtype=object, index=batch.index)}
            yield pd.DataFrame(rows | more)

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInPandas(build, f"doc_id {kind}, text_hash long, node long, n_shingles long, pivots array<long>, common int, sketch binary, keys array<long>")


def likely_pairs(windows: DataFrame) -> DataFrame:
    """Pairs of neighbours among the sets that share a key, in the order of their other keys: at most one per set and key, for a first guess at classes.

    Sets that drift away from each other step by step are linked along the way, where a common partner would be too far from most.
    """
    keyed = windows.where(F.col("keys").isNotNull()).select("node", "keys").dropDuplicates(["node"]).select("node", "keys", F.posexplode("keys").alias("i", "key"))
    others = [F.get("keys", (F.col("i") + k) % len(ORDERS)) for k in range(1, len(ORDERS))]
    behind = keyed.withColumn("last", F.lag("node").over(W.partitionBy("i", "key").orderBy(*others, "node"))).where("last is not null")
    return behind.select(F.least("node", "last").alias("a"), F.greatest("node", "last").alias("b")).distinct()


ROW = np.dtype([("h", "<i8"), ("node", "<i8"), ("class", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _block(rows: np.ndarray) -> bytes:
    """Rows byte by byte, all first bytes first, with the class as its difference from the node: mostly runs of zeros, which the shuffle's codec removes."""
    rows = rows.copy()
    rows["class"] ^= rows["node"]
    return rows.view(np.uint8).reshape(-1, ROW.itemsize).T.tobytes()


def _rows(block: bytes) -> np.ndarray:
    rows = np.frombuffer(block, np.uint8).reshape(ROW.itemsize, -1).T.copy().view(ROW).ravel()
    rows["class"] ^= rows["node"]
    return rows


def region_pairs(windows: DataFrame, labels: DataFrame, percent: int, bucket_rows: int = 2048) -> DataFrame:
    """Candidate pairs of small regions (``h`` null), and the members of large ones (``b`` null), in one table.

    ``labels`` are the classes known so far: pairs inside a class and regions of one class are settled and left out.
    Pivots are told apart by the upper 48 bits of their hashes; two that agree there make one region, which only adds
    candidates.  ``at`` is the place of the pivot in a member's window.  Rows of rare pivots travel in packed blocks, one per bucket of the hash space; there is a bucket for every
    ``bucket_rows`` documents.  Regions of frequent pivots are large by presumption and never packed.
    """
    copied = windows.where(F.col("pivots").isNotNull()).select("node", F.col("n_shingles").cast("int").alias("n"), "pivots", "common").join(
        sent_whole(labels.withColumnRenamed("node", "__n")), F.col("node") == F.col("__n"), "left").select("node", "n", "pivots", "common", F.coalesce("component", "node").alias("class"))
    buckets = max(1, windows.count() // bucket_rows)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 4096):
                rows = batch.iloc[low:low + 4096]
                lengths = rows["pivots"].map(len).to_numpy()
                packed = np.empty(int(lengths.sum()), ROW)
                packed["h"] = np.concatenate(rows["pivots"].tolist())
                for name in ("node", "class", "n"):
                    packed[name] = np.repeat(rows[name].to_numpy(), lengths)
                behind = packed["at"] = np.arange(len(packed)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                often = behind >= np.repeat(lengths - rows["common"].to_numpy(), lengths)
                bucket = ((packed["h"].view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
                bucket[often] = -1
                packed["h"] = (packed["h"].view(np.uint64) >> np.uint64(16)).view(np.int64)
                order = np.argsort(bucket, kind="stable")
                packed, bucket = packed[order], bucket[order]
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                names = bucket[cuts]
                block = [_block(packed[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(packed)))]
                # blocks of frequent pivots are not gathered anywhere: each goes to a bucket of its own
                yield pd.DataFrame({"bucket": np.where(names < 0, -1 - np.arange(len(names)) - low, names), "block": block})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(a, an, b=None, bn=None, h=None, at=None):
            nothing = pd.array([None] * len(a), dtype="Int64")
            return pd.DataFrame({"a": a, "an": an} | {k: nothing if v is None else v for k, v in (("b", b), ("bn", bn), ("h", h), ("at", at))})

        def close(blocks):
            rows = np.concatenate([_rows(b) for b in blocks])
            rows = rows[np.argsort(rows["h"], kind="stable")]
            same = rows["h"][1:] == rows["h"][:-1]
            rows = rows[np.append(False, same) | np.append(same, False)]
            rows = rows[np.lexsort((rows["at"], rows["node"], rows["h"]))]
            h, node, n, known, place = (np.ascontiguousarray(rows[c]) for c in ("h", "node", "n", "class", "at"))
            fresh = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))[:len(h)]
            h, node, n, known, place = h[fresh], node[fresh], n[fresh].astype(np.int64), known[fresh], place[fresh]
            if not len(h):
                return
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[:len(h)])
            sizes = np.diff(np.append(starts, len(h)))
            mixed = np.repeat(np.minimum.reduceat(known, starts) < np.maximum.reduceat(known, starts), sizes)
            of_row = np.repeat(sizes, sizes)
            big = (of_row > SMALL_REGION) & mixed
            if big.any():
                yield frame(node[big], n[big], h=h[big], at=place[big])
            few = (of_row <= SMALL_REGION) & mixed
            h, node, n, known = h[few], node[few], n[few], known[few]
            for step in range(1, min(SMALL_REGION, len(h))):
                i = np.flatnonzero(h[step:] == h[:-step])
                if not len(i):
                    break
                i = i[(known[i] != known[i + step]) & _alike(n[i], n[i + step], percent)]
                if len(i):
                    yield frame(node[i], n[i], node[i + step], n[i + step])

        at, blocks = None, []
        for batch in batches:
            for bucket, block in zip(batch["bucket"].tolist(), batch["block"]):
                if bucket < 0:
                    rows = _rows(block)
                    yield frame(rows["node"], rows["n"], h=rows["h"], at=rows["at"])
                    continue
                if bucket != at and blocks:
                    yield from close(blocks)
                    blocks = []
                at = bucket
                blocks.append(block)
        if blocks:
            yield from close(blocks)

    packed = copied.mapInPandas(pack, "bucket long, block binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(join, "a long, an long, b long, bn long, h long, at long")


def promising_pairs(regions: DataFrame, percent: int) -> DataFrame:
    """Pairs of small regions that share enough pivots to reach the threshold.

    All common shingles up to the end of the window that ends first are common pivots, so a pair can have at most the
    pivots it shares and the shingles behind the longer rest.  Pivots of large regions count as shared if both have them.
    """
    pairs = regions.where("b is not null")
    shared = pairs.groupBy("a", "an", "b", "bn").agg(F.count(F.lit(1)).alias("shared"))
    large = regions.where("b is null").groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    for side in "ab":
        shared = shared.join(large.select(F.col("node").alias(side), F.col("more").alias(f"more_{side}")), side, "left")
    rest = F.greatest(*[F.ceil(F.col(c) * percent / 100) - 1 for c in ("an", "bn")])
    needed = F.ceil((F.col("an") + F.col("bn")) * percent / (100 + percent))
    most = F.col("shared") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) + rest
    return shared.where(most >= needed).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    """``node``: both ends of all pairs, with repetitions."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def close_sketches(pairs: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs whose sketches leave room for the threshold; only sketches of the pairs' nodes move."""
    met = stored(pairs.select("a", "b").distinct())
    sketches = sent_whole(stored(ends(met).distinct())).join(places.select("node", "n", "sketch"), "node")
    for side in "ab":
        met = met.join(sketches.select(F.col("node").alias(side), F.col("n").alias(f"{side}n"), F.col("sketch").alias(f"{side}s")), side)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            apart = _apart(batch["as"].tolist(), batch["bs"].tolist())
            fits = apart * (100 + percent) <= (100 - percent) * (batch["an"].to_numpy() + batch["bn"].to_numpy())
            yield batch.loc[fits, ["a", "b"]]

    return met.mapInPandas(keep, "a long, b long")


def wanted_texts(nodes: DataFrame, places: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node``, ``text``: one text for each of the sets named in ``nodes``; and the rows of ``places`` for them.

    ``places`` says which row of ``texts`` (key, text hash) holds a set.  The texts move once, for all later rounds.
    """
    placed = stored(sent_whole(stored(nodes.distinct())).join(places, "node"))
    found = sent_whole(placed.drop("n", "sketch")).join(texts.withColumnRenamed("doc_id", "__d"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("at_hash") == F.col("text_hash")))
    return stored(found.select("node", "text").dropDuplicates(["node"])), placed


def linked_pairs(asked: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """The distinct pairs ``a, b`` whose sets, built again from the texts in ``held``, reach the threshold.

    The pairs of one ``a`` are dealt over slices; a slice reads the set of ``a`` first and meets the others one by one.
    Of ``held`` only texts of asked sets are shuffled.
    """
    asked = asked.withColumn("slice", F.pmod(F.hash("b"), F.lit(SLICES)))
    wanted = asked.select("a", "slice", F.lit(0).alias("part"), F.col("a").alias("node")).distinct().unionByName(
        asked.select("a", "slice", F.lit(1).alias("part"), F.col("b").alias("node")))
    ordered = sent_whole(stored(wanted)).join(held.select("node", "text"), "node").select("a", "slice", "part", "node", "text").repartition("a", "slice").sortWithinPartitions("a", "slice", "part", "node")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, name, held = Shingler(width), None, None
        for batch in batches:
            out = []
            for low in range(0, len(batch), 256):
                rows = batch.iloc[low:low + 256]
                for a, part, node, own in zip(rows["a"], rows["part"], rows["node"], shingle.sets(rows["text"].tolist())):
                    if part == 0:
                        name, held = a, own
                    elif name == a:
                        both = len(np.intersect1d(held, own, assume_unique=True))
                        if 100 * both >= percent * (len(held) + len(own) - both):
                            out.append((a, node))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return ordered.mapInPandas(verify, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (least node reachable) of all nodes that ``links(a, b)`` touch.

    Each step takes the least label among the neighbours and then the label of that label, so long chains close fast.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"))
    labels = stored(labels)
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        moved = stored(lower.join(jump, F.col("new") == F.col("via")).select("node", "old", F.least("new", "further").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels


def large_members(regions: DataFrame) -> DataFrame:
    """``h``, ``node``, ``n``, ``at`` of the members of large regions, and ``before``: which large regions, of the first ``LEAD`` of the set, lie before this one."""
    members = regions.where("b is null").groupBy("h", F.col("a").alias("node"), F.col("an").alias("n")).agg(F.min("at").alias("at"))
    of_set = W.partitionBy("node").orderBy("at", "h")
    members = members.withColumn("place", F.row_number().over(of_set)).withColumn(
        "lead", F.collect_list(F.when(F.col("place") <= LEAD, F.col("h"))).over(of_set.rowsBetween(W.unboundedPreceding, -1)))
    return members.select("h", "node", "n", "at", F.col("lead").alias("before"))


def close_large_regions(members: DataFrame, links: DataFrame, held: DataFrame, places: DataFrame, width: int, percent: int) -> DataFrame:
    """All links needed to tell the classes of the members of large regions apart, added to ``links``.

    Every round checks a region's next pivots against all members of other classes and retires them.  The first pivots
    are the members with the fewest rare shingles, which most others are near to, then those of the smallest classes.  A
    region ends with one class or without members.  A pair is checked in the first large region of both, where common
    shingles lie at or behind the pivot in either set; a pair that shares earlier pivots of small regions was checked there.
    """
    pivots = 1
    while not members.isEmpty():
        labels = components(links).select(F.col("node").alias("__n"), "component")
        labelled = members.join(labels, F.col("node") == F.col("__n"), "left").select("h", "node", "n", "at", "before", F.coalesce("component", "node").alias("class"))
        mixed = labelled.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("h")
        alive = labelled.join(mixed, "h")
        size = alive.groupBy("h", "class").agg(F.count(F.lit(1)).alias("size"))
        alive = stored(alive.join(size, ["h", "class"]))
        if alive.isEmpty():
            break
        order = ("at", "node") if pivots == 1 else ("size", "node")
        ranked = alive.withColumn("rank", F.row_number().over(W.partitionBy("h").orderBy(*order))).where(F.col("rank") <= pivots)
        chosen = ranked.select("h", F.col("node").alias("a"), F.col("n").alias("an"), F.col("at").alias("a_at"), F.col("before").alias("a_before"), F.col("class").alias("of"))
        fits = (F.least("n", "an") * 100 >= F.greatest("n", "an") * percent) & (F.col("of") != F.col("class"))
        fits &= F.least(F.col("n") - F.col("at"), F.col("an") - F.col("a_at")) * (100 + percent) >= (F.col("n") + F.col("an")) * percent
        fits &= ~F.arrays_overlap("before", "a_before")
        asked = chosen.join(alive, "h").where(fits).select("a", F.col("node").alias("b"))
        links = stored(links.unionByName(linked_pairs(stored(close_sketches(asked, places, percent)), held, width, percent)))
        members = stored(alive.join(chosen.select("h", F.col("a").alias("node")), ["h", "node"], "left_anti").select("h", "node", "n", "at", "before"))
        pivots *= 8
    return links


def jaccard_join(documents: DataFrame, percent: int = 75, width: int = 5, key: str = "doc_id", text: str = "text", sample_rows: int = 16_384) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row.

    A document's set holds its distinct shingles of ``width`` words (ASCII letters lowered); with fewer words the whole
    sequence is its one shingle; a null, empty or blank text has an empty set and is linked with nothing.  Documents link
    when their Jaccard similarity is at least ``percent`` / 100, exactly; ``component_id`` is the least key reachable (null
    keys count only where a component has no other).  Repeated rows are linked copies.  An empty table gives no rows.
    Sets are named by 64-bit hashes.
    """
    texts = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    spark = documents.sparkSession
    # One pass over the texts; what follows reads windows, and texts once more for sets that bounds leave open.
    with batches_of(spark, BATCH):
        windows = stored(shingle_windows(texts, width, percent, frequent_shingles(texts, width, sample_rows)))
        places = stored(windows.where("sketch is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("p"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).select(
            "node", "p.doc_id", F.col("p.text_hash").alias("at_hash"), "n", "sketch"))
        likely = stored(close_sketches(likely_pairs(windows), places, percent))
        held, _ = wanted_texts(ends(likely), places, texts)
        links = stored(linked_pairs(likely, held, width, percent))
    regions = stored(region_pairs(windows, components(links), percent))
    members = stored(large_members(regions))
    with batches_of(spark, BATCH):
        asked = stored(close_sketches(promising_pairs(regions, percent), places, percent))
        held, placed = wanted_texts(ends(asked).unionByName(members.select("node")), places, texts)
        links = close_large_regions(members, stored(links.unionByName(linked_pairs(asked, held, width, percent))), held, placed, width, percent)
    labels = components(links).withColumnRenamed("node", "__n")
    classed = windows.select("doc_id", "node", "n_shingles").join(labels, (F.col("node") == F.col("__n")) & (F.col("n_shingles") > 0), "left")
    classed = classed.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("class"))
    least = classed.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("class", "__c")
    out = classed.join(least, (F.col("class") == F.col("__c")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
