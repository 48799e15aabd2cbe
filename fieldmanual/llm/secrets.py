"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found by pattern.  Weak candidates (identifiers, loose secrets, endpoints) say little alone: they
are reported only if complementary parts of a credential stand in the same scope, a window of characters around
them.  Parts of one document meet in an interval join over cells of that width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmanual.llm.common import stored

# Fixed patterns of the base kinds, in their order; the third value is the least length of the tested part.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more: shorter runs fail, and no later start in them can be longer
HEX = r"[0-9a-f]{16,}"         # likewise: matches are whole runs
BASE_KINDS = ("assign", "access", "hex")

# Weak parts: kind, role in a credential, pattern.  Roles complement each other.  A name may stand behind an underscore
# or a lower-case prefix (db_user, awsSecretAccessKey); values that make a base span of their own are left to it.
NAME = r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))"
SHORT = r"""(?:client[_-]?)?(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?![A-Za-z0-9+/_.=-]{12})"""
OTHER = r"""(?:pwd|pass(?:phrase|code)?|pin|cred(?:ential)?s?|(?:secret|private|shared|signing|encryption|master)[_-]?(?:access[_-]?)?key|auth)["']?\x20*[:=]\x20*["']?"""
WEAK = (
    ("account", "identifier", rf"""{NAME}(?<!(?i:secret|private|shared|signing|encryption|master)[_-]?)(?i:(?:client|account|access|user|login|tenant)[_-]?(?:key[_-]?)?(?:id|name)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{{4,}}"""),
    ("loose", "secret", rf"""{NAME}(?i:{SHORT}|{OTHER})[^\s"',;]{{6,}}"""),
    ("endpoint", "endpoint", r"""(?:https?|ftps?|ssh|jdbc:[a-z0-9]+|amqps?|mongodb|redis|postgres(?:ql)?|mysql)://[^\s"'<>]{4,}"""),
)
WINDOW = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(steps: Column) -> Column:
    """struct<at,spans> of (gap, size) steps: their total length and every span, counted from the first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(steps, start, lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + s["size"]).alias("at"),
        F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end")))).alias("spans")))


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (start, end) of a pattern's matches, in code points, end exclusive; matches must not be empty.

    Matches are placed in runs of about the root of their number, then the runs: a fold copies its array at every step, so
    one fold over n matches would copy n * n spans.  A text without a match is read once, others twice.
    """
    def shifted(runs: Column) -> Column:
        bases = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, r: F.struct(
            (acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        moved = F.zip_with(runs, bases, lambda r, base: F.transform(r["spans"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"))))
        return F.flatten(moved)

    def of_steps(steps: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(steps))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(steps), width)
        return _let(F.transform(firsts, lambda i: _placed(F.slice(steps, i, width))), shifted)

    def of_found(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
        return F.when(F.size(found) > 0, _let(steps, of_steps)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_found)


def _found(text: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """Array of (start, rank, end, kind)."""
    spans = spans_of(text, pattern)
    if keep is not None:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        spans = F.filter(F.zip_with(spans, part, lambda s, p: F.when(F.length(p) >= keep, s)), lambda s: s.isNotNull())
    made = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return made if keep is None else F.when(text.rlike(pattern), made).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _lines(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked_parts(parts: DataFrame, strong: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """Weak parts that have all the roles they need within ``window`` characters of their start.

    ``parts`` and ``strong``: ``keys``, ``role``, ``start``, ``end`` (and ``rank``, ``kind`` of weak parts).  An
    identifier needs a secret, a secret needs an identifier or an endpoint, an endpoint needs both others.  Each
    (document, role) keeps only the least and the greatest start per cell, so no pairs of spans are made.
    """
    every = parts.select(*keys, "role", "start").unionByName(strong.select(*keys, "role", "start"))
    cells = every.withColumn("cell", F.floor(F.col("start") / window)).groupBy(*keys, "role", "cell").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    reach = cells.select(*keys, "role", "low", "high", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    asked = parts.withColumn("cell", F.floor(F.col("start") / window))
    met = asked.join(reach.withColumnRenamed("role", "other"), [*keys, "cell"])
    near = (F.abs(F.col("low") - F.col("start")) <= window) | (F.abs(F.col("high") - F.col("start")) <= window) | (
        (F.col("low") <= F.col("start")) & (F.col("high") >= F.col("start")))
    has = lambda role: F.max(near & (F.col("other") == role))
    seen = met.groupBy(*keys, "start", "rank", "end", "kind", "role").agg(has("identifier").alias("i"), has("secret").alias("s"), has("endpoint").alias("e"))
    needs = (F.when(F.col("role") == "identifier", F.col("s")).when(F.col("role") == "secret", F.col("i") | F.col("e")).otherwise(F.col("i") & F.col("s")))
    return seen.where(needs).select(*keys, "start", "rank", "end", "kind")


def scan_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text_hash``, ``text_size``, ``base`` and ``spans`` (arrays of start, rank, end, kind, sorted) per row.

    A null text is empty and has no spans; repeated rows and null keys stay rows of their own (equal key and text have
    equal spans); an empty table gives no rows.  Texts of any length are scanned whole, once; what is found is stored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = documents.select(F.col(key).alias("doc_id"), body.alias("text"))
    body = F.col("text")
    found = stored(slim.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("text_size"), _found(body, ASSIGN, "assign", 0, 12).alias("a"), _found(body, ACCESS, "access", 1).alias("b"),
        _found(body, HEX, "hex", 2).alias("c"), *[_found(body, p, k, 3 + i).alias(f"w{i}") for i, (k, _, p) in enumerate(WEAK)]))
    based = found.select("doc_id", "text_hash", "text_size", F.array_sort(F.concat("a", "b", "c")).alias("base"), F.concat(*[f"w{i}" for i in range(len(WEAK))]).alias("weak"))
    keys, some = ["text_hash", "text_size"], based.where(F.size("weak") > 0)  # copies of a text have the same parts
    roles = F.create_map(*[F.lit(x) for k, r, _ in WEAK for x in (k, r)])
    parts = some.select(*keys, F.inline("weak")).distinct().withColumn("role", roles[F.col("kind")])
    strong = some.select(*keys, F.inline("base")).withColumn("role", F.when(F.col("kind") == "access", "identifier").otherwise("secret"))
    linked = linked_parts(parts, strong, keys, window).groupBy(*keys).agg(F.collect_set(F.struct("start", "rank", "end", "kind")).alias("linked"))
    out = based.join(linked, keys, "left")
    return out.select("doc_id", "text_hash", "text_size", "base", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPANS)))).alias("spans"))


def secret_digest(scanned: DataFrame) -> DataFrame:
    """Counts of base kinds, the digest of base spans, and the line of all spans, per row of :func:`scan_secrets`."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, BASE_KINDS), F.sha2(_lines(F.col("base")), 256).alias("base_sha256"), _lines(F.col("spans")).alias("spans"))


def redact_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", window: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, with every reported span replaced by ``mark``; overlapping spans become one."""
    spans = scan_secrets(documents, key, text, window).where(F.size("spans") > 0).groupBy("text_hash", "text_size").agg(F.first("spans").alias("__spans"))
    spans = spans.select(F.col("text_hash").alias("__h"), F.col("text_size").alias("__n"), "__spans")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    met = documents.join(spans, (F.xxhash64(whole) == F.col("__h")) & (F.length(whole) == F.col("__n")), "left")
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate("__spans", start, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(body.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))).alias("out")))
    done = met.withColumn("__fold", F.when(F.col("__spans").isNotNull(), folded))
    clean = F.concat(F.array_join("__fold.out", ""), body.substr(F.col("__fold.at") + 1, F.length(body)))
    return done.withColumn(text, F.when(F.col("__fold").isNotNull(), clean).otherwise(body)).select(*documents.columns)
