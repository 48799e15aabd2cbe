"""Scalar text operators: hashing, splitting, cleaning, chunking of one text value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmanual.functions.rules import col

CJK = "\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}"
KANA = "\\x{3040}-\\x{30ff}\\x{ff66}-\\x{ff9f}"


def short_id(c) -> Column:
    """First 12 hex digits of SHA-256: the id of a path or of a chunk of text."""
    return F.substring(F.sha2(col(c).cast("string"), 256), 1, 12)


def content_key(c) -> Column:
    """MD5 of the text without blanks and markdown marks; equal content gets an equal key."""
    return F.md5(F.regexp_replace(col(c), r"[\s*#_|>`\-]+", ""))


def _pieces(text: Column) -> Column:
    cut = F.split(text, r"(?m)(?=^#{1,3}\s)")

    def piece(p):
        headed = p.rlike(r"^#{1,3}\s")
        first = F.regexp_extract(p, r"^([^\n]*)", 1)
        rest = F.regexp_replace(p, r"^[^\n]*\n?", "")
        return F.struct(
            F.when(headed, F.trim(first)).otherwise(F.lit("")).alias("title"),
            F.trim(F.regexp_replace(F.when(headed, rest).otherwise(p), r"^\s+|\s+$", "")).alias("body"),
        )

    return F.filter(F.transform(cut, piece), lambda s: s["body"] != "")


def _repack(section: Column, limit: int) -> Column:
    """Pack blank-line paragraphs: flush when the next one would exceed the limit."""
    paras = F.filter(F.split(section["body"], r"\n\s*\n"), lambda p: F.trim(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def add(acc, p):
        flush = (acc["buf"] != "") & (F.length(acc["buf"]) + F.length(p) > limit)
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"),
            F.when(flush | (acc["buf"] == ""), p)
            .otherwise(F.concat(acc["buf"], F.lit("\n\n"), p)).alias("buf"),
        )

    packed = F.aggregate(paras, start, add, lambda a: F.concat(a["done"], F.array(a["buf"])))
    return F.transform(packed, lambda b: F.struct(section["title"].alias("title"), b.alias("body")))


def heading_sections(c, max_chunk: int = 1024) -> Column:
    """array<struct<title,body>> cut at heading lines; long bodies re-packed by paragraph."""
    limit = 3 * max_chunk
    return F.flatten(F.transform(
        _pieces(col(c)),
        lambda s: F.when(F.length(s["body"]) > limit, _repack(s, limit)).otherwise(F.array(s)),
    ))


def whole_or_sections(c, min_len: int = 500) -> Column:
    """As :func:`heading_sections` without re-packing; short texts stay whole."""
    c = col(c)
    whole = F.array(F.struct(F.lit("").alias("title"), c.alias("body")))
    cut = _pieces(c)
    return F.when((F.length(c) < min_len) | (F.size(cut) == 0), whole).otherwise(cut)


def sentences(c) -> Column:
    """Trimmed non-empty sentences of a text."""
    cut = F.split(col(c), r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda s: s != "")


def pack_sentences(c, size: int = 512) -> Column:
    """array<string> of chunks of at most ``size`` words made of whole sentences.

    A sentence longer than ``size`` words is a chunk of its own.  The counting rule is ours.
    """
    def words(s):
        return F.regexp_count(s, F.lit(r"\s+")) + 1

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"),
                     F.lit(0).alias("n"))

    def add(acc, s):
        w = words(s)
        flush = (acc["n"] > 0) & (acc["n"] + w > size)
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"),
            F.when(flush | (acc["n"] == 0), s).otherwise(F.concat(acc["buf"], F.lit(" "), s)).alias("buf"),
            F.when(flush, w).otherwise(acc["n"] + w).alias("n"),
        )

    return F.aggregate(sentences(c), start, add, lambda a: F.when(
        a["n"] > 0, F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"]))


def overlap_chunks(chunks, overlap: int) -> Column:
    """Each later chunk preceded by the last ``overlap`` words of the chunk before it.

    ``chunks`` must be a stored column: the lambda reads it once per chunk.
    """
    chunks = col(chunks)
    if overlap <= 0:
        return chunks

    def with_tail(x, i):
        before = F.split(F.element_at(chunks, F.greatest(i, F.lit(1))), r"\s+")
        tail = F.slice(before, F.greatest(F.size(before) - overlap + 1, F.lit(1)), F.lit(overlap))
        return F.when(i == 0, x).otherwise(F.concat(F.array_join(tail, " "), F.lit(" "), x))

    return F.transform(chunks, with_tail)


def keep_legible_lines(c) -> Column:
    """Keep lines that are mostly letters, digits or ideographs; NULL when too little remains."""
    good = f"[A-Za-z0-9{CJK}]"
    lines = F.transform(F.split(col(c), "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    kept = F.filter(lines, lambda s: (
        (F.regexp_count(s, F.lit(good)) >= 3)
        & (F.regexp_count(s, F.lit(good)) * 2 >= F.length(F.regexp_replace(s, r"\s", "")))))
    text = F.array_join(kept, "\n")
    return F.when(F.regexp_count(text, F.lit(good)) >= 30, text)


# Characters that part the codes of one cell.
CODE_SEPARATORS = ",;/|，；／｜、"


def clean_markdown(c) -> Column:
    """Remove line-break tags, escapes, emphasis marks and leading heading or quote marks."""
    shown = F.regexp_replace(F.regexp_replace(col(c), "(?i)<br[^>]*>", " "), r"\\(\p{Punct})", "$1")
    for mark in ("**", "__", "~~"):
        shown = F.replace(shown, F.lit(mark), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(shown, r"(?<!\w)_|_(?!\w)", ""), r"^\s*#*\s*>?", ""))


def clean_codes(c) -> Column:
    """Keep parts of a code cell that look like codes: four or more characters with a digit."""
    blank = F.translate(F.regexp_replace(col(c), "(?i)<br[^>]*>", " "), CODE_SEPARATORS, " " * len(CODE_SEPARATORS))
    return F.array_join(F.regexp_extract_all(blank, F.lit(r"(?<!\S)(?=\S*\d)\S{4,}"), F.lit(0)), " ")


def mask_aliases(c, aliases: Sequence[tuple[str, str]]) -> Column:
    """Replace aliases by code names, longest alias first, on word boundaries, ignoring case."""
    import re

    out = col(c)
    for alias, code in sorted(aliases, key=lambda a: (-len(a[0]), a[0])):
        body = re.escape(alias)
        left = r"(?<![A-Za-z])" if re.match(r"[A-Za-z]", alias) else r"(?<!\d)" if alias[0].isdigit() else ""
        right = r"(?![A-Za-z])" if re.search(r"[A-Za-z]$", alias) else r"(?!\d)" if alias[-1].isdigit() else ""
        out = F.regexp_replace(out, f"(?i){left}{body}{right}", code.replace("\\", r"\\").replace("$", r"\$"))
    return out


def detect_language(c) -> Column:
    """kana -> ja, ideographs -> zh, else en."""
    c = col(c)
    return (F.when(c.rlike(f"[{KANA}]"), "ja")
            .when(c.rlike("[\\x{4e00}-\\x{9fff}]"), "zh").otherwise("en"))


def needs_like(c) -> Column:
    """True when a blank-separated term has ideographs and fewer than three characters."""
    return F.exists(F.split(F.trim(col(c)), r"\s+"), lambda t: t.rlike(f"[{CJK}]") & (F.length(t) < 3))


def query_words(c) -> Column:
    """Distinct blank-separated terms of a query, without quote and bracket marks."""
    plain = F.regexp_replace(col(c), r'["*()]', " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: t != ""))


def ngrams(c, n: int = 3) -> Column:
    """All substrings of length ``n`` (none for shorter texts), case-folded.

    One regex pass: ``substring`` counts characters from the start, so a loop of it is quadratic.
    """
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"(?s)(?=(.{{{n}}}))."), 1)


def tails(c, n: int) -> Column:
    """The text from every position on, cut to ``n`` characters."""
    return F.regexp_extract_all(col(c), F.lit(f"(?s)(?=(.{{1,{n}}}))."), 1)


def strip_html(c) -> Column:
    """Plain lines of a web page: scripts, styles, comments and tags removed."""
    c = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)</(p|div|li|h[1-6]|tr|ul|nav|title|head|body)>|<br\s*/?>", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"[ \t]+", " ")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping, case-sensitive count of a term in a text; 0 for an empty term."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, F.floor(gone / F.length(term)).cast("long")).otherwise(F.lit(0))


def outer_json(c, kind: str = "array") -> Column:
    """Widest ``[...]`` or ``{...}`` span of noisy text, NULL when there is none."""
    pattern = r"(?s)(\[.*\])" if kind == "array" else r"(?s)(\{.*\})"
    return F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit(""))


def ip_is_internal(c) -> Column:
    """Private, loopback, link-local or carrier-shared address; invalid or missing is false."""
    c = col(c)
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    pattern = rf"^{octet}\.{octet}\.{octet}\.{octet}$"
    part = [F.regexp_extract(c, pattern, i).cast("int") for i in (1, 2)]
    a, b = part
    v4 = c.rlike(pattern) & (
        a.isin(10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)))
    v6 = F.lower(c).rlike(r"^(::1$|fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:)")
    return F.coalesce(v4 | v6, F.lit(False))


def device_class(c) -> Column:
    """phone / desktop from a user-agent text, a dash when it is empty."""
    c = col(c)
    return (F.when(F.coalesce(F.trim(c), F.lit("")) == "", "—")
            .when(c.rlike("(?i)mobile|iphone|android|ipad"), "phone").otherwise("desktop"))
