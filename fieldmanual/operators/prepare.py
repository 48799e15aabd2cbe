"""Corpus preparation: sections, chunks, noise lines, packing, evidence scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmanual.functions import text as tx
from fieldmanual.operators import ordered as od
from fieldmanual.operators.ordered import top_k


def explode_sections(df: DataFrame, sections: Column, keep: Sequence[str]) -> DataFrame:
    """One row per section with its number, title and body."""
    return (df.select(*keep, F.posexplode(sections).alias("section_no", "s"))
            .select(*keep, F.col("section_no").cast("long").alias("section_no"),
                    F.col("s.title").alias("section_title"), F.col("s.body").alias("text")))


def split_by_headings(df: DataFrame, keep: Sequence[str], text: str = "text", max_chunk: int = 1024) -> DataFrame:
    return explode_sections(df, tx.heading_sections(text, max_chunk), keep)


def split_sections(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    return explode_sections(df, tx.whole_or_sections(text), keep)


def chunk_parent_child(df: DataFrame, keep: Sequence[str], text: str = "text", child: int = 256,
                       overlap: int = 32, min_len: int = 20) -> DataFrame:
    """Every section of ``min_len`` characters is a parent; longer than ``child`` characters, also children."""
    parts = (df.filter(F.length(text) >= min_len).withColumn("parent_hash", tx.short_id(text))
             .withColumn("__chunks", F.when(F.length(text) > child, tx.pack_sentences(text, child))))
    one = F.struct(F.lit("parent").alias("chunk_type"), F.lit(None).cast("string").alias("parent_hash"),
                   F.lit(0).alias("chunk_no"), F.col(text).alias("chunk"))
    many = F.transform(tx.overlap_chunks("__chunks", overlap), lambda c, i: F.struct(
        F.lit("child").alias("chunk_type"), F.col("parent_hash").alias("parent_hash"),
        (i + 1).alias("chunk_no"), c.alias("chunk")))
    rows = F.when(F.length(text) > child, F.concat(F.array(one), many)).otherwise(F.array(one))
    return (parts.select(*keep, F.explode(rows).alias("c")).select(*keep, "c.*")
            .withColumn("chunk_hash", tx.short_id("chunk")))


def chunk_sentences(df: DataFrame, keep: Sequence[str], text: str = "text", size: int = 512,
                    overlap: int = 64) -> DataFrame:
    packed = df.select(*keep, tx.pack_sentences(text, size).alias("__chunks"))
    return (packed.select(*keep, F.posexplode(tx.overlap_chunks("__chunks", overlap)).alias("chunk_no", "chunk"))
            .withColumn("chunk_hash", tx.short_id("chunk")))


def assign_page(sections: DataFrame, pages: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """As-of join: last page of the document that starts at or before the position, 1 when none.

    Both sides are laid on one axis and the page is carried forward, so no pairs are formed.
    """
    page_rows = pages.select(*keys, F.col("start_offset").alias("__p"), F.lit(0).alias("__k"),
                             F.col("page").cast("long").alias("__page"), F.lit(None).alias("__row"))
    # Sections at one position share the answer, so the axis carries distinct positions only.
    asked = sections.select(*keys, F.col(position).alias("__p"), F.lit(1).alias("__k"),
                            F.lit(None).cast("long").alias("__page"), F.lit(None).alias("__row")).distinct()
    axis = page_rows.unionByName(asked).withColumn("__q", F.col("__p").cast("long") * 2 + F.col("__k"))
    found = od.carry(axis, keys, "__q", F.col("__page"), "page").filter("__k = 1")
    pages_at = found.groupBy(*keys, F.col("__p").alias(position)).agg(F.max("page").alias("page"))
    return (sections.join(pages_at, [*keys, position], "left").withColumn("page", F.coalesce("page", F.lit(1))))


def section_position(body: Column, full_text: Column, probe: int = 50) -> Column:
    """Start of a section in its document found by its first characters; -1 when absent."""
    return F.instr(full_text, F.substring(body, 1, probe)).cast("long") - 1


def text_lines(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def repeated_lines(lines: DataFrame, doc: Sequence[str], line: str = "line", min_freq: int = 5,
                   max_len: int = 120) -> DataFrame:
    """Header and footer noise of each document: short lines that come back ``min_freq`` times."""
    c = F.col(line)
    step = r"^\s*(?:[-*•]\s+)?(?:(?:step|STEP|Step)\s*)?\d{1,2}\s*[.)．、](?!\d)"
    return (lines.filter((c != "") & (F.length(c) < max_len) & ~c.rlike(step))
            .groupBy(*doc, line).agg(F.count("*").alias("times")).filter(F.col("times") >= min_freq))


def drop_repeated_lines(lines: DataFrame, doc: Sequence[str], line: str = "line", min_freq: int = 5,
                        max_len: int = 120) -> DataFrame:
    """Lines without the repeated ones.  The noise table has one row per noisy line, counted map-side."""
    noise = repeated_lines(lines, doc, line, min_freq, max_len)
    return lines.join(noise, [*doc, line], "left_anti")


def drop_marked_spans(lines: DataFrame, doc: Sequence[str], seq: str, start: Column, end: Column) -> DataFrame:
    """Drop lines from a start marker through the end marker (an open span runs to the document end)."""
    mark = F.when(start, F.lit(1)).when(end, F.lit(0))
    inside = od.carry(lines, doc, seq, mark, "__in")
    return inside.filter((F.coalesce("__in", F.lit(0)) == 0) & ~F.coalesce(start, F.lit(False))
                         & ~F.coalesce(end, F.lit(False))).drop("__in")


def dedupe_content(df: DataFrame, order: Sequence[Column], text: str = "text", key: str = "content_key") -> DataFrame:
    """First row of each content key.  Copies collapse in each task before the shuffle."""
    return top_k(df.withColumn(key, tx.content_key(text)), [key], order, 1, "__r").drop("__r")


def pack_windows(df: DataFrame, by: Sequence[str], order: str, text: str = "text", title: str | None = None,
                 limit: int = 2600, measure: str = "text", min_chars: int = 0,
                 template: str | None = None, width: int = od.WIDTH) -> DataFrame:
    """Concatenate the passages of each document, in order, into windows of at most ``limit`` characters.

    A window closes before the passage that would take it over the limit.  ``measure='piece'`` counts
    the passage with its heading and splits a window that is still longer over several of at most ``limit`` characters.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    head = F.when(F.coalesce(F.col(title), F.lit("")) != "", F.concat(F.lit("## "), F.col(title), F.lit("\n"))
                  ).otherwise(F.lit("")) if title else F.lit("")
    bare = F.regexp_replace(body, template, "") if template else body
    rows = (df.filter(F.length(F.trim(bare)) >= min_chars)
            .withColumn("__piece", F.concat(head, body))
            .withColumn("__len", F.length(body if measure == "text" else F.concat(head, body)).cast("long")))
    lean = rows.select(*by, order, "__len")
    ends = od.cut_lineage(od.running_sum(lean, by, order, "__len", "__end", width=width))
    marked = od.keep_spaced(ends.withColumn("__start", F.col("__end") - F.col("__len")), by, order,
                            F.col("__start"), F.col("__end"), limit + 1, out="__opens", width=width)
    numbered = od.running_sum(marked.select(*by, order, "__opens"), by, order,
                              F.col("__opens").cast("long"), "window_no", width=width)
    items = rows.join(numbered.select(*by, order, "window_no"), [*by, order])
    parts = F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("o"), (F.col(title) if title else F.lit("")).alias("t"), F.col("__piece").alias("p"))))
    packed = items.groupBy(*by, "window_no").agg(parts.alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["p"]), "\n" if title else "")
    titles = F.filter(F.transform("parts", lambda x: x["t"]), lambda t: t != "")
    out = packed.select(
        *by, "window_no", joined.alias("text"),
        F.substring(F.array_join(F.slice(titles, 1, 3), " / "), 1, 40).alias("label"),
        F.size("parts").alias("n_passages"))
    if measure == "text":
        return out
    out = od.cut_lineage(out.withColumn("__pieces", F.greatest(F.ceil(F.length("text") / limit), F.lit(1)).cast("long")))
    counts = od.running_sum(out.select(*by, "window_no", "__pieces"), by, "window_no", "__pieces", "__before", inclusive=False, width=width)
    cut = out.join(counts.select(*by, "window_no", "__before"), [*by, "window_no"]).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1)))
    return cut.select(*by, (F.col("__before") + F.col("__i") + 1).alias("window_no"), F.expr(f"substring(text, cast(__i * {limit} + 1 as int), {limit})").alias("text"), "label", "n_passages")


def score_evidence(df: DataFrame, doc: str, seq: str, pattern: str, title: str | None = None,
                   stop_titles: str | None = None, text: str = "text", min_score: int = 3,
                   skip_share: float = 0.05) -> DataFrame:
    """Passages with at least ``min_score`` hits, past the first share of their document and stop sections."""
    placed = od.row_positions(df, [doc], seq, "__pos")
    sizes = df.groupBy(doc).agg(F.count("*").alias("__n"))
    out = (placed.join(sizes, doc).filter(F.col("__pos") >= F.floor(F.col("__n") * skip_share))
           .withColumn("score", F.regexp_count(text, F.lit(pattern))))
    if stop_titles and title:
        out = out.filter(~F.coalesce(F.col(title).rlike(stop_titles), F.lit(False)))
    return out.filter(F.col("score") >= min_score).drop("__pos", "__n")


def order_candidates(df: DataFrame, trouble: Column, priority: Column, ties: Sequence[str]) -> DataFrame:
    """Trouble documents first, then family priority, then score."""
    return df.orderBy((~trouble).cast("int"), priority, F.desc("score"), *ties)


def day_fingerprint(day: Column, text: Column) -> Column:
    return F.concat(F.lit("d:"), F.md5(F.concat(day.cast("string"), F.trim(text))))


def week_windows(days: DataFrame, processed: DataFrame | None, log: str = "log_id", day: str = "day",
                 text: str = "text", min_chars: int = 40, limit: int = 2600,
                 done_before: Column | None = None) -> DataFrame:
    """Unprocessed days of a log packed into windows inside each ISO week."""
    keyed = (days.withColumn("day_key", day_fingerprint(F.col(day), F.col(text)))
             .filter(F.length(F.trim(text)) >= min_chars))
    if processed is not None:
        keyed = keyed.join(processed.select("day_key").distinct(), "day_key", "left_anti")
    if done_before is not None:
        keyed = keyed.filter(F.col(day) >= done_before)
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col(day)), F.extract(F.lit("WEEK"), F.col(day)))
    placed = keyed.withColumn("week", week).withColumn("__seq", F.unix_date(day).cast("long"))
    # A week has at most seven days, so its fold is bounded.
    lens = F.length(text)
    parts = placed.groupBy(log, "week").agg(F.array_sort(F.collect_list(F.struct(
        F.col("__seq").alias("o"), F.col(text).alias("t"), F.col("day_key").alias("k"), lens.alias("n")))).alias("parts"))
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ids"))

    def add(acc, x):
        flush = (acc["n"] > 0) & (acc["n"] + x["n"] > limit)
        w = acc["w"] + flush.cast("int")
        return F.struct(w.alias("w"), (F.when(flush, x["n"]).otherwise(acc["n"] + x["n"])).alias("n"),
                        F.concat(acc["ids"], F.array(w)).alias("ids"))

    ids = F.aggregate("parts", start, add, lambda a: a["ids"])
    return (parts.select(log, "week", F.explode(F.arrays_zip(F.col("parts").alias("p"), ids.alias("w"))).alias("z"))
            .groupBy(log, "week", F.col("z.w").alias("window_no"))
            .agg(F.array_sort(F.collect_list(F.col("z.p"))).alias("p"))
            .select(log, "week", "window_no", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"),
                    F.transform("p", lambda x: x["k"]).alias("day_keys")))


def is_day_log(passages: DataFrame, doc: str, title: str, pattern: str = r"^\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}",
               share: float = 0.8) -> DataFrame:
    """Documents whose titles are dates in at least ``share`` of the passages."""
    hit = F.avg(F.coalesce(F.col(title).rlike(pattern), F.lit(False)).cast("int"))
    return passages.groupBy(doc).agg(hit.alias("dated_share")).filter(F.col("dated_share") >= share)


SIEVE_WORDS = 8  # words of 64 bits for every gram asked, of which one bit is set: one other gram in 512 passes
MAX_SIEVE_WORDS = 4_096


def _sieve_place(gram: Column, words: Column) -> tuple[Column, Column]:
    """Word and bit of a sieve that a gram falls into."""
    h = F.xxhash64(gram)
    return F.pmod(F.shiftrightunsigned(h, 6), words), h.bitwiseAND(F.lit(63)).cast("int")


def _gram_sieve(grams: DataFrame, doc: str, gram: str) -> DataFrame:
    """(doc, __ns, __sieve): lengths of the grams asked in a document, and bits that tell most others apart (fewer of them beyond ``MAX_SIEVE_WORDS``)."""
    per = (grams.groupBy(doc).agg(F.collect_set(F.length(gram)).alias("__ns"), F.count("*").alias("__n"))
           .select(doc, "__ns", F.least(F.col("__n") * SIEVE_WORDS, F.lit(MAX_SIEVE_WORDS)).alias("__words")))
    word, bit = _sieve_place(F.col(gram), F.col("__words"))
    held = grams.join(per, doc).select(doc, word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m")).groupBy(doc, "w").agg(F.bit_or("m").alias("m"))
    every = per.select(doc, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__words") - 1)).alias("w"))
    sieve = F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0)).alias("m")))), lambda x: x["m"])
    return every.join(held, [doc, "w"], "left").groupBy(doc).agg(sieve.alias("__sieve")).join(per.select(doc, "__ns"), doc)


def _asked_grams(flat: DataFrame, grams: DataFrame, doc: str, longest: int) -> DataFrame:
    """(doc, page, __g, tail): every place of a page whose gram is asked in its document, and a few more."""
    word, bit = _sieve_place(F.col("__g"), F.size("__sieve").cast("long"))
    held = F.call_function("shiftright", F.get(F.col("__sieve"), word.cast("int")), bit).bitwiseAND(F.lit(1)) == 1
    return (flat.join(_gram_sieve(grams, doc, "__g"), doc).select(doc, "page", "__ns", "__sieve", F.explode(tx.tails("__t", longest)).alias("tail"))
            .select(doc, "page", "__sieve", "tail", F.explode("__ns").alias("__n"))
            .filter(F.length("tail") >= F.col("__n"))
            .select(doc, "page", "__sieve", F.substr("tail", F.lit(1), F.col("__n")).alias("__g"), "tail").filter(held).drop("__sieve"))


def locate_snippet(snippets: DataFrame, pages: DataFrame, doc: str, key: str, snippet: str = "snippet",
                   page_text: str = "page_text", probes: Sequence[int] = (40, 24, 14)) -> DataFrame:
    """Lowest page of the document holding the start of a snippet; shorter probes retried, else page 1.

    Every probe begins with the shortest one, so pages are looked up by an equi-join on substrings of
    that length, and the longer probes are compared at the place found.  A page meets the sieve of its document
    first, so of its substrings hardly any but those asked for are shuffled.
    """
    shortest, longest = min(probes), max(probes)
    squeezed = F.regexp_replace(F.col(snippet), r"\s+", "")
    asked = snippets.select(doc, key, F.substring(squeezed, 1, longest).alias("__p")).filter("__p <> ''")
    asked = asked.withColumn("__g", F.substring("__p", 1, shortest))
    wanted = asked.select(doc, "__g", "__p").distinct()
    flat = pages.select(doc, "page", F.regexp_replace(page_text, r"\s+", "").alias("__t"))
    grams = _asked_grams(flat, wanted.select(doc, "__g").distinct(), doc, longest)
    hits = grams.join(wanted, [doc, "__g"])
    level = F.lit(0)
    for i, n in enumerate(sorted(probes)):
        probe = F.substring("__p", 1, n)
        level = F.when(F.substring(F.col("tail"), F.lit(1), F.length(probe)) == probe, F.lit(i + 1)).otherwise(level)
    best = (hits.withColumn("__l", level).groupBy(doc, "__p")
            .agg(F.min(F.struct((-F.col("__l")).alias("l"), F.col("page").alias("page"))).alias("b")))
    found = asked.join(best, [doc, "__p"]).select(doc, key, F.col("b.page").alias("page"))
    return snippets.join(found, [doc, key], "left").withColumn("page", F.coalesce("page", F.lit(1)))
