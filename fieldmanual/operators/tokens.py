"""Identifier index over pages, page tags, and candidate cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmanual.functions.rules import Rules, any_keyword, col, first_match
from fieldmanual.operators.ordered import top_k

# How likely each kind of drawing shows a connection.
KIND_PRIORITY = {"block": 3, "general_wiring": 3, "wiring": 2, "board_circuit": 0}

# Shapes of drawing identifiers.
IDENTIFIER_PATTERNS = (
    r"(?<![A-Z0-9])\d{4}[A-Z]\d?[A-Z]?(?:-[A-Z0-9]+)?(?![A-Z0-9])",
    r"(?<![A-Z0-9])\d?[A-Z]\d{3}-\d{3}(?:-\d+)?(?![A-Z0-9])",
    r"(?<![A-Z0-9])[A-Z]-\d{3,4}(?![A-Z0-9])",
    r"(?<![A-Z0-9])[A-Z]{2}-[A-Z]{2,5}\d[A-Z0-9]*(?:-[A-Z0-9]+)?(?![A-Z0-9])",
    r"(?<![A-Z0-9])[A-Z]{2}\d{1,3}[A-Z]?(?![A-Z0-9])",
)


def page_tokens(c, patterns: Sequence[str] = IDENTIFIER_PATTERNS, min_len: int = 4) -> Column:
    """Distinct upper-case identifiers of a page."""
    text = F.upper(col(c))
    found = [F.regexp_extract_all(text, F.lit(f"({p})"), 1) for p in patterns]
    return F.array_distinct(F.filter(F.concat(*found), lambda t: F.length(t) >= min_len))


def page_number(title) -> Column:
    return F.nullif(F.regexp_extract(col(title), r"(\d+)", 1), F.lit("")).cast("int")


def build_token_index(pages: DataFrame, keep: Sequence[str], text: str = "text",
                      patterns: Sequence[str] = IDENTIFIER_PATTERNS, min_len: int = 4) -> DataFrame:
    return pages.select(*keep, F.explode(page_tokens(text, patterns, min_len)).alias("token"))


def refresh_token_index(index: DataFrame, pages: DataFrame, stale: DataFrame, doc: str,
                        keep: Sequence[str], **options) -> DataFrame:
    """Replace the postings of the stale documents only."""
    fresh = build_token_index(pages.join(stale.select(doc), doc, "left_semi"), keep, **options)
    return index.join(stale.select(doc), doc, "left_anti").unionByName(fresh)


def lookup_tokens(index: DataFrame, asked: DataFrame, key: str = "query_id", page: Sequence[str] = ("doc", "page"),
                  limit: int = 8) -> DataFrame:
    """Pages by number of distinct asked tokens, then page."""
    n = (index.join(asked.select(key, "token").distinct(), "token")
         .groupBy(key, *page).agg(F.countDistinct("token").alias("n_tokens")))
    return top_k(n, [key], [F.desc("n_tokens"), *[F.col(c) for c in page]], limit)


def lookup_page_numbers(queries: DataFrame, pages: DataFrame, key: str, question: str, page: str = "page",
                        pattern: str = r"(?i)(?:page|p\.|第)\s*(\d+)") -> DataFrame:
    nums = queries.select(key, F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(question, F.lit(pattern), 1), lambda x: x.cast("long")))).alias(page))
    return pages.join(nums, page).distinct()


def tag_pages(pages: DataFrame, text: str, kinds: Rules, unit: str) -> DataFrame:
    """Kind of the first matching rule, and the first unit mention, blank-collapsed and upper case."""
    found = F.upper(F.regexp_replace(F.regexp_extract(F.col(text), f"({unit})", 1), r"\s+", " "))
    return (pages.withColumn("kind", first_match(text, [(k, f"(?i){p}") for k, p in kinds]))
            .withColumn("unit", F.nullif(found, F.lit(""))))


def rank_connection_pages(hits: DataFrame, key: str, question: str, words: Sequence[str], kind: str = "kind",
                          position: str = "position") -> DataFrame:
    """Stable order by drawing kind when the question asks for a connection; else the given order."""
    prio = F.lit(1)
    for k, p in KIND_PRIORITY.items():
        prio = F.when(F.col(kind) == k, F.lit(p)).otherwise(prio)
    asks = any_keyword(question, words)
    w = W.partitionBy(key).orderBy(F.when(asks, -prio).otherwise(F.lit(0)), position)
    return hits.withColumn("new_position", F.row_number().over(w))


def cascade_candidates(hits: DataFrame, key: str = "query_id", page: Sequence[str] = ("doc", "page"),
                       max_n: int = 2, unit: Column | None = None) -> DataFrame:
    """Channels in order; a later one counts only while fewer than ``max_n`` hits came before it."""
    per = hits.groupBy(key, "channel").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy("channel")
                                          .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    used = per.withColumn("__before", before).filter(F.col("__before") < max_n).select(key, "channel")
    first = (hits.join(used, [key, "channel"]).withColumn("__u", unit if unit is not None else F.lit(True))
             .groupBy(key, *page).agg(F.min(F.struct("channel", "rank")).alias("__first"), F.max("__u").alias("__u")))
    if unit is not None:
        some = first.groupBy(key).agg(F.max("__u").alias("__any"))
        first = first.join(some, key).filter(F.col("__u") | ~F.col("__any"))
    flat = first.select(key, *page, "__first.channel", F.col("__first.rank").alias("hit_rank"))
    return top_k(flat, [key], [F.col("channel"), F.col("hit_rank"), *[F.col(c) for c in page]], max_n)


def page_candidates(text_hits: DataFrame, vector_hits: DataFrame, key: str = "query_id",
                    page: Sequence[str] = ("doc", "page"), k: int = 4) -> DataFrame:
    """Text hits (at most 2k), then vector hits only when they are fewer than k; first per page, cut to k."""
    text = text_hits.filter(F.col("rank") <= 2 * k).withColumn("channel", F.lit(1))
    both = text.select(key, *page, "rank", "channel").unionByName(
        vector_hits.withColumn("channel", F.lit(2)).select(key, *page, "rank", "channel"))
    return cascade_candidates(both, key, page, max_n=k)


def distinct_excerpts(hits: DataFrame, key: str, doc: str, text: str, order: str, n: int = 3) -> DataFrame:
    """First ``n`` hits that differ in document or in the first 30 characters."""
    firsts = (hits.withColumn("__head", F.substring(text, 1, 30)).groupBy(key, doc, "__head")
              .agg(F.min_by(F.struct(F.col(order), F.col(text)), order).alias("x")))
    return top_k(firsts.select(key, doc, "x.*"), [key], [F.col(order), F.col(doc)], n)
