"""Incremental sync: snapshot diff, delete guard, skip rules, repair, staleness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmanual.functions.rules import any_keyword, col, first_match, first_prefix


def diff_snapshots(listing: DataFrame, state: DataFrame, key: str = "file_id", max_fails: int = 3) -> DataFrame:
    """(key, action, renamed, old_name): what a sync run would do with every file.

    ``listing`` (key, name, version), ``state`` (key, name, version, fails, oversize).
    """
    new, old = listing.alias("n"), state.alias("o")
    same = F.col("n.version") == F.col("o.version")
    fails = F.coalesce("o.fails", F.lit(0))
    action = (F.when(F.col("o.version").isNull(), "new").when(F.col("n.version").isNull(), "deleted")
              .when(~same, "changed").when(fails >= max_fails, "gave_up")
              .when((fails > 0) | F.coalesce("o.oversize", F.lit(False)), "retry").otherwise("unchanged"))
    return new.join(old, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer").select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key), action.alias("action"),
        F.coalesce(F.col("n.name") != F.col("o.name"), F.lit(False)).alias("renamed"), F.col("o.name").alias("old_name"))


def same_content(diff: DataFrame, hashes: DataFrame, state: DataFrame, key: str = "file_id") -> DataFrame:
    """Changed files whose new content hash equals the stored one need no reload."""
    j = diff.join(hashes.select(key, F.col("sha").alias("__new")), key, "left").join(
        state.select(key, F.col("sha").alias("__old")), key, "left")
    same = (F.col("action") == "changed") & (F.col("__new") == F.col("__old"))
    return j.withColumn("action", F.when(F.coalesce(same, F.lit(False)), "same_content").otherwise(F.col("action"))).drop("__new", "__old")


def guard_deletes(diff: DataFrame, max_delete: int = 20) -> DataFrame:
    """Deletions are held back when the listing is empty or too many files would go."""
    totals = diff.agg(F.count_if(F.col("action") == "deleted").alias("__del"), F.count_if(F.col("action") != "deleted").alias("__live"))
    safe = (F.col("__live") > 0) & (F.col("__del") <= max_delete)
    return (diff.join(F.broadcast(totals), F.lit(True))
            .withColumn("action", F.when((F.col("action") == "deleted") & ~safe, "delete_held").otherwise(F.col("action")))
            .drop("__del", "__live"))


def map_directory(path, rules: Sequence[tuple[str, str, bool]], default=("other", True)) -> Column:
    """struct<doc_type,sync> of the top folder."""
    kinds = first_prefix(path, [(p, k) for p, k, _ in rules], default[0])
    flags = first_prefix(path, [(p, s) for p, _, s in rules], default[1])
    return F.struct(kinds.alias("doc_type"), flags.alias("sync"))


def skip_reason(path, title, kind, size, keywords: Sequence[str] = (), titles: Sequence[str] = (),
                title_rules: Sequence[str] = (), kinds: Sequence[str] = (), limits: Mapping[str, int] | None = None) -> Column:
    """First reason to leave a file out, NULL to take it."""
    out = F.lit(None).cast("string")
    for k, limit in (limits or {}).items():
        out = F.when((col(kind) == k) & (col(size) > limit), "too large").otherwise(out)
    if kinds:
        out = F.when(col(kind).isin(*kinds), "type").otherwise(out)
    for r in title_rules:
        out = F.when(col(title).rlike(r), "title rule").otherwise(out)
    if titles:
        out = F.when(col(title).isin(*titles), "title").otherwise(out)
    return F.when(any_keyword(path, keywords), "path").otherwise(out) if keywords else out


def pending_manifest(manifest: DataFrame, state: DataFrame, sha: str = "sha", path: str = "path",
                     by_path: bool = False) -> DataFrame:
    """Manifest rows not loaded yet, by content hash (or by path for the checkpointed bulk load)."""
    key = path if by_path else sha
    return manifest.join(state.select(key).distinct(), key, "left_anti")


def missing_documents(mirror: DataFrame, stored: DataFrame, name: str = "name") -> DataFrame:
    return mirror.join(stored.select(name).distinct(), name, "left_anti")


def repair_paths(meta: DataFrame, files: DataFrame, name: str = "doc_name", path: str = "file_path") -> DataFrame:
    """Invalid path and exactly one file of that name gives the new path, else the reason."""
    found = files.groupBy(name).agg(F.count("*").alias("__n"), F.min(path).alias("__path"))
    valid = files.select(path, F.lit(True).alias("__ok")).distinct()
    j = meta.join(valid, path, "left").join(found, name, "left")
    result = (F.when(F.col("__ok"), "ok").when(F.col("__n").isNull(), "no file of that name")
              .when(F.col("__n") > 1, "several files of that name").otherwise("repaired"))
    return (j.withColumn("result", result).withColumn("new_path", F.when(F.col("result") == "repaired", F.col("__path"))
                                                      .otherwise(F.col(path))).drop("__ok", "__n", "__path"))


def stale_documents(meta: DataFrame, state: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents ingested after they were last indexed, or never indexed."""
    last = meta.groupBy(doc).agg(F.max("ingested_at").alias("ingested_at"))
    j = last.join(state.select(doc, "indexed_at"), doc, "left")
    return j.filter(F.col("indexed_at").isNull() | (F.col("ingested_at") > F.col("indexed_at")))


def resolve_title(title, kind, extensions: Mapping[str, str]) -> Column:
    """Title with the extension of its document type when it has none."""
    t, out = col(title), col(title)
    for k, ext in extensions.items():
        out = F.when((col(kind) == k) & ~t.rlike(r"\.[A-Za-z0-9]{1,5}$"), F.concat(t, F.lit(ext))).otherwise(out)
    return out


def classify_wiki_node(title, path, text, has_children, log_words: Sequence[str], sop: str) -> Column:
    """day log, skipped folder page, sop or manual."""
    dated = col(text).rlike(r"(?m)^[ \t　]*\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}(?:[ \t　].*)?$")
    return (F.when(any_keyword(title, log_words) & dated, "day_log")
            .when((F.length(text) < 150) & col(has_children), "skip")
            .otherwise(first_match(F.concat_ws("/", col(path), col(title)), [("sop", sop)], "manual")))
