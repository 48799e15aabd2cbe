"""Fault cases and their roll-up into entries.

List-valued results that can grow with the data (customers, parts, causes) are child tables in long
form, one row per value, so no entry is ever gathered into one row or one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmanual.functions import codes as cd
from fieldmanual.functions.rules import any_keyword, blank_to_null, first_match
from fieldmanual.operators import access, lexical
from fieldmanual.operators.ordered import top_k

NO_CUSTOMERS = ("", "none")


def upsert_cases(existing: DataFrame | None, incoming: DataFrame, fields: Sequence[str], source: str = "src_doc",
                 key: str = "dedup_key", order: str = "ord") -> DataFrame:
    """One row per (source, key): first row wins, dates are united; ``changed`` marks new rows and new dates.

    ``dates`` is an array of dates, so its union is bounded by the calendar.
    """
    new = incoming.withColumn("__new", F.lit(1))
    both = new if existing is None else existing.withColumn("__new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    first = F.min_by(F.struct(*fields), F.struct("__new", order))
    head = both.groupBy(source, key).agg(first.alias("x"), F.min("__new").alias("__new"))
    dated = (both.select(source, key, "__new", F.explode("dates").alias("d"))
             .groupBy(source, key, "d").agg(F.min("__new").alias("n")))
    dates = dated.groupBy(source, key).agg(F.array_sort(F.collect_list("d")).alias("dates"), F.max("n").alias("__newdate"))
    return (head.join(dates, [source, key], "left")
            .select(source, key, *[F.col(f"x.{f}").alias(f) for f in fields],
                    F.coalesce("dates", F.array().cast("array<date>")).alias("dates"),
                    ((F.col("__new") == 1) | (F.coalesce("__newdate", F.lit(0)) == 1)).alias("changed")))


def site_of(customer, source) -> Column:
    return F.when(F.coalesce(F.col(customer), F.lit("")).isin(*NO_CUSTOMERS), F.col(source)).otherwise(F.col(customer))


def occurrences(cases: DataFrame, entry: Sequence[str] = ("entry_key",), site: str = "site", day: str = "day",
                gap_days: int = 3) -> DataFrame:
    """(entry, occ_start): a new occurrence when the gap to the previous date of the site exceeds ``gap_days``.

    Dates are made distinct first, so a site holds at most one row per calendar day.  A case without
    a date is an occurrence of its own with a NULL start.
    """
    days = cases.filter(F.col(day).isNotNull()).select(*entry, site, day).distinct()
    before = F.lag(day).over(W.partitionBy(*entry, site).orderBy(day))
    starts = days.withColumn("__b", before).filter(
        F.col("__b").isNull() | (F.datediff(F.col(day), F.col("__b")) > gap_days))
    undated = cases.filter(F.col(day).isNull()).select(*entry, F.lit(None).cast("date").alias("occ_start"))
    return starts.select(*entry, F.col(day).cast("date").alias("occ_start")).unionByName(undated)


def rollup_entries(cases: DataFrame, entry: Sequence[str] = ("entry_key",), day: str = "day", site: str = "site",
                   gap_days: int = 3) -> DataFrame:
    """Counters of each entry: occurrences, dates, open cases, customers, parts, review."""
    base = cases.groupBy(*entry).agg(
        F.count("*").alias("n_cases"), F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        F.count_if(F.coalesce(F.col("status"), F.lit("")) != "Close").alias("open_count"),
        F.bool_and(F.col("review") == "confirmed").alias("all_confirmed"))
    occ = occurrences(cases, entry, site, day, gap_days).groupBy(*entry).agg(F.count("*").alias("occ_count"))
    custs = entry_customers(cases, entry).groupBy(*entry).agg(F.count("*").alias("n_customers"))
    parts = entry_parts(cases, entry).groupBy(*entry).agg(F.count("*").alias("n_parts"))
    out = base.join(occ, list(entry), "left").join(custs, list(entry), "left").join(parts, list(entry), "left")
    return out.fillna(0, ["occ_count", "n_customers", "n_parts"])


def entry_customers(cases: DataFrame, entry: Sequence[str]) -> DataFrame:
    return cases.filter(~F.coalesce("customer", F.lit("")).isin(*NO_CUSTOMERS)).select(*entry, "customer").distinct()


def entry_parts(cases: DataFrame, entry: Sequence[str], parts: str = "parts") -> DataFrame:
    each = cases.select(*entry, F.explode(F.split(F.col(parts), "[；;、,，]")).alias("part"))
    return each.select(*entry, F.trim("part").alias("part")).filter("part <> ''").distinct()


def merge_rollup(entries: DataFrame, rolled: DataFrame, key: str = "entry_key") -> DataFrame:
    """Refresh entry counters; confirmed or edited entries get ``has_new``, fully confirmed pending ones confirm."""
    fresh = ["occ_count", "first_date", "last_date", "open_count", "n_customers", "n_parts"]
    kept = [c for c in entries.columns if c not in (*fresh, "status", "has_new")]
    joined = entries.alias("e").join(rolled.alias("r"), key, "left")
    touched = F.col("r.n_cases").isNotNull()
    promote = touched & F.col("r.all_confirmed") & (F.col("e.status") == "pending") & (F.col("e.edited") == 0)
    has_new = touched & ((F.col("e.edited") == 1) | (F.col("e.status") == "confirmed"))
    return joined.select(*[F.col(f"e.{c}") if c != key else F.col(key) for c in kept], *[F.col(f"r.{c}") for c in fresh],
                         F.when(promote, "confirmed").otherwise(F.col("e.status")).alias("status"),
                         F.when(has_new, 1).otherwise(F.col("e.has_new")).alias("has_new"))


def experience_mix(cases: DataFrame, entry: Sequence[str] = ("entry_key",), kind: str = "exp_type") -> DataFrame:
    """``type count`` pairs of an entry joined in type order (there are only a few types)."""
    per = cases.groupBy(*entry, kind).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat(F.col(kind), F.lit(" "), F.col("n").cast("string"))))
    return per.groupBy(*entry).agg(F.array_join(pairs, "·").alias("exp_mix"))


def rank_causes(cases: DataFrame, entry: Sequence[str] = ("entry_key",), cause: str = "root_cause",
                category: str = "rc_category", kind: str = "exp_type", top: int | None = None) -> DataFrame:
    """Causes with counts by experience type, exact texts grouped; most frequent first."""
    field, refurb = F.count_if(F.col(kind) == "field"), F.count_if(F.col(kind) == "refurb")
    out = (cases.filter(blank_to_null(cause).isNotNull()).groupBy(*entry, cause, category)
           .agg(field.alias("field"), refurb.alias("refurb"), F.count("*").alias("n"))
           .withColumn("count", F.when(F.col("field") + F.col("refurb") > 0, F.col("field") + F.col("refurb"))
                       .otherwise(F.col("n"))).drop("n"))
    if top:
        return top_k(out, entry, [F.desc("count"), F.col(cause), F.col(category)], top)
    return out.orderBy(*entry, F.desc("count"), cause)


def rank_solutions(cases: DataFrame, entry: Sequence[str] = ("entry_key",), action: str = "solution",
                   cause: str = "root_cause", kind: str = "exp_type", top: int | None = None) -> DataFrame:
    """Solutions of solved cases, each tied to its cause."""
    solved = cases.filter((F.col("status") == "Close") & blank_to_null(action).isNotNull())
    return rank_causes(solved.withColumnRenamed(action, "__a").withColumnRenamed(cause, "__c"), entry, "__a", "__c",
                       kind, top).withColumnRenamed("__a", action).withColumnRenamed("__c", cause)


def remerge(entries: DataFrame, key: str = "new_key", ident: str = "id", edited: str = "edited") -> DataFrame:
    """(id, survivor): edited rows first, then the lowest id keeps a recomputed key."""
    best = entries.groupBy(key).agg(F.min_by(ident, F.struct(-F.col(edited), F.col(ident))).alias("survivor"))
    return entries.join(best, key).select(ident, key, "survivor", (F.col(ident) != F.col("survivor")).alias("merged"))


def repoint_cases(cases: DataFrame, mapping: DataFrame, ident: str = "id") -> DataFrame:
    m = mapping.filter("merged").select(F.col(ident).alias("entry_id"), "survivor")
    return cases.join(m, "entry_id", "left").withColumn("entry_id", F.coalesce("survivor", "entry_id")).drop("survivor")


def oem_key(source, machine, unit, axis, code, title) -> Column:
    tail = F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(F.substring(cd.norm_text(title), 1, 40))
    return F.concat_ws("|", F.lit("oem"), source, machine, unit, F.coalesce(axis, F.lit("")), tail)


def upsert_oem(entries: DataFrame, items: DataFrame, key: str = "entry_key",
               content: Sequence[str] = ("title", "root_causes", "solutions"), keep_edited: bool = False) -> DataFrame:
    """Insert manufacturer entries; on an existing key replace the content fields only.

    Items hold ``causes array<struct<cause,rate,steps array<struct<check,details>>>>``; a missing rate
    is the ordinal.
    """
    causes = F.transform("causes", lambda c, i: F.struct(
        c["cause"].alias("cause"), F.coalesce(c["rate"], i + 1).alias("count")))
    steps = F.filter(F.flatten(F.transform("causes", lambda c: c["steps"])), lambda s: F.coalesce(s["check"], F.lit("")) != "")
    sols = F.transform(steps, lambda s: F.concat(s["check"], F.when(
        F.coalesce(s["details"], F.lit("")) != "", F.concat(F.lit("（"), s["details"], F.lit("）"))).otherwise("")))
    fresh = items.withColumn("root_causes", causes).withColumn("solutions", sols).drop("causes")
    cols = [c for c in entries.columns if c != key]
    j = entries.alias("e").join(fresh.alias("n"), key, "full_outer")
    is_new = F.col("e.status").isNull()
    take = F.col("n.title").isNotNull()
    if keep_edited:
        take = take & (F.coalesce("e.edited", F.lit(0)) == 0)

    def value(c):
        if c in content:
            return F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"e.{c}"))
        if c in fresh.columns:
            return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"e.{c}"))
        return F.col(f"e.{c}")

    return j.select(key, *[value(c).alias(c) for c in cols])


def related_groups(entries: DataFrame, machine: str = "machine", key: str = "match_key", origin: str = "origin") -> DataFrame:
    """Entries that share machine and key with one of another origin, marked with their group.

    The group is the answer: entries of one group and different origin are related.  Pairs are not
    spelled out, so a group of any size costs its own rows.
    """
    groups = (entries.filter(F.coalesce(key, F.lit("")) != "").groupBy(machine, key)
              .agg(F.countDistinct(origin).alias("n_origins"), F.count("*").alias("group_size")).filter("n_origins > 1"))
    return entries.join(groups, [machine, key])


def related_entries(entries: DataFrame, wanted: DataFrame, ident: str = "id") -> DataFrame:
    """Related entries of a few wanted ids (wanted_id, id)."""
    e = entries.filter(F.coalesce("match_key", F.lit("")) != "")
    w = e.join(wanted.select(ident), ident, "left_semi").select(
        F.col(ident).alias("wanted_id"), "machine", "match_key", F.col("origin").alias("own_origin"))
    return e.join(w, ["machine", "match_key"]).filter(F.col("origin") != F.col("own_origin")).select("wanted_id", ident)


def alarm_view(entries: DataFrame, causes: DataFrame, solutions: DataFrame,
               by: Sequence[str] = ("machine", "match_key")) -> DataFrame:
    """Long view of one alarm across origins: (machine, key, section, label, text, weight).

    Manufacturer causes carry their rate, field and refurbishment causes their counts, actions are
    listed by source.  Sort by section and falling weight to read it.
    """
    head = entries.groupBy(*by).agg(
        F.sum(F.when(F.col("origin") != "oem", F.col("occ_count")).otherwise(0)).alias("total"),
        F.count_if(F.col("origin") == "oem").alias("n_oem"))
    heads = head.select(*by, F.lit("0 total").alias("section"), F.concat(F.lit("oem:"), F.col("n_oem").cast("string")).alias("label"),
                        F.lit("").alias("text"), F.col("total").cast("long").alias("weight"))
    e = entries.select("entry_key", *by, "origin")
    c = (causes.join(e, "entry_key").groupBy(*by, "origin", F.col("root_cause").alias("text"))
         .agg(F.sum("count").alias("weight")))
    cause_rows = c.select(*by, F.lit("1 cause").alias("section"), F.col("origin").alias("label"), "text", F.col("weight").cast("long"))
    s = solutions.join(e, "entry_key")
    acts = s.select(*by, F.col("solution").alias("text"), F.explode(F.array(
        F.struct(F.when(F.col("origin") == "oem", "oem").otherwise("field").alias("label"), F.col("field").alias("w")),
        F.struct(F.lit("refurb").alias("label"), F.col("refurb").alias("w")))).alias("x")).filter("x.w > 0")
    act_rows = (acts.groupBy(*by, F.col("x.label").alias("label"), "text").agg(F.sum("x.w").cast("long").alias("weight"))
                .select(*by, F.lit("2 action").alias("section"), "label", "text", "weight"))
    return heads.unionByName(cause_rows).unionByName(act_rows)


def entry_visible(entries: DataFrame, cases: DataFrame, principal: Mapping | None, admin: bool = False,
                  manual: str = "oem_manual", fault: str = "fault_history") -> DataFrame:
    """Entries the principal may read: confirmed, category and family granted, customers granted."""
    if admin:
        return entries
    confirmed = entries.filter(F.col("status") == "confirmed")
    models = F.array("machine")
    is_oem = F.coalesce("origin", F.lit("field")) == "oem"
    oem = confirmed.filter(is_oem & access.category_visible(principal, F.lit(manual), models))
    field = confirmed.filter(~is_oem & access.category_visible(principal, F.lit(fault), models))
    granted = list(principal["customers"]) if principal else []
    free = F.coalesce("customer", F.lit("")).isin(*NO_CUSTOMERS)
    mine = F.col("customer").isin(*granted) if granted else F.lit(False)
    open_to = cases.groupBy("entry_id").agg(
        F.max((free | F.coalesce(mine, F.lit(False))).cast("int")).alias("open"))
    blocked = open_to.filter("open = 0").select(F.col("entry_id").alias("id"))
    return oem.unionByName(field.join(blocked, "id", "left_anti"))


def search_entries(entries: DataFrame, keyword: str = "", haystack: Sequence[str] = ("title", "error_code", "unit"),
                   limit: int | None = None, **filters) -> DataFrame:
    """Equality filters and keywords; field before manufacturer, then occurrences, last date, id."""
    df = entries
    for c, v in filters.items():
        if v is None:
            continue
        df = df.filter(F.col("has_new") == 1) if (c, v) == ("status", "has_new") else df.filter(F.col(c) == v)
    hay = F.lower(F.concat_ws(" ", *haystack))
    for word in keyword.lower().split():
        df = df.filter(hay.contains(word))
    out = df.orderBy((F.coalesce("origin", F.lit("field")) == "oem").cast("int"), F.desc("occ_count"),
                     F.desc("last_date"), "id")
    return out.limit(limit) if limit else out


def review_queue(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("status") == "pending").orderBy("updated_at", "id")


def gate_ids(selected: DataFrame, filtered: DataFrame, acknowledged: bool, use_all: bool) -> DataFrame:
    """Distinct positive whole ids to confirm; none without acknowledgement."""
    source = filtered if use_all else selected
    ids = source.select(F.col("id").cast("string").try_cast("long").alias("id")).filter("id > 0").distinct()
    return ids if acknowledged else ids.limit(0)


def confirm_entries(entries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, outcome): only pending rows change; outcome is confirmed / skipped / missing per id."""
    wanted = ids.select(F.col("id").cast("string").try_cast("long").alias("id")).filter("id > 0").distinct()
    hit = entries.join(wanted.withColumn("__w", F.lit(True)), "id", "left")
    go = F.coalesce("__w", F.lit(False)) & (F.col("status") == "pending")
    changed = (hit.withColumn("__go", go).withColumn("status", F.when(F.col("__go"), "confirmed").otherwise(F.col("status")))
               .withColumn("edited", F.when(F.col("__go"), 1).otherwise(F.col("edited")))
               .withColumn("has_new", F.when(F.col("__go"), 0).otherwise(F.col("has_new"))).drop("__w", "__go"))
    outcome = wanted.join(entries.select("id", "status"), "id", "left").select(
        "id", F.when(F.col("status").isNull(), "missing").when(F.col("status") == "pending", "confirmed")
        .otherwise("skipped").alias("outcome"))
    return changed, outcome


def confirm_cases(cases: DataFrame, outcome: DataFrame) -> DataFrame:
    done = outcome.filter(F.col("outcome") == "confirmed").select(F.col("id").alias("entry_id"), F.lit(True).alias("__d"))
    return cases.join(done, "entry_id", "left").withColumn(
        "review", F.when(F.col("__d"), "confirmed").otherwise(F.col("review"))).drop("__d")


def _substrings(c: Column, lengths: Column) -> Column:
    ok = F.filter(lengths, lambda n: n <= F.length(c))
    return F.array_distinct(F.flatten(F.transform(ok, lambda n: F.transform(
        F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))))


def match_entries(queries: DataFrame, entries: DataFrame, code_shape: str, qid: str = "query_id", question: str = "question",
                  names: str | None = None, k: int = 4,
                  haystack: Sequence[str] = ("title", "error_code", "unit")) -> DataFrame:
    """Tiered matching of alarm questions to entries: key 12, code part 10, alarm name 8, main code 3, words.

    Each tier is an equi-join (on key, on code substrings, on one word of the name, on the main code),
    so no question meets entries it shares nothing with.  ``code_shape`` is a pattern whose first group is a code; ``names`` holds the words of the alarm name.
    """
    upper = F.upper(question)
    q = queries.withColumn("codes", F.array_distinct(F.regexp_extract_all(upper, F.lit(code_shape), 1)))
    codes = q.select(qid, F.explode("codes").alias("code")).withColumn("mkey", cd.match_key("code"))
    e = entries.withColumn("ckey", cd.code_key("error_code"))
    pair = r"^[0-9A-F]{2}-"
    t12 = (codes.filter("mkey <> ''").select(qid, F.col("mkey").alias("match_key")).distinct()
           .join(e.select("id", "match_key"), "match_key").select(qid, "id", F.lit(12).alias("score")))
    long_codes = codes.filter(F.length("code") >= 4).select(qid, "code").distinct()
    # Code lengths are few (codes are at most 60 characters long).
    sizes = long_codes.agg(F.collect_set(F.length("code")).alias("sizes"))
    parts = (e.filter("ckey <> ''").select("id", "ckey").join(F.broadcast(sizes), F.lit(True))
             .select("id", F.explode(_substrings(F.col("ckey"), F.col("sizes"))).alias("code")))
    t10a = parts.join(long_codes, "code").select(qid, "id", F.lit(10).alias("score"))
    inner = long_codes.select(qid, F.explode(_substrings(F.col("code"), F.sequence(F.lit(1), F.length("code")))).alias("ckey")).distinct()
    t10b = e.filter("ckey <> ''").select("id", "ckey").join(inner, "ckey").select(qid, "id", F.lit(10).alias("score"))
    mains = codes.filter(F.col("mkey").rlike(pair)).select(qid, F.substring("mkey", 1, 2).alias("main")).distinct()
    t3 = (e.filter(F.col("match_key").rlike(pair)).select("id", F.substring("match_key", 1, 2).alias("main"))
          .join(mains, "main").select(qid, "id", F.lit(3).alias("score")))
    hits = t12.unionByName(t10a).unionByName(t10b).unionByName(t3)
    hay = F.lower(F.concat_ws(" ", *haystack))
    if names:
        words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(names), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 3))
        named = (q.select(qid, words.alias("words")).filter(F.size("words") >= 2)
                 .withColumn("word", F.array_max(F.transform("words", lambda w: F.struct(F.length(w), w)))["col2"]))
        open_e = e.filter((F.coalesce("origin", F.lit("field")) != "oem") & ~F.coalesce("match_key", F.lit("")).rlike(pair))
        bag = open_e.select("id", F.array_distinct(F.regexp_extract_all(hay, F.lit("([a-z0-9]+)"), 1)).alias("bag"))
        t8 = (bag.withColumn("word", F.explode("bag")).join(named, "word")
              .filter(F.size(F.array_except("words", "bag")) == 0).select(qid, "id", F.lit(8).alias("score")))
        hits = hits.unionByName(t8)
    free = (q.filter(F.size("codes") == 0).select(qid, F.explode(F.array_distinct(F.filter(
        F.split(F.lower(question), r"[\s,，、]+"), lambda w: F.length(w) >= 2))).alias("term")))
    postings = lexical.build_word_index(e.select("id", hay.alias("hay")), "id", ["hay"])
    word_hits = (lexical.term_passages(free, postings, "id").join(free, "term")
                 .groupBy(qid, "id").agg(F.count("*").cast("int").alias("score")))
    best = hits.unionByName(word_hits).groupBy(qid, "id").agg(F.max("score").alias("score"))
    tops = best.groupBy(qid).agg(F.max("score").alias("__top"), F.max(F.lit(1)).alias("__one"))
    coded = q.select(qid, (F.size("codes") > 0).alias("coded"))
    strong = best.join(tops, qid).join(coded, qid).filter(
        ~F.col("coded") | (F.col("__top") < 8) | (F.col("score") >= 8)).drop("__top", "__one", "coded")
    full = strong.join(e.select("id", "machine", "match_key", "occ_count"), "id")
    group = F.when(F.coalesce("match_key", F.lit("")) != "", F.concat_ws("|", "machine", "match_key")).otherwise(
        F.concat(F.lit("id:"), F.col("id").cast("string")))
    order = F.struct(-F.col("score"), -F.coalesce("occ_count", F.lit(0)), F.col("id"))
    one = (full.withColumn("__g", group).groupBy(qid, "__g")
           .agg(F.min_by(F.struct("id", "score", "occ_count"), order).alias("x")).select(qid, "x.*"))
    return top_k(one, [qid], [F.desc("score"), F.desc("occ_count"), F.col("id")], k)


def attach_references(entries: DataFrame, passages: DataFrame, code_shape: str, kinds: Sequence[str] = ("error_code", "manual"),
                      n: int = 3, seq: str = "seq", kind: str = "doc_type",
                      excerpt_chars: int | None = None) -> DataFrame:
    """First ``n`` passages of the given kinds that mention an entry's first code.

    Other kinds take no place in the ranking.  ``excerpt`` is the whole text, or its first ``excerpt_chars`` characters.
    """
    first = F.nullif(F.regexp_extract(cd.code_key("error_code"), code_shape, 1), F.lit(""))
    asks = entries.select("id", first.alias("code")).filter(F.col("code").isNotNull())
    distinct = asks.select("code").distinct().withColumn("code_id", F.col("code"))
    of_kind = passages.filter(F.col(kind).isin(*kinds))
    best = lexical.search_exact(passages, distinct, "code_id", "code", seq=seq, limit=n, visible=of_kind)
    excerpt = F.substring("text", 1, excerpt_chars) if excerpt_chars else F.col("text")
    return (asks.join(best.withColumnRenamed("code_id", "code"), "code").join(of_kind.select(seq, "text"), seq)
            .select("id", "rank", seq, excerpt.alias("excerpt")))


def entry_stats(entries: DataFrame) -> DataFrame:
    """Two-level report (machine, unit) with subtotals."""
    return entries.rollup("machine", "unit").agg(F.count("*").alias("n_entries"), F.sum("occ_count").alias("occurrences"))


def unprocessed(windows: DataFrame, done: DataFrame, name: str = "doc_name", text: str = "text") -> DataFrame:
    """Windows whose name-and-text hash and content key are both unknown."""
    from fieldmanual.functions.text import content_key

    keyed = windows.withColumn("name_hash", F.md5(F.concat(F.col(name), F.col(text)))).withColumn("content_hash", content_key(text))
    seen = done.select("hash").distinct()
    return (keyed.join(seen.withColumnRenamed("hash", "name_hash"), "name_hash", "left_anti")
            .join(seen.withColumnRenamed("hash", "content_hash"), "content_hash", "left_anti"))


def normalise_oem_items(items: DataFrame, units: Sequence[str], hints: Sequence[tuple[str, str]], name: str = "doc_name",
                        other: str = "other") -> DataFrame:
    """Clean extracted items: unit from enum or name hint, empty items dropped, criteria as last step.

    ``causes`` and ``actions`` are arrays; steps belong to the first cause.
    """
    def clean(c):
        return F.trim(F.regexp_replace(c, r"(?i)<br\s*/?>", " "))

    def clean_list(c):
        return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean), lambda x: x != "")

    unit = F.when(F.col("unit").isin(*units), F.col("unit")).otherwise(F.lit(other))
    hinted = F.when(unit == other, F.coalesce(first_match(name, hints), F.lit(other))).otherwise(unit)
    from fieldmanual.functions.text import clean_codes

    df = (items.withColumn("symptom", clean(F.coalesce("symptom", F.lit("")))).filter("symptom <> ''")
          .withColumn("unit", hinted).withColumn("error_code", cd.norm_code(clean_codes("error_code")))
          .withColumn("causes", clean_list(F.col("causes"))).withColumn("actions", clean_list(F.col("actions")))
          .withColumn("criteria", clean(F.coalesce("criteria", F.lit(""))))
          .filter((F.size("causes") > 0) | (F.size("actions") > 0) | (F.col("criteria") != "")))
    steps = F.concat("actions", F.when(F.col("criteria") != "", F.array(F.concat(F.lit("criteria: "), F.col("criteria"))))
                     .otherwise(F.array().cast("array<string>")))
    causes = F.when(F.size("causes") > 0, F.col("causes")).otherwise(F.array(F.lit("(no cause given)")))
    detail = F.transform(causes, lambda c, i: F.struct(
        (i + 1).alias("rate"), c.alias("cause"),
        F.when(i == 0, steps).otherwise(F.array().cast("array<string>")).alias("steps")))
    return df.withColumn("detail", detail).withColumn("match_key", cd.match_key("error_code"))


LABELS = ("Countermeasure",)
REFERRING = ("refer to", "see", "section", "chapter", "table")


def _any_of(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def mine_definitions(passages: DataFrame, doc: str = "doc_name", seq: str = "seq", text: str = "text",
                     labels: Sequence[str] = LABELS, min_chars: int = 8) -> DataFrame:
    """(doc, number, title, body) of numbered definitions in table rows; the first of a document wins.

    The cell that holds only a label and a number names the definition, the next cell is its title, and the
    next cell with text its body.
    """
    name = rf"(?i)^(?:{_any_of(labels)})\s*(\d+)$"
    lines = passages.select(doc, seq, F.posexplode(F.split(F.replace(F.col(text), F.lit("<br>"), F.lit(" ")), "\n")).alias("line_no", "line"))
    bare = F.transform(F.split("line", r"\|"), lambda c: F.regexp_replace(F.regexp_replace(c, r"^[\s*]+|[\s*]+$", ""), r"\s+", " "))
    rows = lines.filter(F.col("line").contains("|")).withColumn("cells", bare)
    named = rows.select(doc, seq, "line_no", "cells", F.posexplode("cells").alias("i", "cell")).filter(F.col("cell").rlike(name))
    behind = F.filter(F.slice("cells", F.col("i") + 3, F.size("cells")), lambda c: c != "")
    found = named.select(doc, F.regexp_extract("cell", name, 1).alias("number"), F.coalesce(F.get("cells", F.col("i") + 1), F.lit("")).alias("title"),
                         F.get(behind, F.lit(0)).alias("body"), F.struct(seq, "line_no", "i").alias("at"))
    return (found.filter(F.length("body") >= min_chars).groupBy(doc, "number")
            .agg(F.min_by(F.struct("title", "body"), "at").alias("x")).select(doc, "number", "x.*"))


def resolve_references(actions: DataFrame, definitions: DataFrame, doc: str = "doc_name", action: str = "action",
                       labels: Sequence[str] = LABELS, referring: Sequence[str] = REFERRING) -> DataFrame:
    """Replace bare references by title and body; drop those that resolve to nothing; keep other actions.

    An action that is only a reference has nothing but numbers left once labels and referring words are taken out.
    """
    number = F.nullif(F.regexp_extract(F.trim(action), rf"(?i)^(?:{_any_of(labels)})\s*(\d+)$", 1), F.lit(""))
    left_over = F.regexp_replace(action, rf"(?i){_any_of((*labels, *referring))}", "")
    joined = actions.withColumn("number", number).join(definitions, [doc, "number"], "left")
    named = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("（"), F.col("title"), F.lit("）"))).otherwise(F.lit(""))
    resolved = F.concat(F.col(action), named, F.lit("："), F.col("body"))
    return (joined.filter(F.col("body").isNotNull() | ~left_over.rlike(r"^[\s.-]*\d[\s\d.-]*$"))
            .withColumn(action, F.when(F.col("body").isNotNull(), resolved).otherwise(F.col(action)))
            .drop("number", "title", "body"))


def repair_breaks(entries: DataFrame, texts: Sequence[str] = ("title",)) -> DataFrame:
    """Rows with a line-break tag: codes re-split, tags become blanks; missing match keys are filled."""
    from fieldmanual.functions.text import clean_codes

    broken = F.lower(F.concat_ws(" ", "error_code", *texts)).contains("<br")
    out = entries.withColumn("repaired", F.coalesce(broken, F.lit(False)))
    code = F.when(F.col("repaired"), clean_codes("error_code")).otherwise(F.col("error_code"))
    out = out.withColumn("error_code", code)
    for t in texts:
        out = out.withColumn(t, F.when(F.col("repaired"), F.regexp_replace(t, r"(?i)<br\s*/?>", " ")).otherwise(F.col(t)))
    stale = F.col("repaired") | ((F.coalesce("match_key", F.lit("")) == "") & (F.coalesce("error_code", F.lit("")) != ""))
    return out.withColumn("match_key", F.when(stale, cd.match_key("error_code")).otherwise(F.col("match_key")))


def validate_extracted(cases: DataFrame, units: Sequence[str], categories: Sequence[str],
                       statuses: Sequence[str] = ("Open", "Close")) -> DataFrame:
    """Need a description or a code; values outside the enums fall back; texts trimmed."""
    texts = [f.name for f in cases.schema.fields if f.dataType.simpleString() == "string"]
    df = cases.select(*[F.trim(c).alias(c) if c in texts else F.col(c) for c in cases.columns])
    ok = (F.coalesce("description", F.lit("")) != "") | (F.coalesce("error_code", F.lit("")) != "")

    def one_of(c, values, default):
        return F.when(F.col(c).isin(*values), F.col(c)).otherwise(F.lit(default))

    out = (df.filter(ok).withColumn("unit", one_of("unit", units, "other"))
           .withColumn("rc_category", one_of("rc_category", categories, "to check"))
           .withColumn("status", one_of("status", statuses, "Open")))
    return out.withColumnRenamed("date", "reg_date") if "date" in out.columns else out


def is_refurb(source, words: Sequence[str]) -> Column:
    return any_keyword(source, words)
