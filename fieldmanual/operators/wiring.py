"""Wiring graph: edge merging, page variants, tracing, cross references, token repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmanual.functions import codes as cd
from fieldmanual.functions.rules import col
from fieldmanual.operators import ordered as od
from fieldmanual.operators.ordered import stored, top_k


ENDS = ("a_conn", "a_mate", "a_device", "b_conn", "b_mate", "b_device", "cable", "wires")


def merge_edges(edges: DataFrame, ident: str = "edge_id", keep: Sequence[str] = ENDS) -> tuple[DataFrame, DataFrame]:
    """(groups, pages): rows with one cable number and key set are one edge; its pages are a child table.

    The most informative row speaks for the group with the columns to ``keep``, pins are united, rows without keys stay apart.
    """
    keys = F.array_sort(cd.connector_keys("a_conn", "a_mate", "b_conn", "b_mate"))
    cab = F.coalesce(cd.cable_number("cable"), F.lit(""))
    e = edges.withColumn("keys", keys).withColumn("cab", cab).withColumn("pins", cd.parse_pins("wires"))
    bare = F.size("keys") == 0
    sig = F.when(~bare, F.concat_ws("|", F.col("cab"), F.array_join("keys", "|"))).otherwise(
        F.concat(F.lit("#"), F.col(ident).cast("string")))
    e = e.withColumn("sig", sig)

    def has(c):
        return F.coalesce(F.col(c), F.lit("")) != ""

    info = (F.length(F.concat_ws("", F.coalesce("a_device", F.lit("")), F.coalesce("b_device", F.lit("")), F.coalesce("wires", F.lit(""))))
            + F.when(has("a_conn") & has("b_conn"), 20).otherwise(0))
    best = F.max_by(F.struct(*keep), F.struct(info, -F.col(ident)))
    groups = e.groupBy("sig").agg(
        F.min(ident).alias("gid"), F.any_value(F.when(bare, F.col("cab"))).alias("cab"), best.alias("best"), F.count("*").alias("n_rows"))
    # Cable and keys are read off the signature instead of being shuffled beside it.
    alone = F.col("sig").isNull() | F.startswith("sig", F.lit("#"))
    parts = F.split("sig", r"\|")
    groups = groups.withColumns({"cab": F.when(alone, F.col("cab")).otherwise(F.get(parts, F.lit(0))),
                                 "keys": F.when(alone, F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(2), F.size(parts)))})
    # An outer generator, because a plain one parses the pins again to leave out rows without any.
    pins = (e.select("sig", F.explode_outer("pins").alias("pin")).filter("pin is not null").distinct()
            .groupBy("sig").agg(F.array_sort(F.collect_list("pin")).alias("pins")))
    groups = groups.join(pins, "sig", "left")
    pages = e.select("sig", "doc", "page").distinct().join(groups.select("sig", "gid"), "sig").select("gid", "doc", "page")
    return groups.drop("sig").select("gid", "cab", "keys", "best.*", "pins", "n_rows"), pages


def crosspage_cables(groups: DataFrame) -> DataFrame:
    """Cables that touch at most two global keys overall."""
    keys = groups.filter("cab <> ''").select("cab", F.explode_outer(F.filter("keys", cd.is_global_key)).alias("key")).distinct()
    return keys.groupBy("cab").agg(F.count("key").alias("n_keys")).filter(F.col("n_keys") <= 2)


def _one_end_empty() -> tuple[Column, Column]:
    def none(a, b):
        return (F.coalesce(F.col(a), F.lit("")) == "") & (F.coalesce(F.col(b), F.lit("")) == "")

    return none("a_conn", "a_mate"), none("b_conn", "b_mate")


def fill_missing_end(groups: DataFrame, pages: DataFrame, max_pages: int = 3) -> DataFrame:
    """(gid, fill_key, page): the other end of a cable, known from other pages."""
    a_none, b_none = _one_end_empty()
    groups = stored(groups.select("gid", "cab", "keys", "a_conn", "a_mate", "b_conn", "b_mate"))
    pages = stored(pages.select("gid", "page").distinct())
    ok = stored(crosspage_cables(groups).select("cab"))
    own = F.filter("keys", cd.is_global_key)
    open_ = groups.filter((a_none | b_none) & (F.col("cab") != "")).join(ok, "cab", "left_semi").select("gid", "cab", own.alias("own"))
    # A qualifying cable has at most two keys.
    known = (groups.join(ok, "cab", "left_semi").select("cab", "gid", F.explode(own).alias("key")))
    keyset = known.select("cab", "key").distinct().groupBy("cab").agg(F.collect_list("key").alias("all"))
    other = open_.join(keyset, "cab").withColumn("rest", F.array_except("all", "own")).filter(F.size("rest") == 1)
    other = other.select("gid", "cab", F.get("rest", F.lit(0)).alias("key"))
    where = known.join(pages, "gid").select("cab", "key", "page").distinct()
    far = other.join(where, ["cab", "key"]).join(pages, ["gid", "page"], "left_anti")
    return top_k(far.select("gid", F.col("key").alias("fill_key"), "page"), ["gid"], [F.col("page")], max_pages).drop("rank")


def page_variants(pages: DataFrame, doc: str = "doc", page: str = "page", mark: str = "mark", window: int = 80,
                  near: int = 20, general: str = "") -> DataFrame:
    """Variant of each page: its own mark, else agreeing marks around it, else the one mark close by."""
    marked = F.coalesce(F.col(mark), F.lit("")) != ""
    box = F.when(marked, F.struct(F.col(page).alias("p"), F.col(mark).alias("m")))
    df = od.carry(pages, [doc], page, box, "__a", inclusive=False)
    df = od.carry(df, [doc], page, box, "__b", direction="next", inclusive=False)
    a, b = F.col("__a"), F.col("__b")
    agree = a.isNotNull() & b.isNotNull() & (a["m"] == b["m"]) & (b["p"] - a["p"] <= window)
    near_a = F.when(F.col(page) - a["p"] <= near, a["m"])
    near_b = F.when(b["p"] - F.col(page) <= near, b["m"])
    lone = F.when(near_a.isNull() | near_b.isNull() | (near_a == near_b), F.coalesce(near_a, near_b))
    out = F.when(marked, F.col(mark)).when(agree, a["m"]).otherwise(F.coalesce(lone, F.lit(general)))
    return df.withColumn("variant", out).drop("__a", "__b")


def hint_other_end(groups: DataFrame, group_pages: DataFrame, pages: DataFrame, filled: DataFrame | None = None,
                   n: int = 4) -> DataFrame:
    """(gid, page, why): pages where the missing end may be drawn, strongest evidence only."""
    def norm(c):
        return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z0-9]", "")

    a_none, b_none = _one_end_empty()
    groups = stored(groups.select("gid", "cab", "keys", "a_conn", "a_mate", "a_device", "b_conn", "b_mate", "b_device"))
    group_pages = stored(group_pages.select("gid", "doc", "page").distinct())
    open_ = groups.filter(a_none != b_none)
    if filled is not None:
        open_ = open_.join(filled.select("gid").distinct(), "gid", "left_anti")
    open_ = open_.select("gid", "cab", F.when(a_none, norm("a_device")).otherwise(norm("b_device")).alias("dev"))
    own = group_pages
    cables = F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"(\d?[A-Z]\d{3}-\d{3}(?:-\d+)?)"), 1))
    posted = pages.select("doc", "page", norm("text").alias("flat"), F.explode(cables).alias("cab"))
    same_cable = (open_.filter("cab <> ''").join(posted, "cab").join(own, ["gid", "doc", "page"], "left_anti")
                  .withColumn("both", (F.length("dev") >= 4) & F.col("flat").contains(F.col("dev"))))
    per = same_cable.groupBy("gid").agg(F.count("*").alias("n_cab"), F.max("both").alias("any_both"))
    ok = crosspage_cables(groups).select("cab", F.lit(True).alias("ok"))
    e1 = same_cable.filter("both").select("gid", "doc", "page", F.lit(1).alias("level"))
    e2 = (same_cable.join(per, "gid").join(ok, "cab").filter("not any_both and n_cab <= 3")
          .select("gid", "doc", "page", F.lit(2).alias("level")))
    ends = groups.select("gid", F.explode(F.array(
        F.struct((~a_none).alias("used"), norm("a_device").alias("dev")),
        F.struct((~b_none).alias("used"), norm("b_device").alias("dev")))).alias("x")).select("gid", "x.*")
    dev_pages = (ends.filter("used and length(dev) >= 4").join(group_pages, "gid").select("dev", "doc", "page").distinct())
    e3_all = open_.filter("length(dev) >= 4").join(dev_pages, "dev").join(own, ["gid", "doc", "page"], "left_anti")
    few = e3_all.groupBy("gid").agg(F.count("*").alias("n_dev")).filter("n_dev <= 4")
    e3 = e3_all.join(few, "gid").select("gid", "doc", "page", F.lit(3).alias("level"))
    every = e1.unionByName(e2).unionByName(e3)
    best = every.groupBy("gid").agg(F.min("level").alias("level"))
    why = F.element_at(F.array(F.lit("cable and device"), F.lit("cable"), F.lit("device")), F.col("level"))
    return (top_k(every.join(best, ["gid", "level"]), ["gid"], [F.col("page"), F.col("doc")], n)
            .select("gid", "doc", "page", why.alias("why")))


def follow_keys(groups: DataFrame) -> DataFrame:
    """(gid, key, wide): keys a trace may pass; ``wide`` ones (global keys, qualifying cables) cross pages."""
    keys = groups.select("gid", F.explode("keys").alias("key")).withColumn("wide", cd.is_global_key("key"))
    cables = groups.join(crosspage_cables(groups).select("cab"), "cab", "left_semi").select(
        "gid", F.concat(F.lit("C:"), F.col("cab")).alias("key"), F.lit(True).alias("wide"))
    return keys.unionByName(cables)


def trace_roots(groups: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_id, gid): edges that hold a connector of the start text; else its cable; else its device name.

    Null and empty starts have no roots.  Device names are found by one gram of the start and then compared,
    so starts meet only names that hold the gram.
    """
    asked = starts.select("start_id", F.col("start").cast("string").alias("start")).filter("start <> ''")
    keys = asked.select("start_id", F.explode(cd.connector_keys("start")).alias("key")).distinct()
    held = groups.select("gid", F.explode("keys").alias("key"))
    by_key = keys.join(held, "key").select("start_id", "gid", F.lit(0).alias("way"))
    cables = asked.select("start_id", cd.cable_number("start").alias("cab")).filter("cab is not null")
    by_cable = cables.join(groups.select("gid", "cab"), "cab").select("start_id", "gid", F.lit(1).alias("way"))
    devices = (groups.select("gid", F.explode(F.array("a_device", "b_device")).alias("d")).filter("d <> ''")
               .select("gid", F.lower("d").alias("device")))
    low = F.lower("start")
    grams = F.flatten(F.transform(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("device") - n + 1, F.lit(1))), lambda i: F.substr(F.col("device"), i, n))))
    named = devices.select("device").distinct().select("device", F.explode(F.array_distinct(grams)).alias("gram"))
    texts = asked.select("start_id", low.alias("low"), F.substring(low, 1, 3).alias("gram"))
    by_name = (texts.join(named, "gram").filter(F.col("device").contains(F.col("low"))).join(devices, "device")
               .select("start_id", "gid", F.lit(2).alias("way")))
    found = by_key.unionByName(by_cable).unionByName(by_name).distinct()
    first = found.groupBy("start_id").agg(F.min("way").alias("way"))
    return found.join(first, ["start_id", "way"]).select("start_id", "gid")


def trace(groups: DataFrame, pages: DataFrame, start: str, max_hops: int = 3, variants: DataFrame | None = None,
          junction: int = 3) -> DataFrame:
    """:func:`trace_many` of one start text."""
    starts = groups.sparkSession.createDataFrame([(0, start)], "start_id long, start string")
    return trace_many(groups, pages, starts, max_hops, variants, junction).drop("start_id")


def trace_many(groups: DataFrame, pages: DataFrame, starts: DataFrame, max_hops: int = 3,
               variants: DataFrame | None = None, junction: int = 3) -> DataFrame:
    """Breadth-first edges around every start: (start_id, depth, parent, via, gid, pins_unknown, folded).

    ``starts`` (start_id, start); ids are unique and not null.  All starts advance together, in at most
    ``max_hops`` rounds: frontier, used keys and seen edges carry the start.  A start uses each key once.
    Within a level, edges with known pins go first, then lower ids; that order settles which edge claims a
    key or a neighbour.  Folded rows fail the pin test at a junction and are not followed.  The prepared
    edges are written once, each round once more (Parquet), which keeps the plan flat.
    """
    groups = stored(groups.select("gid", "cab", "keys", "a_device", "b_device", "pins"))
    links = stored(follow_keys(groups))
    if variants is None and links.filter(~F.col("wide")).isEmpty():
        pages = pages.limit(0)  # only local keys ask for pages
    pages = stored(pages.select("gid", "doc", "page"))
    base = groups.select("gid", "pins")
    if variants is not None:
        var = (pages.join(variants.select("doc", "page", "variant"), ["doc", "page"], "left").filter("coalesce(variant, '') <> ''")
               .select("gid", "variant").distinct().groupBy("gid").agg(F.collect_list("variant").alias("vars")))
        base = stored(base.join(var, "gid", "left"))
    else:
        base = base.withColumn("vars", F.lit(None).cast("array<string>"))
    # Small columns only; computed once and read by every hop.
    parents = stored(base.groupBy(F.col("gid").alias("parent")).agg(F.max("pins").alias("ppins"), F.max("vars").alias("pvars")))
    index = stored(links.join(base, "gid"))
    local_index = index.filter(~F.col("wide")).join(pages, "gid")
    starts = stored(starts.select("start_id", F.col("start").cast("string").alias("start")))
    done = stored(trace_roots(groups, starts).select(
        "start_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("via"),
        F.col("gid").cast("long").alias("gid"), F.lit(False).alias("pins_unknown"), F.lit(False).alias("folded")))
    cable = F.concat(F.lit("C:"), cd.cable_number("start"))
    used = starts.select("start_id", F.explode(F.array_compact(F.array_append(cd.connector_keys("start"), cable))).alias("key"))
    frontier = done.select("start_id", "gid")
    at = ["start_id", "key"]
    for depth in range(1, max_hops + 1):
        # Edges with known pins first, then lower ids; pins are fetched for the edge that claims a key, not carried to the choice.
        ends = index.select("gid", "key", "wide", F.when(F.col("pins").isNotNull(), F.col("gid")).alias("known"))
        claims = (ends.join(frontier, "gid").join(used, at, "left_anti").groupBy(*at, "wide")
                  .agg(F.coalesce(F.min("known"), F.min("gid")).alias("parent")))
        claims = stored(claims.join(parents, "parent"))
        seen = done.filter("not folded").select("start_id", "gid")
        fits = F.col("vars").isNull() | F.col("pvars").isNull() | F.arrays_overlap("vars", "pvars")
        wide = index.filter("wide").select("gid", "key", "pins", "vars").join(claims.filter("wide").drop("wide"), "key").filter(fits)
        near = claims.filter("not wide").drop("wide").join(pages.withColumnRenamed("gid", "parent"), "parent")
        local = (local_index.select("gid", "key", "pins", "vars", "doc", "page").join(near, ["key", "doc", "page"])
                 .drop("doc", "page").dropDuplicates(["start_id", "gid", "key"]))
        met = compare_pins(wide.unionByName(local))
        cand = met.select(*at, "gid", "parent", "first", "unknown", "clash").join(seen, ["start_id", "gid"], "left_anti")
        judged = filter_junction(cand, junction, at)
        # A neighbour is claimed once; folded rows all stay.
        place = W.partitionBy("start_id", "gid", "folded").orderBy("first", "parent", "key")
        level = stored(judged.withColumn("n", F.row_number().over(place)).filter("folded or n = 1").select(
            "start_id", F.lit(depth).alias("depth"), "parent", F.col("key").alias("via"), "gid",
            (F.col("pins_unknown") & ~F.col("folded")).alias("pins_unknown"), "folded"))
        frontier = level.filter("not folded").select("start_id", "gid")
        done = done.unionByName(level)
        if depth == max_hops or frontier.isEmpty():
            break
        used = used.unionByName(claims.select(*at))
    return done


def compare_pins(met: DataFrame) -> DataFrame:
    """Replace the pins of an edge and of its parent by what the pin test asks: ``unknown``, ``clash``, and ``first`` for the order of parents."""
    here, before = F.col("pins").isNotNull(), F.col("ppins").isNotNull()
    clash = here & before & ~F.coalesce(F.arrays_overlap("pins", "ppins"), F.lit(False))
    return met.withColumns({"unknown": before & ~here, "clash": clash, "first": ~before}).drop("pins", "ppins")


def filter_junction(cand: DataFrame, junction: int = 3, at: Sequence[str] = ("key",)) -> DataFrame:
    """At a key with ``junction`` or more candidates the incoming pins decide: overlap or unknown stays."""
    test = F.count("*").over(W.partitionBy(*at)) >= junction
    return (cand.withColumn("__test", test).withColumn("pins_unknown", F.col("__test") & F.col("unknown"))
            .withColumn("folded", F.col("__test") & F.col("clash")).drop("__test", "unknown", "clash"))


def best_start_page(hits: DataFrame, key: str = "query_id", factor: str = "factor") -> DataFrame:
    """Per question the page with an asked token, then the better family, then more tokens."""
    rank = F.struct(F.col("has_asked").cast("int"), F.col(factor), F.col("n_tokens"), (-F.col("page")).alias("p"))
    return hits.groupBy(key).agg(F.max_by(F.struct("doc", "page"), rank).alias("x")).select(key, "x.*")


def cross_reference(postings: DataFrame, pages: DataFrame, starts: DataFrame, asked: DataFrame | None = None,
                    max_refs: int = 6, key: str = "query_id") -> DataFrame:
    """Pages that share a token with the start page of a question, equal contents collapsed.

    ``postings`` (doc, page, token), ``pages`` (doc, page, text, variant), ``starts`` (key, doc, page).
    Only tokens of the start pages are looked up, so the work is the postings of those tokens.
    """
    sig = F.md5(F.trim(F.regexp_replace("text", r"\s+", " ")))
    info = pages.select("doc", "page", "variant", sig.alias("sig"))
    s = starts.join(info.select("doc", "page", F.col("variant").alias("v0")), ["doc", "page"])
    own = s.join(postings, ["doc", "page"]).select(key, F.col("doc").alias("doc0"), F.col("page").alias("page0"), "v0", "token")
    if asked is not None:
        own = own.join(asked.select(key, "token", F.lit(1).alias("asked")), [key, "token"], "left")
    else:
        own = own.withColumn("asked", F.lit(None).cast("int"))
    met = (postings.join(own, "token").filter((F.col("doc") != F.col("doc0")) | (F.col("page") != F.col("page0")))
           .groupBy(key, "doc0", "page0", "v0", "doc", "page")
           .agg(F.count("*").alias("n_shared"), F.max(F.coalesce("asked", F.lit(0))).alias("asked")))
    full = met.join(info, ["doc", "page"])
    other = ((F.coalesce("v0", F.lit("")) != "") & (F.coalesce("variant", F.lit("")) != "") & (F.col("v0") != F.col("variant")))
    n_other = full.filter(other).groupBy(key).agg(F.count("*").alias("n_other_variant"))
    one = (full.filter(~other).groupBy(key, "doc0", "sig").agg(
        F.min_by(F.struct("doc", "page", "n_shared", "asked"), F.struct("doc", "page")).alias("x"),
        F.count("*").alias("n_copies")).select(key, "doc0", "n_copies", "x.*"))
    best = top_k(one, [key], [F.desc("asked"), (F.col("doc") == F.col("doc0")).cast("int"), F.col("doc"), F.col("page")], max_refs)
    return best.join(n_other, key, "left").fillna(0, ["n_other_variant"]).drop("doc0")


# Digits a reader may see for a letter at the end of a number.
LOOK_ALIKE = {"8": "B", "0": "CDO", "6": "G", "5": "S", "1": "I", "2": "Z", "4": "A"}


def correct_tokens(tokens: DataFrame, known: DataFrame, seen_twice: DataFrame | None = None,
                   context: DataFrame | None = None, look_alike: Mapping[str, str] = LOOK_ALIKE,
                   page: Sequence[str] = ("doc", "page")) -> DataFrame:
    """Add ``fixed`` to (page, token): the one known reading of a number whose last digit may be a letter.

    ``known`` (token) is tried first, then also ``seen_twice``; several readings are told apart by the
    ``context`` (page, token) of the same page; else the token stays.
    """
    pools = known.select("token", F.lit(1).alias("pool"))
    if seen_twice is not None:
        pools = pools.unionByName(seen_twice.select("token", F.lit(2).alias("pool")))
    pools = pools.groupBy(F.col("token").alias("reading")).agg(F.min("pool").alias("pool"))
    table = F.create_map(*[F.lit(x) for kv in look_alike.items() for x in kv])
    last = F.substring("token", -1, 1)
    letters = F.filter(F.split(F.coalesce(F.try_element_at(table, last), F.lit("")), ""), lambda x: x != "")
    stem = F.substr(F.col("token"), F.lit(1), F.length("token") - 1)
    base = tokens.select(*page, "token").distinct().join(known.select("token").distinct(), "token", "left_anti")
    reads = (base.filter((F.length("token") >= 5) & F.col("token").rlike(r"\d$"))
             .select(*page, "token", F.explode(F.transform(letters, lambda x: F.concat(stem, x))).alias("reading"))
             .join(pools, "reading"))
    if context is not None:
        ctx = context.select(*page, F.col("token").alias("reading"), F.lit(1).alias("here")).distinct()
        reads = reads.join(ctx, [*page, "reading"], "left")
    else:
        reads = reads.withColumn("here", F.lit(None).cast("int"))

    def pick(limit):
        rows = reads.filter(F.col("pool") <= limit)
        g = rows.groupBy(*page, "token").agg(
            F.count("*").alias("n"), F.min("reading").alias("only"), F.count("here").alias("n_here"),
            F.min(F.when(F.col("here") == 1, F.col("reading"))).alias("local"))
        return g.select(*page, "token", F.when(F.col("n") == 1, F.col("only")).when(F.col("n_here") == 1, F.col("local")).alias(f"f{limit}"))

    fixed = pick(1).join(pick(2), [*page, "token"], "full_outer").select(*page, "token", F.coalesce("f1", "f2").alias("fixed"))
    return tokens.join(fixed, [*page, "token"], "left")


def process_once(df: DataFrame, fingerprint: str, ident: str, compute) -> DataFrame:
    """Apply ``compute`` to the first row of each fingerprint and share its result with all copies."""
    firsts = df.groupBy(fingerprint).agg(F.min(ident).alias(ident))
    results = compute(df.join(firsts, [fingerprint, ident], "left_semi"))
    keep = [c for c in results.columns if c not in df.columns]
    return df.join(results.select(fingerprint, *keep), fingerprint, "left")


def merge_page_tokens(pages: DataFrame, new: DataFrame, key: Sequence[str] = ("doc", "page")) -> DataFrame:
    """Union of old and new tag tokens, sorted, with the old list of changed rows and the number added."""
    j = pages.join(new.withColumnRenamed("tokens", "__new"), list(key), "left")
    added = F.array_except(F.coalesce("__new", F.array().cast("array<string>")), F.col("tokens"))
    out = j.withColumn("n_added", F.size(added))
    return (out.withColumn("backup", F.when(F.col("n_added") > 0, F.col("tokens")))
            .withColumn("tokens", F.array_sort(F.array_union("tokens", F.coalesce("__new", F.array().cast("array<string>")))))
            .drop("__new"))


def majority_vote(votes: DataFrame, key: Sequence[str], label: str = "label", old: str = "old_label",
                  min_votes: int = 3, share: float = 0.75) -> DataFrame:
    """New label when enough votes agree, else the old one."""
    per = votes.groupBy(*key, label).agg(F.count("*").alias("n"), F.min(old).alias("old"))
    tot = per.groupBy(*key).agg(F.sum("n").alias("votes"), F.max("n").alias("top"), F.min("old").alias("old"),
                                F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("winner"))
    wins = (F.col("votes") >= min_votes) & (F.col("top") >= F.col("votes") * share)
    return tot.select(*key, "votes", "top", F.when(wins, F.col("winner")).otherwise(F.col("old")).alias("label"))


def extraction_plan(targets: DataFrame, done: DataFrame, key: Sequence[str], kind: str = "kind") -> DataFrame:
    """Pages per kind: total, done, left."""
    j = targets.join(done.select(*key, F.lit(1).alias("__d")).distinct(), list(key), "left")
    return j.groupBy(kind).agg(F.count("*").alias("total"), F.count("__d").alias("done")).withColumn(
        "left", F.col("total") - F.col("done"))


def extraction_stats(status: DataFrame, by: Sequence[str] = ("kind", "model", "status")) -> DataFrame:
    return status.groupBy(*by).agg(F.count("*").alias("pages"), F.sum("tokens").alias("tokens"))


def holdout_score(df: DataFrame, ident: str, expected: str = "expected", found: str = "found") -> DataFrame:
    """Hit counts on every other group of identical token sets, in order of first appearance.

    The groups are numbered block by block, so no task orders them all.
    """
    rows = df.withColumn("sig", F.md5(F.array_join(F.array_sort(expected), "|")))
    firsts = rows.groupBy("sig").agg(F.min(ident).cast("long").alias("first"))
    test = od.row_positions(firsts, [], "first", "no").filter(F.col("no") % 2 == 1).select("sig")
    held = rows.join(test, "sig", "left_semi")
    hit = F.sum(F.size(F.array_intersect(expected, found)))
    return held.agg(F.count("*").alias("n_pages"), hit.alias("hits"), F.sum(F.size(expected)).alias("expected"),
                    F.sum(F.size(found)).alias("found"))
