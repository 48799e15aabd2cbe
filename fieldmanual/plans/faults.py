"""Queries over cases, entries, audit and measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmanual.functions import codes as cd
from fieldmanual.functions import text as tx
from fieldmanual.operators import cases as cs
from fieldmanual.operators import reports
from fieldmanual.plans.registry import Tables, query
from fieldmanual.plans.secure import ACL, SCOPES, USERS, acl, scopes, users
from fieldmanual.plans.corpus import NATION_DAYS, nation_days


def s(c):
    return F.col(c).cast("string")


ENTRY = ["machine", "unit", "code"]


def line_cases(t: Tables):
    """Line items as cases: machine by brand, unit by return flag, code by part type, site by customer."""
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return li.select(
        F.col("p_brand").alias("machine"), F.col("l_returnflag").alias("unit"), F.col("p_type").alias("code"),
        F.when(F.col("o_custkey") % 5 == 0, "none").otherwise(F.concat(F.lit("C"), s("o_custkey"))).alias("customer"),
        F.concat(F.lit("S"), s("l_suppkey")).alias("src_doc"), F.when(F.col("l_linenumber") < 7, F.to_date("o_orderdate")).alias("day"),
        F.when(F.col("o_orderstatus") == "F", "Close").otherwise("Open").alias("status"),
        F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("pending").alias("review"),
        F.replace("p_name", F.lit(" "), F.lit("；")).alias("parts"), F.col("p_name").alias("root_cause"), F.col("o_orderpriority").alias("rc_category"),
        F.when(F.col("l_linenumber") % 3 == 0, "refurb").otherwise("field").alias("exp_type"), F.col("p_name").alias("solution"))


CASES = """cs AS (SELECT p_brand AS machine, l_returnflag AS unit, p_type AS code, CASE WHEN o_custkey % 5 = 0 THEN 'none' ELSE 'C' || o_custkey END AS customer, 'S' || l_suppkey AS src_doc,
  CASE WHEN l_linenumber < 7 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderstatus = 'F' THEN 'Close' ELSE 'Open' END AS status, CASE WHEN l_linestatus = 'F' THEN 'confirmed' ELSE 'pending' END AS review,
  p_name AS parts, p_name AS root_cause, o_orderpriority AS rc_category, CASE WHEN l_linenumber % 3 = 0 THEN 'refurb' ELSE 'field' END AS exp_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
OCC = """ds AS (SELECT DISTINCT machine, unit, code, CASE WHEN customer = 'none' THEN src_doc ELSE customer END AS site, day FROM cs WHERE day IS NOT NULL),
lg AS (SELECT *, lag(day) OVER (PARTITION BY machine, unit, code, site ORDER BY day) AS b FROM ds),
oc AS (SELECT machine, unit, code, day AS occ_start FROM lg WHERE b IS NULL OR day - b > 3 UNION ALL SELECT machine, unit, code, NULL FROM cs WHERE day IS NULL)"""


@query("case_keys", r"""
SELECT p_partkey, upper(p_type) AS code_key, CASE WHEN p_partkey % 3 = 0 THEN printf('%02X', p_size) || '-1B' ELSE upper(p_type) END AS match_key,
  lower(replace(replace(p_brand, '#', '#'), ' ', '')) AS norm, p_brand || '|u|' || CASE WHEN p_partkey % 2 = 0 THEN 'code:' || upper(p_type) ELSE 'sym:' || replace(p_name, ' ', '') END AS entry_key,
  CASE WHEN contains(p_name, 'red') THEN 'refurb' ELSE 'field' END AS exp_type FROM part""")
def case_keys(t: Tables):
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("STG-"), F.lpad(F.hex("p_size"), 2, "0"), F.lit("H-1BH"))).otherwise(F.col("p_type"))
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" ; other"))).otherwise("N/A")
    return t.part.select("p_partkey", cd.code_key(F.concat(F.lower("p_type"), F.lit("；x"))).alias("code_key"), cd.match_key(code).alias("match_key"),
                         cd.norm_text(F.concat("p_brand", F.lit(" (-_/). "))).alias("norm"), cd.entry_key("p_brand", F.lit("u"), shown, "p_name").alias("entry_key"),
                         cd.exp_type("p_name", ["RED"]).alias("exp_type"))


@query("upserted_cases", """
SELECT 'S' || l_suppkey AS src_doc, l_returnflag AS dedup_key, min(l_partkey) AS first_part, CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS n_dates
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def upserted_cases(t: Tables):
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(F.concat(F.lit("S"), s("l_suppkey")).alias("src_doc"), F.col("l_returnflag").alias("dedup_key"), F.col("l_partkey").alias("part"),
                     F.col("l_partkey").alias("ord"), F.array(F.to_date("o_orderdate")).alias("dates"), F.col("l_linestatus").alias("ls"))
    out = cs.upsert_cases(rows.filter("ls = 'F'").drop("ls"), rows.filter("ls <> 'F'").drop("ls"), ["part"])
    # The stored row wins; with both halves present the lowest part of the stored half is first.
    firsts = rows.groupBy("src_doc", "dedup_key").agg(F.min("part").alias("first_part"))
    return out.join(firsts, ["src_doc", "dedup_key"]).select("src_doc", "dedup_key", "first_part", F.size("dates").cast("long").alias("n_dates"))


@query("occurrences", f"WITH {CASES}, {OCC} SELECT machine, unit, code, occ_start, count(*) AS n FROM oc GROUP BY ALL")
def occurrences(t: Tables):
    c = line_cases(t).withColumn("site", cs.site_of("customer", "src_doc"))
    return cs.occurrences(c, ENTRY).groupBy(*ENTRY, "occ_start").agg(F.count("*").alias("n"))


@query("entry_rollup", f"""WITH {CASES}, {OCC}, b AS (SELECT machine, unit, code, count(*) AS n_cases, min(day) AS first_date, max(day) AS last_date, count_if(status <> 'Close') AS open_count,
  bool_and(review = 'confirmed') AS all_confirmed, count(DISTINCT CASE WHEN customer <> 'none' THEN customer END) AS n_customers FROM cs GROUP BY ALL),
o AS (SELECT machine, unit, code, count(*) AS occ_count FROM oc GROUP BY ALL), p AS (SELECT machine, unit, code, count(DISTINCT part) AS n_parts FROM (SELECT machine, unit, code, unnest(string_split(parts, ' ')) AS part FROM cs) GROUP BY ALL)
SELECT * FROM b JOIN o USING (machine, unit, code) JOIN p USING (machine, unit, code)""")
def entry_rollup(t: Tables):
    return cs.rollup_entries(line_cases(t).withColumn("site", cs.site_of("customer", "src_doc")), ENTRY)


@query("merged_rollup", f"""WITH {CASES}, b AS (SELECT machine || unit || code AS entry_key, count(*) AS n, count_if(status <> 'Close') AS open_count, min(machine) AS machine FROM cs GROUP BY 1)
SELECT entry_key, open_count, CASE WHEN machine LIKE '%1' THEN 'confirmed' ELSE 'pending' END AS status, CASE WHEN machine LIKE '%1' OR machine LIKE '%2' THEN 1 ELSE 0 END AS has_new FROM b""")
def merged_rollup(t: Tables):
    c = line_cases(t).withColumn("site", cs.site_of("customer", "src_doc")).withColumn("entry_key", F.concat(*ENTRY))
    entries = c.select("entry_key", "machine").distinct().select(
        "entry_key", F.when(F.col("machine").endswith("1"), "confirmed").otherwise("pending").alias("status"),
        F.when(F.col("machine").endswith("2"), 1).otherwise(0).alias("edited"), F.lit(0).alias("has_new"))
    return cs.merge_rollup(entries, cs.rollup_entries(c, ["entry_key"])).select("entry_key", "open_count", "status", "has_new")


@query("experience_mix", f"""WITH {CASES}, n AS (SELECT machine, unit, code, exp_type || ' ' || count(*) AS x FROM cs GROUP BY machine, unit, code, exp_type)
SELECT machine, unit, code, string_agg(x, '·' ORDER BY x) AS exp_mix FROM n GROUP BY ALL""")
def experience_mix(t: Tables):
    return cs.experience_mix(line_cases(t), ENTRY)


@query("ranked_causes", f"""WITH {CASES} SELECT machine, unit, code, root_cause, rc_category, count_if(exp_type = 'field') AS field, count_if(exp_type = 'refurb') AS refurb, count(*) AS "count" FROM cs GROUP BY ALL""")
def ranked_causes(t: Tables):
    return cs.rank_causes(line_cases(t), ENTRY)


@query("ranked_solutions", f"""WITH {CASES}, g AS (SELECT machine, unit, code, root_cause AS solution, count(*) AS n FROM cs WHERE status = 'Close' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY machine, unit, code ORDER BY n DESC, solution) AS k FROM g) SELECT machine, unit, code, solution, n, CAST(k AS BIGINT) AS place FROM r WHERE k <= 3""")
def ranked_solutions(t: Tables):
    c = line_cases(t).withColumn("rc_category", F.lit("x"))
    return cs.rank_solutions(c, ENTRY, top=3).select(*ENTRY, "solution", F.col("count").alias("n"), F.col("rank").cast("long").alias("place"))


def brand_entries(t: Tables):
    """One entry per part: machine by brand, key by size, origin by type."""
    p = F.col("p_partkey")
    code = F.concat(F.lit("STG-"), F.lpad(F.hex("p_size"), 2, "0"), F.lit("-1B"))
    return t.part.select(
        p.alias("id"), F.concat(F.lit("e"), s("p_partkey")).alias("entry_key"), F.col("p_brand").alias("machine"), F.col("p_type").alias("unit"), code.alias("error_code"), F.col("p_name").alias("title"),
        cd.match_key(code).alias("match_key"), F.when(p % 4 == 0, "oem").otherwise("field").alias("origin"), (p % 50).cast("int").alias("occ_count"),
        F.when(p % 3 == 0, "pending").when(p % 3 == 1, "confirmed").otherwise("rejected").alias("status"), (p % 2).cast("int").alias("edited"), F.lit(0).alias("has_new"),
        (p % 100).alias("updated_at"), (p % 30).alias("last_date"))


ENTRIES = """en AS (SELECT p_partkey AS id, p_brand AS machine, p_type AS unit, 'STG-' || printf('%02X', p_size) || '-1B' AS error_code, p_name AS title, printf('%02X', p_size) || '-1B' AS match_key,
  CASE WHEN p_partkey % 4 = 0 THEN 'oem' ELSE 'field' END AS origin, p_partkey % 50 AS occ_count, CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status,
  p_partkey % 2 AS edited, p_partkey % 100 AS updated_at, p_partkey % 30 AS last_date FROM part)"""


@query("remerged_entries", f"""WITH {ENTRIES}, b AS (SELECT machine || match_key AS new_key, min(CAST(1 - edited AS BIGINT) * 1000000000 + id) % 1000000000 AS survivor FROM en GROUP BY 1)
SELECT id, new_key, survivor, id <> survivor AS merged FROM (SELECT id, machine || match_key AS new_key FROM en) JOIN b USING (new_key)""")
def remerged_entries(t: Tables):
    return cs.remerge(brand_entries(t).withColumn("new_key", F.concat("machine", "match_key")))


@query("repointed_cases", """WITH m AS (SELECT p_brand, min(p_partkey) AS s FROM part GROUP BY p_brand) SELECT s AS entry_id, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN m USING (p_brand) GROUP BY s""")
def repointed_cases(t: Tables):
    e = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("new_key"), F.lit(0).alias("edited"))
    return cs.repoint_cases(t.lineitem.select(F.col("l_partkey").alias("entry_id")), cs.remerge(e)).groupBy("entry_id").agg(F.count("*").alias("n"))


@query("upserted_guides", """
SELECT 'oem|' || p_brand || '|' || p_type || '|u||' || 'E' || p_partkey AS entry_key, CASE WHEN p_partkey % 2 = 0 THEN 'new ' ELSE '' END || p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'worn=1,loose=7' ELSE '' END AS causes,
  CASE WHEN p_partkey % 2 = 0 THEN 'look（twice）' ELSE '' END AS solutions FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0""")
def upserted_guides(t: Tables):
    key = cs.oem_key(F.col("p_brand"), F.col("p_type"), F.lit("u"), F.lit(None).cast("string"), F.concat(F.lit("E"), s("p_partkey")), F.col("p_name"))
    old = t.part.filter("p_partkey % 3 <> 0").select(
        key.alias("entry_key"), F.col("p_name").alias("title"), F.array().cast("array<struct<cause:string,count:int>>").alias("root_causes"),
        F.array().cast("array<string>").alias("solutions"), F.lit("confirmed").alias("status"), F.lit(0).alias("edited"))
    step = F.array(F.struct(F.lit("look").alias("check"), F.lit("twice").alias("details")), F.struct(F.lit("").alias("check"), F.lit("").alias("details")))
    causes = F.array(F.struct(F.lit("worn").alias("cause"), F.lit(None).cast("int").alias("rate"), step.alias("steps")),
                     F.struct(F.lit("loose").alias("cause"), F.lit(7).alias("rate"), F.slice(step, 2, 1).alias("steps")))
    new = t.part.filter("p_partkey % 2 = 0").select(key.alias("entry_key"), F.concat(F.lit("new "), "p_name").alias("title"), causes.alias("causes"),
                                                    F.lit("confirmed").alias("status"), F.lit(0).alias("edited"))
    out = cs.upsert_oem(old, new)
    return out.select("entry_key", "title", F.array_join(F.transform("root_causes", lambda x: F.concat_ws("=", x["cause"], x["count"].cast("string"))), ",").alias("causes"),
                      F.array_join("solutions", ",").alias("solutions"))


@query("related_groups", f"""WITH {ENTRIES}, g AS (SELECT machine, match_key, count(DISTINCT origin) AS n_origins, count(*) AS group_size FROM en GROUP BY ALL HAVING count(DISTINCT origin) > 1)
SELECT id, machine, match_key, n_origins, group_size FROM en JOIN g USING (machine, match_key)""")
def related_groups(t: Tables):
    return cs.related_groups(brand_entries(t)).select("id", "machine", "match_key", "n_origins", "group_size")


@query("related_entries", f"""WITH {ENTRIES}, w AS (SELECT * FROM en WHERE (machine, occ_count, id) IN (SELECT (machine, max(occ_count), max(id)) FROM en GROUP BY machine) OR id IN (SELECT max(id) FROM en GROUP BY machine))
SELECT w.id AS wanted_id, e.id FROM w JOIN en e ON e.machine = w.machine AND e.match_key = w.match_key AND e.origin <> w.origin""")
def related_entries(t: Tables):
    e = brand_entries(t)
    return cs.related_entries(e, e.groupBy("machine").agg(F.max("id").alias("id")).select("id"))


@query("alarm_views", f"""WITH {ENTRIES}, c AS (SELECT 'e' || l_partkey AS k, l_partkey AS id, l_returnflag AS cause, count_if(l_linenumber % 3 <> 0) AS field, count_if(l_linenumber % 3 = 0) AS refurb, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT machine, match_key, '0 total' AS section, 'oem:' || count_if(origin = 'oem') AS label, '' AS text, CAST(sum(CASE WHEN origin <> 'oem' THEN occ_count ELSE 0 END) AS BIGINT) AS weight FROM en GROUP BY machine, match_key
UNION ALL SELECT machine, match_key, '1 cause', origin, cause, CAST(sum(n) AS BIGINT) FROM en JOIN c USING (id) GROUP BY machine, match_key, origin, cause
UNION ALL SELECT machine, match_key, '2 action', CASE WHEN origin = 'oem' THEN 'oem' ELSE 'field' END, cause, CAST(sum(field) AS BIGINT) FROM en JOIN c USING (id) WHERE field > 0 GROUP BY ALL
UNION ALL SELECT machine, match_key, '2 action', 'refurb', cause, CAST(sum(refurb) AS BIGINT) FROM en JOIN c USING (id) WHERE refurb > 0 GROUP BY ALL""")
def alarm_views(t: Tables):
    k = F.concat(F.lit("e"), s("l_partkey")).alias("entry_key")
    c = t.lineitem.groupBy(k, F.col("l_returnflag").alias("root_cause")).agg(
        F.count_if(F.col("l_linenumber") % 3 != 0).alias("field"), F.count_if(F.col("l_linenumber") % 3 == 0).alias("refurb"), F.count("*").alias("count"))
    return cs.alarm_view(brand_entries(t), c, c.withColumnRenamed("root_cause", "solution"))


@query("visible_entries", f"""WITH {ENTRIES}, c AS (SELECT l_partkey AS id, max(CASE WHEN o_custkey % 5 IN (0, 1) THEN 1 ELSE 0 END) AS op FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey)
SELECT en.id FROM en LEFT JOIN c USING (id) WHERE status = 'confirmed' AND machine IN ('Brand#1', 'Brand#2', 'Brand#3') AND (origin = 'oem' OR coalesce(op, 1) = 1)""")
def visible_entries(t: Tables):
    who = {"role": "engineer", "clearance": 3, "categories": ["oem_manual", "fault_history"], "models": ["Brand#1", "Brand#2", "Brand#3"], "customers": ["C1"]}
    c = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("entry_id"), F.when(F.col("o_custkey") % 5 == 0, "none").otherwise(F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string"))).alias("customer"))
    return cs.entry_visible(brand_entries(t), c, who).select("id")


@query("found_entries", f"WITH {ENTRIES} SELECT id FROM en WHERE machine = 'Brand#5' AND status = 'confirmed' AND contains(lower(title || ' ' || error_code || ' ' || unit), 'bolt') AND contains(lower(title || ' ' || error_code || ' ' || unit), 'stg')")
def found_entries(t: Tables):
    return cs.search_entries(brand_entries(t), "bolt STG", limit=None, machine="Brand#5", status="confirmed").select("id")


@query("review_queue", f"WITH {ENTRIES} SELECT id, updated_at FROM en WHERE status = 'pending'")
def review_queue(t: Tables):
    return cs.review_queue(brand_entries(t)).select("id", "updated_at")


def chosen(t: Tables):
    ids = t.lineitem.select(F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), s("l_partkey"))).otherwise((F.col("l_partkey") * 2).cast("string")).alias("id"))
    return cs.gate_ids(ids, ids.limit(0), acknowledged=True, use_all=False)


CHOSEN = "ch AS (SELECT DISTINCT l_partkey * 2 AS id FROM lineitem WHERE l_linenumber <> 7 AND l_partkey > 0)"


@query("confirmed_outcome", f"""WITH {ENTRIES}, {CHOSEN} SELECT ch.id, CASE WHEN status IS NULL THEN 'missing' WHEN status = 'pending' THEN 'confirmed' ELSE 'skipped' END AS outcome FROM ch LEFT JOIN en USING (id)""")
def confirmed_outcome(t: Tables):
    return cs.confirm_entries(brand_entries(t), chosen(t))[1]


@query("confirmed_entries", f"""WITH {ENTRIES}, {CHOSEN} SELECT CASE WHEN status = 'pending' AND ch.id IS NOT NULL THEN 'confirmed' ELSE status END AS status, CASE WHEN status = 'pending' AND ch.id IS NOT NULL THEN 1 ELSE edited END AS edited, count(*) AS n
FROM en LEFT JOIN ch USING (id) GROUP BY ALL""")
def confirmed_entries(t: Tables):
    return cs.confirm_entries(brand_entries(t), chosen(t))[0].groupBy("status", "edited").agg(F.count("*").alias("n"))


# Codes of the alarms and parts below.
CODES = r"(STG-[0-9A-F]{2}-1B|[0-9]{4})"


@query("matched_entries", f"""WITH {ENTRIES}, q AS (SELECT n_nationkey AS query_id, 'STG-' || printf('%02X', n_nationkey * 2 + 1) || '-1B' AS code, printf('%02X', n_nationkey * 2 + 1) AS main FROM nation),
h AS (SELECT query_id, en.*, CASE WHEN match_key = main || '-1B' THEN 12 ELSE 3 END AS score FROM q JOIN en ON substr(match_key, 1, 2) = main),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, machine, match_key ORDER BY score DESC, occ_count DESC, id) AS g FROM h)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, occ_count DESC, id) AS BIGINT) AS place FROM o WHERE g = 1 QUALIFY place <= 4""")
def matched_entries(t: Tables):
    q = t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("alarm STG-"), F.lpad(F.hex(F.col("n_nationkey") * 2 + 1), 2, "0"), F.lit("-1B again")).alias("question"))
    return cs.match_entries(q, brand_entries(t), CODES).select("query_id", "id", "score", F.col("rank").cast("long").alias("place"))


@query("matched_keywords", f"""WITH {ENTRIES}, q AS (SELECT r_regionkey AS query_id, ['red', 'bolt', 'ring', 'blue', 'small'][r_regionkey + 1] AS w FROM region),
h AS (SELECT query_id, en.*, CAST(contains(lower(title || ' ' || error_code || ' ' || unit), w) AS INTEGER) + CAST(contains(lower(title || ' ' || error_code || ' ' || unit), 'widget') AS INTEGER) AS score FROM q, en),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, machine, match_key ORDER BY score DESC, occ_count DESC, id) AS g FROM h WHERE score > 0)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, occ_count DESC, id) AS BIGINT) AS place FROM o WHERE g = 1 QUALIFY place <= 4""")
def matched_keywords(t: Tables):
    word = F.element_at(F.array(*[F.lit(w) for w in ("red", "bolt", "ring", "blue", "small")]), F.col("r_regionkey") + 1)
    q = t.region.select(F.col("r_regionkey").alias("query_id"), F.concat(word, F.lit(", Widget")).alias("question"))
    return cs.match_entries(q, brand_entries(t), CODES).select("query_id", "id", "score", F.col("rank").cast("long").alias("place"))


@query("entry_stats", f"WITH {ENTRIES} SELECT machine, unit, count(*) AS n_entries, CAST(sum(occ_count) AS BIGINT) AS occurrences FROM en GROUP BY ROLLUP (machine, unit)")
def entry_stats(t: Tables):
    return cs.entry_stats(brand_entries(t))


@query("unprocessed_windows", r"""WITH d AS (SELECT doc_id, source, text, md5(source || text) AS nh, md5(regexp_replace(text, '[\s*#_|>`\-]+', '', 'g')) AS ch FROM documents),
done AS (SELECT nh AS h FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) UNION SELECT ch FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT doc_id FROM d WHERE nh NOT IN (SELECT h FROM done) AND ch NOT IN (SELECT h FROM done)""")
def unprocessed_windows(t: Tables):
    d = t.documents.select("doc_id", F.col("source").alias("doc_name"), "text")
    lab = d.join(t.labels, "doc_id")
    done = lab.filter("quality = 0").select(F.md5(F.concat("doc_name", "text")).alias("hash")).unionByName(
        lab.filter("toxic = 1").select(tx.content_key("text").alias("hash")))
    return cs.unprocessed(d, done).select("doc_id")


@query("guide_items", """SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_type WHEN contains(p_brand, '1') THEN 'Laser' ELSE 'other' END AS unit, 'E' || (p_partkey + 1000) AS error_code,
  CASE WHEN p_partkey % 3 = 0 THEN '(no cause given)' ELSE p_name END AS first_cause, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n_steps FROM part""")
def guide_items(t: Tables):
    empty = F.array().cast("array<string>")
    items = t.part.select(
        "p_partkey", F.col("p_brand").alias("doc_name"), F.col("p_name").alias("symptom"), F.col("p_type").alias("unit"),
        F.concat(F.lit("E"), (F.col("p_partkey") + 1000).cast("string"), F.lit("<br>ab")).alias("error_code"),
        F.when(F.col("p_partkey") % 3 == 0, empty).otherwise(F.array("p_name", F.lit(" "))).alias("causes"), F.array(F.lit("look<br>")).alias("actions"),
        F.when(F.col("p_partkey") % 2 == 0, "below 3").alias("criteria"))
    out = cs.normalise_oem_items(items, ["SMALL", "LARGE"], [("Laser", "1")])
    return out.select("p_partkey", "unit", "error_code", F.element_at("detail", 1)["cause"].alias("first_cause"), F.size(F.element_at("detail", 1)["steps"]).alias("n_steps"))


@query("resolved_references", """SELECT p_partkey, CASE WHEN p_size = 7 THEN 'Countermeasure 7（' || p_brand || '）：' || 'replace the worn seal' ELSE p_name END AS action FROM part WHERE p_size = 7 OR p_size % 10 <> 7""")
def resolved_references(t: Tables):
    text = F.concat(F.lit("|Countermeasure 7|"), "p_brand", F.lit("| replace the  worn seal |"))
    defs = cs.mine_definitions(t.part.select(F.col("p_brand").alias("doc_name"), F.col("p_partkey").alias("seq"), text.alias("text")))
    size = F.col("p_size")
    acts = t.part.select("p_partkey", F.col("p_brand").alias("doc_name"), F.when(size % 10 == 7, F.concat(F.lit("Countermeasure "), s("p_size"))).otherwise(F.col("p_name")).alias("action"))
    return cs.resolve_references(acts, defs).select("p_partkey", "action")


@query("repaired_breaks", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'AB12 CD34' ELSE 'STG-4A-1B' END AS error_code, CASE WHEN p_partkey % 2 = 0 THEN 'AB12CD34' ELSE '4A-1B' END AS match_key, p_partkey % 2 = 0 AS repaired FROM part""")
def repaired_breaks(t: Tables):
    even = F.col("p_partkey") % 2 == 0
    e = t.part.select(F.col("p_partkey").alias("id"), F.when(even, "AB12<br>xx<BR/>CD34").otherwise("STG-4A-1B").alias("error_code"), F.col("p_name").alias("title"),
                      F.lit("").alias("match_key"))
    return cs.repair_breaks(e).select("id", "error_code", "match_key", "repaired")


@query("validated_cases", """SELECT p_partkey, p_name AS description, CASE WHEN p_type = 'SMALL' THEN 'SMALL' ELSE 'other' END AS unit, 'to check' AS rc_category, CASE WHEN p_size % 2 = 0 THEN 'Close' ELSE 'Open' END AS status FROM part WHERE p_size <> 3""")
def validated_cases(t: Tables):
    c = t.part.select("p_partkey", F.when(F.col("p_size") == 3, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("description"), F.lit("").alias("error_code"),
                      F.col("p_type").alias("unit"), F.lit("?").alias("rc_category"), F.when(F.col("p_size") % 2 == 0, "Close").otherwise("?").alias("status"), F.lit("x").alias("date"))
    return cs.validate_extracted(c, ["SMALL"], ["wear"]).select("p_partkey", "description", "unit", "rc_category", "status")


@query("attached_references", """WITH d AS (SELECT DISTINCT 'E' AS x FROM part), n AS (SELECT p_partkey AS id, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS code FROM part),
h AS (SELECT n.id, o.o_orderkey AS seq, row_number() OVER (PARTITION BY n.id ORDER BY o.o_orderkey) AS r FROM n JOIN orders o ON lpad(CAST(o.o_custkey % 10000 AS VARCHAR), 4, '0') = n.code)
SELECT id, seq FROM h WHERE r <= 3""")
def attached_references(t: Tables):
    code = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    e = t.part.select(F.col("p_partkey").alias("id"), code.alias("error_code"))
    text = F.concat(F.lit("code "), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
    p = t.orders.select(F.col("o_orderkey").alias("seq"), text.alias("text"), F.lit("manual").alias("doc_type"))
    return cs.attach_references(e, p, CODES).select("id", "seq")


# Audit, inventory, measurement ---------------------------------------------------------------------


def access_log(t: Tables):
    u = F.col("user_id")
    ip = (F.when(u % 5 == 0, F.lit(None)).when(u % 5 == 1, F.concat(F.lit("10.0.0."), (u % 250).cast("string"))).when(u % 5 == 2, F.concat(F.lit("100.64.1."), (u % 250).cast("string")))
          .otherwise(F.concat(F.lit("203.0.113."), (u % 250).cast("string"))))
    ua = F.when(u % 3 == 0, "Mozilla iPhone").when(u % 3 == 1, "").otherwise("Mozilla X11")
    return t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), u.alias("uid"), F.col("event_type").alias("action"), ip.alias("ip"), ua.alias("ua"),
                           (F.col("event_type") != "error").alias("ok"))


@query("recent_events", "SELECT event_id AS id, user_id AS uid FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_events(t: Tables):
    return reports.recent_events(access_log(t)).select("id", "uid")


@query("event_locations", """SELECT CASE user_id % 5 WHEN 0 THEN '—' WHEN 1 THEN 'internal' WHEN 2 THEN 'internal' ELSE CASE WHEN user_id % 250 < 100 THEN 'city' || (user_id % 250) || ' isp' ELSE '' END END AS location, count(*) AS n FROM events GROUP BY 1""")
def event_locations(t: Tables):
    u = F.col("c_custkey")
    geo = t.customer.filter((u % 5 >= 3) & (u % 250 < 100)).select(F.concat(F.lit("203.0.113."), (u % 250).cast("string")).alias("ip"), F.concat(F.lit("city"), (u % 250).cast("string")).alias("geo"),
                                                                   F.lit("isp").alias("isp")).distinct()
    return reports.enrich_geo(access_log(t), geo).groupBy("location").agg(F.count("*").alias("n"))


@query("device_classes", "SELECT CASE user_id % 3 WHEN 0 THEN 'phone' WHEN 1 THEN '—' ELSE 'desktop' END AS device, user_id % 5 IN (1, 2) AS internal, count(*) AS n FROM events GROUP BY ALL")
def device_classes(t: Tables):
    return access_log(t).groupBy(tx.device_class("ua").alias("device"), tx.ip_is_internal("ip").alias("internal")).agg(F.count("*").alias("n"))


@query("permission_overview", f"WITH {USERS}, {SCOPES} SELECT us.uid, role, status, coalesce(string_agg(DISTINCT scope, ', ' ORDER BY scope), '—') AS scopes FROM us LEFT JOIN sc ON sc.uid = us.uid AND valid_until > TIMESTAMP '1998-01-01' GROUP BY ALL")
def permission_overview(t: Tables):
    return reports.permission_overview(users(t), scopes(t), F.lit("1998-01-01").cast("timestamp_ntz"))


@query("document_inventory", "SELECT source AS doc_name, count(*) AS chunks, arg_min(lang, doc_id) AS doc_type FROM documents GROUP BY source")
def document_inventory(t: Tables):
    return reports.document_inventory(t.documents.select(F.col("source").alias("doc_name"), F.col("lang").alias("doc_type"), "doc_id"), "doc_id")


@query("pinned_inventory", "SELECT source AS doc_name, count(*) AS chunks, max(quality) IS NOT NULL AS pinned FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id AND toxic = 1 GROUP BY source")
def pinned_inventory(t: Tables):
    d = t.documents.select("doc_id", F.col("source").alias("doc_name"), F.col("lang").alias("doc_type"))
    recent = d.join(t.labels.filter("toxic = 1"), "doc_id").select("doc_name", F.col("doc_id").alias("finished_at"))
    return reports.pin_recent(reports.document_inventory(d, "doc_id"), recent).select("doc_name", "chunks", "pinned")


@query("acl_distribution", f"WITH {ACL} SELECT 'internal' AS owner_scope, sec_level, review_status, count(*) AS n FROM acl GROUP BY ALL")
def acl_distribution(t: Tables):
    return reports.acl_distribution(acl(t))


@query("category_distribution", f"WITH {ACL} SELECT category, customer, model AS models, count(*) AS n FROM acl GROUP BY ALL")
def category_distribution(t: Tables):
    return reports.entry_distribution(acl(t))


@query("log_days", f"""WITH {NATION_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY day DESC) AS n, min(day) OVER (PARTITION BY log_id) AS available_from, max(day) OVER (PARTITION BY log_id) AS available_to FROM days)
SELECT log_id, day, available_from, available_to FROM r WHERE n <= 7""")
def log_days(t: Tables):
    return reports.query_logs(nation_days(t)).select("log_id", "day", "available_from", "available_to")


@query("log_range", f"WITH {NATION_DAYS} SELECT log_id, count(*) AS n FROM days WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY log_id")
def log_range(t: Tables):
    out = reports.query_logs(nation_days(t), date_from=F.lit("1998-01-01").cast("date"), date_to=F.lit("1998-12-31").cast("date"))
    return out.groupBy("log_id").agg(F.count("*").alias("n"))


@query("residual_stats", """WITH d AS (SELECT l_returnflag, l_linenumber, l_extendedprice / 1000 AS raw, (l_extendedprice - l_quantity * 1500) / 1000 AS res FROM lineitem)
SELECT l_returnflag, l_linenumber, round(avg(raw), 4) AS mean_raw, round(3 * stddev_pop(raw), 4) AS sigma3_raw, round(3 * stddev_pop(res), 4) AS sigma3_res, round(1 - sum(res * res) / (var_pop(raw) * count(raw)), 4) AS r2 FROM d GROUP BY ALL""")
def residual_stats(t: Tables):
    d = t.lineitem.select("l_returnflag", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("raw"), ((F.col("l_extendedprice") - F.col("l_quantity") * 1500) / 1000).alias("residual"))
    out = reports.residual_stats(d, ["l_returnflag", "l_linenumber"])
    return out.select("l_returnflag", "l_linenumber", *[F.round(c, 4).alias(c) for c in ("mean_raw", "sigma3_raw", "sigma3_res", "r2")])


@query("arrow_scale", """WITH d AS (SELECT l_returnflag, sqrt(l_discount * l_discount + l_tax * l_tax) AS m, l_quantity FROM lineitem), g AS (SELECT l_returnflag, quantile_cont(m, 0.75) FILTER (m > 0) AS p75, min(l_quantity) AS pitch FROM d GROUP BY ALL)
SELECT l_returnflag, round(p75, 6) AS p75, round(greatest(0.3 * pitch / 1000 / p75, 0.001), 6) AS scale FROM g""")
def arrow_scale(t: Tables):
    out = reports.auto_scale(t.lineitem, "l_discount", "l_tax", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", F.round("p75", 6).alias("p75"), F.round("scale", 6).alias("scale"))


@query("measurement_listing", """SELECT 'm' || l_suppkey AS file, max(l_returnflag) AS type, CAST(max(l_shipdate) AS DATE) AS day, max(l_linestatus) AS machine, count_if(l_linenumber <> 7 OR l_quantity < 49) AS n_rows,
  count_if(l_linenumber = 7 AND l_quantity >= 49) > 0 AS unreadable FROM lineitem GROUP BY l_suppkey""")
def measurement_listing(t: Tables):
    bad = (F.col("l_linenumber") == 7) & (F.col("l_quantity") >= 49)
    rows = t.lineitem.select(F.concat(F.lit("m"), s("l_suppkey")).alias("file"), F.col("l_returnflag").alias("type"), F.to_date("l_shipdate").alias("day"), F.col("l_linestatus").alias("machine"),
                             F.when(bad, "broken").alias("_corrupt_record"))
    return reports.measurement_listing(rows)
