"""Queries over wiring edges, procedures and the glossary."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmanual.functions import codes as cd
from fieldmanual.operators import glossary as gl
from fieldmanual.operators import procedures as pr
from fieldmanual.operators import wiring as wi
from fieldmanual.operators.procedure_store import ProcedureStore
from fieldmanual.plans.registry import Tables, query, spread


def s(c):
    return F.col(c).cast("string")


def edges(t: Tables):
    """Part-supplier pairs per ship month as wiring rows; every tenth supplier end is not drawn."""
    m = F.month("l_shipdate")
    g = t.lineitem.groupBy("l_partkey", "l_suppkey", m.alias("page")).agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.max("l_returnflag").alias("rf"))
    open_end = (F.col("l_partkey") + F.col("page")) % 10 == 0
    return g.select(
        (F.col("l_partkey") * 10000000 + F.col("l_suppkey") * 100 + F.col("page")).alias("edge_id"), F.lit("book").alias("doc"), F.col("page").cast("long").alias("page"),
        F.format_string("4S%03d-%03d", F.col("l_suppkey") % 1000, F.col("l_partkey") % 1000).alias("cable"),
        F.concat(F.lit("J"), (F.col("l_partkey") + 10000).cast("string")).alias("a_conn"), F.lit(None).cast("string").alias("a_mate"), F.col("rf").alias("a_device"),
        F.when(~open_end, F.concat(F.lit("P"), (F.col("l_suppkey") + 50000).cast("string"))).alias("b_conn"), F.lit(None).cast("string").alias("b_mate"),
        F.lit("supply").alias("b_device"), F.concat(s("lo"), F.lit("~"), s("hi")).alias("wires"))


EDGES = """eg AS (SELECT l_partkey * 10000000 + l_suppkey * 100 + month(l_shipdate) AS edge_id, month(l_shipdate) AS page, printf('4S%03d-%03d', l_suppkey % 1000, l_partkey % 1000) AS cab,
  'J/P' || (l_partkey + 10000) AS ka, CASE WHEN (l_partkey + month(l_shipdate)) % 10 <> 0 THEN 'J/P' || (l_suppkey + 50000) END AS kb, min(l_linenumber) AS lo, max(l_linenumber) AS hi, max(l_returnflag) AS rf
  FROM lineitem GROUP BY l_partkey, l_suppkey, month(l_shipdate)),
gr AS (SELECT min(edge_id) AS gid, cab, ka, kb, count(*) AS n_rows, max(hi) AS top, count(DISTINCT page) AS n_pages FROM eg GROUP BY cab, ka, kb),
gk AS (SELECT gid, cab, ka AS key FROM gr UNION ALL SELECT gid, cab, kb FROM gr WHERE kb IS NOT NULL),
ck AS (SELECT cab, count(DISTINCT key) AS n_keys FROM gk GROUP BY cab HAVING count(DISTINCT key) <= 2)"""


@query("connector_keys", """SELECT p_partkey, 'J/P' || (p_partkey + 1000) || ',CN' || p_size AS keys FROM part""")
def connector_keys(t: Tables):
    n = (F.col("p_partkey") + 1000).cast("string")
    return t.part.select("p_partkey", F.array_join(cd.connector_keys(F.concat(F.lit("J "), n), F.concat(F.lit("cn"), s("p_size")), F.concat(F.lit("P"), n)), ",").alias("keys"))


@query("wire_pins", """SELECT o_orderkey, CAST(3 * (o_custkey % 4 + 1) + 2 + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS BIGINT) AS n_pins FROM orders""")
def wire_pins(t: Tables):
    w = F.concat(F.lit("A1~C"), (F.col("o_custkey") % 4 + 1).cast("string"), F.lit(", 777 (note 5~9), "), "o_orderstatus", F.lit(" P"))
    return t.orders.select("o_orderkey", F.size(cd.parse_pins(w)).cast("long").alias("n_pins"))


@query("merged_edges", f"""WITH {EDGES} SELECT gid, cab, concat_ws(',', ka, kb) AS keys, n_rows FROM gr""")
def merged_edges(t: Tables):
    return wi.merge_edges(edges(t))[0].select("gid", "cab", F.array_join("keys", ",").alias("keys"), "n_rows")


@query("edge_pins", f"""WITH {EDGES}, p AS (SELECT cab, ka, kb, unnest(range(lo, hi + 1)) AS pin FROM eg) SELECT gid, count(DISTINCT pin) AS n_pins FROM gr JOIN p ON p.cab = gr.cab AND p.ka = gr.ka AND p.kb IS NOT DISTINCT FROM gr.kb GROUP BY gid""")
def edge_pins(t: Tables):
    return wi.merge_edges(edges(t))[0].select("gid", F.size("pins").cast("long").alias("n_pins"))


@query("crosspage_cables", f"WITH {EDGES} SELECT cab, n_keys FROM ck")
def crosspage_cables(t: Tables):
    return wi.crosspage_cables(wi.merge_edges(edges(t))[0])


# What the operators read of an edge: the ends that are drawn, the names of its devices.
DRAWN, DEVICES = ("a_conn", "a_mate", "b_conn", "b_mate"), ("a_device", "b_device")


@query("filled_ends", f"""WITH {EDGES}, o AS (SELECT gid, cab, ka FROM gr JOIN ck USING (cab) WHERE kb IS NULL), k AS (SELECT o.gid, o.cab, min(key) AS key FROM o JOIN gk USING (cab) WHERE key <> ka GROUP BY ALL HAVING count(DISTINCT key) = 1),
pg AS (SELECT gr.gid, e.page FROM gr JOIN eg e ON e.cab = gr.cab AND e.ka = gr.ka AND e.kb IS NOT DISTINCT FROM gr.kb),
w AS (SELECT DISTINCT k.gid, k.key AS fill_key, pg.page FROM k JOIN gk ON gk.cab = k.cab AND gk.key = k.key JOIN pg ON pg.gid = gk.gid WHERE NOT EXISTS (SELECT 1 FROM pg m WHERE m.gid = k.gid AND m.page = pg.page))
SELECT gid, fill_key, page FROM w QUALIFY row_number() OVER (PARTITION BY gid ORDER BY page) <= 3""")
def filled_ends(t: Tables):
    groups, pages = wi.merge_edges(edges(t), keep=DRAWN)
    return wi.fill_missing_end(groups, pages)


@query("hinted_ends", f"""WITH {EDGES}, pg AS (SELECT DISTINCT gr.gid, e.page FROM gr JOIN eg e ON e.cab = gr.cab AND e.ka = gr.ka AND e.kb IS NOT DISTINCT FROM gr.kb),
o AS (SELECT gid, cab FROM gr WHERE kb IS NULL), tx AS (SELECT DISTINCT cab, page + 1 AS page FROM eg),
c AS (SELECT o.gid, tx.page FROM o JOIN tx USING (cab) WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.gid = o.gid AND pg.page = tx.page))
SELECT gid, page, 'cable and device' AS why FROM c QUALIFY row_number() OVER (PARTITION BY gid ORDER BY page) <= 4""")
def hinted_ends(t: Tables):
    groups, pages = wi.merge_edges(edges(t), keep=[*DRAWN, *DEVICES])
    texts = edges(t).select("doc", (F.col("page") + 1).alias("page"), F.concat(F.lit("supply "), "cable").alias("text")).distinct()
    return wi.hint_other_end(groups, pages, texts).select("gid", "page", "why")


TRACE_START = "J10001"


@query("connection_trace", f"""WITH {EDGES}, l0 AS (SELECT DISTINCT gid FROM gk WHERE key = 'J/P10001'),
links AS (SELECT gid, key FROM gk UNION ALL SELECT gid, 'C:' || cab FROM gr JOIN ck USING (cab)), u0 AS (SELECT 'J/P10001' AS key),
c1 AS (SELECT DISTINCT key FROM links JOIN l0 USING (gid) WHERE key NOT IN (SELECT key FROM u0)), l1 AS (SELECT DISTINCT gid FROM links JOIN c1 USING (key) WHERE gid NOT IN (SELECT gid FROM l0)),
u1 AS (SELECT key FROM u0 UNION SELECT key FROM c1), c2 AS (SELECT DISTINCT key FROM links JOIN l1 USING (gid) WHERE key NOT IN (SELECT key FROM u1)),
l2 AS (SELECT DISTINCT gid FROM links JOIN c2 USING (key) WHERE gid NOT IN (SELECT gid FROM l0 UNION SELECT gid FROM l1)),
u2 AS (SELECT key FROM u1 UNION SELECT key FROM c2), c3 AS (SELECT DISTINCT key FROM links JOIN l2 USING (gid) WHERE key NOT IN (SELECT key FROM u2)),
l3 AS (SELECT DISTINCT gid FROM links JOIN c3 USING (key) WHERE gid NOT IN (SELECT gid FROM l0 UNION SELECT gid FROM l1 UNION SELECT gid FROM l2))
SELECT 0 AS depth, gid FROM l0 UNION ALL SELECT 1, gid FROM l1 UNION ALL SELECT 2, gid FROM l2 UNION ALL SELECT 3, gid FROM l3""")
def connection_trace(t: Tables):
    groups, pages = wi.merge_edges(edges(t).withColumn("wires", F.lit(None).cast("string")), keep=DEVICES)
    return wi.trace(groups, pages, TRACE_START, 3).select("depth", "gid")


def bay_edges(t: Tables):
    """The wiring rows with one supplier connector per bay, a bay for each remainder of the part number by 26."""
    bay = F.char(65 + F.floor(F.col("edge_id") / 10000000) % 26)
    return edges(t).withColumn("b_conn", F.concat("b_conn", bay))


BAY_EDGES = EDGES.replace("(l_suppkey + 50000)", "(l_suppkey + 50000) || chr(CAST(65 + l_partkey % 26 AS INTEGER))")


def trace_sql(starts: str, hops: int, rows: str = EDGES) -> str:
    """Levels of a trace with pins for starts ``u0 (start_id, key)`` over edges whose keys all cross pages."""
    ctes = [rows, f"u0 AS ({starts})",
            "pn AS (SELECT gr.gid, list_distinct(flatten(list(range(lo, hi + 1)))) AS pins FROM gr JOIN eg ON eg.cab = gr.cab AND eg.ka = gr.ka AND eg.kb IS NOT DISTINCT FROM gr.kb GROUP BY gr.gid)",
            "links AS (SELECT gid, key FROM gk UNION ALL SELECT gid, 'C:' || cab FROM gr JOIN ck USING (cab))",
            "l0 AS (SELECT DISTINCT start_id, gid, NULL::BIGINT AS parent, NULL::VARCHAR AS via FROM gk JOIN u0 USING (key))",
            "s0 AS (SELECT start_id, gid FROM l0)"]
    for i in range(1, hops + 1):
        p = i - 1
        ctes += [f"c{i} AS (SELECT start_id, key, min(gid) AS parent FROM l{p} JOIN links USING (gid) ANTI JOIN u{p} USING (start_id, key) GROUP BY ALL)",
                 f"m{i} AS (SELECT start_id, key, parent, links.gid FROM c{i} JOIN links USING (key) ANTI JOIN s{p} USING (start_id, gid))",
                 f"j{i} AS (SELECT m.*, count(*) OVER (PARTITION BY start_id, key) >= 3 AND NOT list_has_any(a.pins, b.pins) AS folded FROM m{i} m JOIN pn a ON a.gid = m.parent JOIN pn b ON b.gid = m.gid)",
                 f"l{i} AS (SELECT start_id, gid, parent, key AS via FROM j{i} WHERE NOT folded QUALIFY row_number() OVER (PARTITION BY start_id, gid ORDER BY parent, key) = 1)",
                 f"u{i} AS (SELECT start_id, key FROM u{p} UNION SELECT start_id, key FROM c{i})",
                 f"s{i} AS (SELECT start_id, gid FROM s{p} UNION ALL SELECT start_id, gid FROM l{i})"]
    cols = "start_id, {0} AS depth, parent, {1} AS via, gid, false AS pins_unknown, {2} AS folded"
    levels = [f"SELECT {cols.format(i, 'via', 'false')} FROM l{i}" for i in range(hops + 1)]
    levels += [f"SELECT {cols.format(i, 'key', 'true')} FROM j{i} WHERE folded" for i in range(1, hops + 1)]
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(levels)}"


@query("connection_traces", trace_sql("SELECT p_partkey AS start_id, 'J/P' || (p_partkey + 10000) AS key FROM part WHERE p_partkey % 20 = 0", 2, BAY_EDGES))
def connection_traces(t: Tables):
    """Traces of two hops for every part whose number is divisible by 20, against all edges."""
    groups, pages = wi.merge_edges(bay_edges(t), keep=DEVICES)
    starts = t.part.filter("p_partkey % 20 = 0").select(
        F.col("p_partkey").alias("start_id"), F.concat(F.lit("J"), (F.col("p_partkey") + 10000).cast("string")).alias("start"))
    return wi.trace_many(groups, pages, starts, 2)


@query("junction_trace", f"SELECT * EXCLUDE (start_id) FROM ({trace_sql("SELECT 0 AS start_id, 'J/P10001' AS key", 3)})")
def junction_trace(t: Tables):
    """The same trace with pins, where junctions fold branches whose pins do not meet."""
    groups, pages = wi.merge_edges(edges(t), keep=DEVICES)
    return wi.trace(groups, pages, TRACE_START, 3)


def marked_pages(t: Tables):
    k = F.col("p_partkey")
    mark = F.when(k % 37 == 0, "A").when(k % 53 == 0, "B").otherwise("")
    return t.part.select(F.col("p_brand").alias("doc"), k.alias("page"), mark.alias("mark"))


@query("page_variants", """
WITH p AS (SELECT p_brand AS doc, p_partkey AS page, CASE WHEN p_partkey % 37 = 0 THEN 'A' WHEN p_partkey % 53 = 0 THEN 'B' END AS m FROM part),
w AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN page END IGNORE NULLS) OVER a AS pa, last_value(m IGNORE NULLS) OVER a AS ma,
  first_value(CASE WHEN m IS NOT NULL THEN page END IGNORE NULLS) OVER b AS pb, first_value(m IGNORE NULLS) OVER b AS mb FROM p
  WINDOW a AS (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY doc ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc, page, CASE WHEN m IS NOT NULL THEN m WHEN ma = mb AND pb - pa <= 80 THEN ma
  WHEN (page - pa <= 20) AND (pb - page <= 20) THEN CASE WHEN ma = mb THEN ma ELSE '' END WHEN page - pa <= 20 THEN ma WHEN pb - page <= 20 THEN mb ELSE '' END AS variant FROM w""")
def page_variants(t: Tables):
    return wi.page_variants(marked_pages(t)).select("doc", "page", "variant")


def part_tokens(t: Tables):
    """Pages are parts; their tokens are the suppliers that ship them."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("doc"), F.col("p_partkey").alias("page"), s("l_suppkey").alias("token")).distinct()


PART_TOKENS = "tk AS (SELECT DISTINCT p_brand AS doc, p_partkey AS page, CAST(l_suppkey AS VARCHAR) AS token FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("start_pages", f"""WITH {PART_TOKENS}, h AS (SELECT n_nationkey AS query_id, doc, page, count(*) AS n_tokens, max(CASE WHEN token = CAST(n_nationkey AS VARCHAR) THEN 1 ELSE 0 END) AS asked
  FROM nation JOIN tk ON doc = 'Brand#' || (n_nationkey + 1) GROUP BY ALL)
SELECT query_id, doc, page FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY asked DESC, n_tokens DESC, page) = 1""")
def start_pages(t: Tables):
    q = t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("doc"))
    h = part_tokens(t).join(q, "doc").groupBy("query_id", "doc", "page").agg(
        F.count("*").alias("n_tokens"), F.max(F.col("token") == s("query_id")).alias("has_asked")).withColumn("factor", F.lit(1.0))
    return wi.best_start_page(h)


@query("cross_references", f"""WITH {PART_TOKENS}, st AS (SELECT 'Brand#' || (n_nationkey + 1) AS doc, n_nationkey AS query_id, (SELECT max(p_partkey) FROM part WHERE p_brand = 'Brand#' || (n_nationkey + 1)) AS page FROM nation),
v AS (SELECT p_brand AS doc, p_partkey AS page, p_name AS sig, CASE WHEN p_size < 10 THEN 'A' WHEN p_size < 20 THEN 'B' ELSE '' END AS variant FROM part),
s0 AS (SELECT st.*, v.variant AS v0 FROM st JOIN v USING (doc, page)), own AS (SELECT query_id, s0.doc AS doc0, s0.page AS page0, v0, token FROM s0 JOIN tk USING (doc, page)),
met AS (SELECT query_id, doc0, v0, tk.doc, tk.page, count(*) AS n_shared FROM own JOIN tk USING (token) WHERE tk.doc <> doc0 OR tk.page <> page0 GROUP BY ALL),
f AS (SELECT met.*, sig, v0 <> '' AND variant <> '' AND v0 <> variant AS other FROM met JOIN v USING (doc, page)), n AS (SELECT query_id, count(*) AS n_other FROM f WHERE other GROUP BY 1),
one AS (SELECT *, count(*) OVER (PARTITION BY query_id, sig) AS n_copies, row_number() OVER (PARTITION BY query_id, sig ORDER BY doc, page) AS r FROM f WHERE NOT other)
SELECT query_id, doc, page, n_copies, n_shared, coalesce(n_other, 0) AS n_other_variant FROM one LEFT JOIN n USING (query_id) WHERE r = 1
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc = doc0, doc, page) <= 6""")
def cross_references(t: Tables):
    size = F.col("p_size")
    pages = t.part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("page"), F.col("p_name").alias("text"),
                          F.when(size < 10, "A").when(size < 20, "B").otherwise("").alias("variant"))
    brand = F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string"))
    starts = (t.nation.select(F.col("n_nationkey").alias("query_id"), brand.alias("doc"))
              .join(pages.groupBy("doc").agg(F.max("page").alias("page")), "doc").select("query_id", "doc", "page"))
    return wi.cross_reference(part_tokens(t), pages, starts).select("query_id", "doc", "page", "n_copies", "n_shared", "n_other_variant")


@query("corrected_tokens", """
WITH k AS (SELECT DISTINCT CAST(c_custkey + 10000 AS VARCHAR) || CASE c_nationkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'G' ELSE 'D' END AS token FROM customer),
d AS (SELECT o_orderkey AS page, CAST(o_custkey + 10000 AS VARCHAR) AS stem, CAST(o_orderkey % 10 AS VARCHAR) AS dig FROM orders),
r AS (SELECT page, stem || dig AS token, stem || l AS reading FROM (SELECT *, unnest(CASE dig WHEN '8' THEN ['B'] WHEN '0' THEN ['C', 'D', 'O'] WHEN '6' THEN ['G'] WHEN '5' THEN ['S'] WHEN '1' THEN ['I'] WHEN '2' THEN ['Z'] WHEN '4' THEN ['A'] ELSE [] END) AS l FROM d))
SELECT d.page, d.stem || d.dig AS token, k.token AS fixed FROM d LEFT JOIN (SELECT r.* FROM r JOIN k ON k.token = reading) x ON x.page = d.page LEFT JOIN k ON k.token = x.reading""")
def corrected_tokens(t: Tables):
    tail = F.element_at(F.array(F.lit("B"), F.lit("G"), F.lit("D")), F.col("c_nationkey") % 3 + 1)
    known = t.customer.select(F.concat((F.col("c_custkey") + 10000).cast("string"), tail).alias("token")).distinct()
    read = t.orders.select(F.lit("d").alias("doc"), F.col("o_orderkey").alias("page"),
                           F.concat((F.col("o_custkey") + 10000).cast("string"), (F.col("o_orderkey") % 10).cast("string")).alias("token"))
    return wi.correct_tokens(read, known).select("page", "token", "fixed")


@query("processed_once", "SELECT p_name, count(*) AS n, min(p_partkey) AS source_id FROM part GROUP BY p_name")
def processed_once(t: Tables):
    rows = t.part.select("p_partkey", "p_name")
    out = wi.process_once(rows, "p_name", "p_partkey", lambda d: d.withColumn("source_id", F.col("p_partkey")))
    return out.groupBy("p_name").agg(F.count("*").alias("n"), F.min("source_id").alias("source_id"))


@query("merged_page_tokens", "SELECT p_partkey AS page, CASE WHEN p_size % 2 = 0 THEN array_to_string(list_sort(list_distinct([p_name, p_type, p_brand])), ',') ELSE p_name END AS tokens, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END AS n_added FROM part")
def merged_page_tokens(t: Tables):
    pages = t.part.select(F.lit("d").alias("doc"), F.col("p_partkey").alias("page"), F.array("p_name").alias("tokens"))
    new = t.part.filter("p_size % 2 = 0").select(F.lit("d").alias("doc"), F.col("p_partkey").alias("page"), F.array("p_type", "p_brand", "p_name").alias("tokens"))
    return wi.merge_page_tokens(pages, new).select("page", F.array_join("tokens", ",").alias("tokens"), "n_added")


@query("majority_labels", """WITH v AS (SELECT l_partkey, l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT l_partkey, sum(n) AS votes, max(n) AS top, arg_min(label, -n * 10 + CASE label WHEN 'F' THEN 0 ELSE 1 END) AS winner FROM v GROUP BY 1)
SELECT l_partkey, CAST(votes AS BIGINT) AS votes, top, CASE WHEN votes >= 3 AND top >= votes * 0.75 THEN winner ELSE 'old' END AS label FROM x""")
def majority_labels(t: Tables):
    return wi.majority_vote(t.lineitem.select("l_partkey", F.col("l_linestatus").alias("label"), F.lit("old").alias("old_label")), ["l_partkey"])


@query("extraction_plan", "SELECT p_type AS kind, count(*) AS total, count_if(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) AS done, count_if(p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) AS \"left\" FROM part GROUP BY p_type")
def extraction_plan(t: Tables):
    return wi.extraction_plan(t.part.select("p_partkey", F.col("p_type").alias("kind")), t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("extraction_stats", "SELECT p_type AS kind, p_brand AS model, CASE WHEN p_size > 10 THEN 'ok' ELSE 'fail' END AS status, count(*) AS pages, CAST(sum(p_size) AS BIGINT) AS tokens FROM part GROUP BY ALL")
def extraction_stats(t: Tables):
    return wi.extraction_stats(t.part.select(F.col("p_type").alias("kind"), F.col("p_brand").alias("model"), F.when(F.col("p_size") > 10, "ok").otherwise("fail").alias("status"), F.col("p_size").alias("tokens")))


@query("holdout_score", """WITH p AS (SELECT p_partkey, p_name, p_brand, p_size FROM part), f AS (SELECT p_name, p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS no FROM p GROUP BY ALL), h AS (SELECT p.* FROM p JOIN f USING (p_name, p_brand) WHERE no % 2 = 1)
SELECT count(*) AS n_pages, CAST(sum(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS hits, 2 * count(*) AS expected, CAST(sum(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 2 END) AS BIGINT) AS found FROM h""")
def holdout_score(t: Tables):
    d = t.part.select("p_partkey", F.array("p_name", "p_brand").alias("expected"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_name")).otherwise(F.array("p_brand", F.lit("?"))).alias("found"))
    return wi.holdout_score(d, "p_partkey")


# Procedures ----------------------------------------------------------------------------------------


def event_manual(t: Tables):
    """Events of a user as the passages of a manual: numbered steps, notes and sub-headings."""
    k, i = F.col("event_type"), s("event_id")
    text = (F.when(k == "signup", F.concat(F.lit("1. Check item "), i)).when(k == "click", F.concat(F.lit("2) **Press** item "), i))
            .when(k == "purchase", F.concat(F.lit("- step 3. Set item "), i)).when(k == "view", F.concat(F.lit("see item "), i)).otherwise(""))
    return t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.when(k == "error", F.concat(F.lit("(2) Part "), i)).otherwise("").alias("section_title"),
                           text.alias("text"))


@query("procedures", r"""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS k, CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN -1 ELSE 0 END AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, n, i, 0 AS b, CASE WHEN n = 1 THEN 1 ELSE 0 END AS st, CASE WHEN n = 1 THEN event_id END AS start, CASE WHEN n = -1 THEN '(2) Part ' || event_id ELSE '' END AS sub, CASE WHEN n = 0 THEN 'see item ' || event_id ELSE '' END AS intro FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.i, r.st, CASE WHEN e.n = 1 THEN 1 WHEN e.n = -1 THEN 0 WHEN e.n = 0 OR r.st = 0 THEN r.st WHEN e.n = r.st + 1 THEN e.n WHEN e.n <= r.st THEN 0 ELSE r.st END,
    CASE WHEN e.n = 1 THEN e.event_id ELSE r.start END, CASE WHEN e.n = -1 THEN '(2) Part ' || e.event_id ELSE r.sub END,
    CASE WHEN e.n = -1 THEN '' WHEN e.n = 0 AND r.st = 0 THEN 'see item ' || e.event_id ELSE r.intro END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
m AS (SELECT user_id, start, count_if(n > 0) AS n_steps, max(event_id) AS seq_end, string_agg(CASE WHEN n = 0 THEN 'see item ' || event_id WHEN n = 1 THEN 'Check item ' || event_id WHEN n = 2 THEN 'Press item ' || event_id ELSE 'Set item ' || event_id END, ' ' ORDER BY event_id) AS body
  FROM r WHERE st > 0 AND (n = 0 OR (st = n AND (n = 1 OR b = n - 1))) GROUP BY ALL),
h AS (SELECT user_id, event_id AS start, CASE WHEN sub <> '' THEN sub ELSE intro END AS title FROM r WHERE n = 1)
SELECT user_id AS doc_id, start AS seq_start, seq_end, CAST(n_steps AS INTEGER) AS n_steps, title, md5(body) AS body FROM m JOIN h USING (user_id, start) WHERE n_steps >= 2""")
def procedures(t: Tables):
    out = pr.split_procedures(pr.line_stream(event_manual(t)))
    body = F.array_join(F.transform("steps", lambda x: F.concat_ws(" ", x["text"], F.nullif(x["detail"], F.lit("")))), " ")
    return out.select("doc_id", "seq_start", "seq_end", "n_steps", "title", F.md5(body).alias("body"))


@query("whole_document_steps", """WITH d AS (SELECT source, doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS head, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
n AS (SELECT *, sum(CASE WHEN head <> '' OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS n FROM d)
SELECT source AS doc_id, CAST(n AS BIGINT) AS n, CASE WHEN arg_min(head, doc_id) = '' THEN '(overview)' ELSE arg_min(head, doc_id) END AS text FROM n GROUP BY source, n""")
def whole_document_steps(t: Tables):
    p = t.documents.select(F.col("source").alias("doc_id"), F.col("source").alias("doc_name"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("section_title"), "text")
    return pr.whole_document_steps(p).select("doc_id", "n", "text")


def library(t: Tables, second: bool):
    """Manuals of all users but a tenth, or a later state: a tenth changed, a tenth gone, a tenth new."""
    u = F.col("doc_id")
    p = event_manual(t).withColumns({"doc_name": F.concat(F.when(u % 10 == 1, "report ").otherwise("manual "), u.cast("string")), "doc_type": F.when(u % 5 == 0, "sop").otherwise("manual"), "model": F.lit("")})
    return p.filter((u % 10 != 7) & ~((u % 10 == 3) & (F.col("seq") % 7 == 0))) if second else p.filter(u % 10 != 9)


@query("rebuilt_procedures", r"""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN -1 ELSE 0 END AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
  WHERE user_id % 10 <> 7 AND NOT (user_id % 10 = 3 AND event_id % 7 = 0)),
r AS (SELECT user_id, event_id, n, i, 0 AS b, CASE WHEN n = 1 THEN 1 ELSE 0 END AS st, CASE WHEN n = 1 THEN event_id END AS start, CASE WHEN n = -1 THEN '(2) Part ' || event_id ELSE '' END AS sub, CASE WHEN n = 0 THEN 'see item ' || event_id ELSE '' END AS intro FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.i, r.st, CASE WHEN e.n = 1 THEN 1 WHEN e.n = -1 THEN 0 WHEN e.n = 0 OR r.st = 0 THEN r.st WHEN e.n = r.st + 1 THEN e.n WHEN e.n <= r.st THEN 0 ELSE r.st END,
    CASE WHEN e.n = 1 THEN e.event_id ELSE r.start END, CASE WHEN e.n = -1 THEN '(2) Part ' || e.event_id ELSE r.sub END,
    CASE WHEN e.n = -1 THEN '' WHEN e.n = 0 AND r.st = 0 THEN 'see item ' || e.event_id ELSE r.intro END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
m AS (SELECT user_id, start, count_if(n > 0) AS n_steps, max(event_id) AS seq_end FROM r WHERE st > 0 AND (n = 0 OR (st = n AND (n = 1 OR b = n - 1))) GROUP BY ALL),
h AS (SELECT user_id, event_id AS start, CASE WHEN sub <> '' THEN sub ELSE intro END AS title FROM r WHERE n = 1),
w AS (SELECT user_id, min(event_id) AS start, max(event_id) AS seq_end, count_if(n = -1) + CASE WHEN arg_min(n, event_id) = -1 THEN 0 ELSE 1 END AS n_steps FROM e WHERE user_id % 5 = 0 GROUP BY 1),
p AS (SELECT user_id, start, seq_end, n_steps, title, 'numbered' AS kind FROM m JOIN h USING (user_id, start) WHERE n_steps >= 2 AND user_id % 5 <> 0 AND user_id % 10 <> 1
  UNION ALL SELECT user_id, start, seq_end, n_steps, 'manual ' || user_id, 'whole' FROM w)
SELECT user_id AS doc_id, kind, start AS seq_start, seq_end, CAST(n_steps AS INTEGER) AS n_steps, title, CASE WHEN user_id % 10 = 9 OR (user_id IN (SELECT user_id FROM events WHERE user_id % 10 = 3 AND event_id % 7 = 0)) THEN 2 ELSE 1 END AS built, true AS has_vector FROM p""")
def rebuilt_procedures(t: Tables):
    """A store built once, then brought to the later state: only changed and new documents carry the second version."""
    store = ProcedureStore.create(t.spark)
    for second in (False, True):
        store.update(library(t, second), F.col("doc_type") == "sop", F.col("doc_name").startswith("report"),
                     lambda texts: texts.withColumn("vector", F.array(F.length("text").cast("double"))))
    return store.procedures().select("doc_id", "kind", "seq_start", "seq_end", "n_steps", "title", "built", F.col("vector").isNotNull().alias("has_vector"))


def part_procedures(t: Tables):
    p = F.col("p_partkey")
    steps = F.transform(F.array("p_brand", "p_type", F.lit("Check it")), lambda x, i: F.struct((i + 1).alias("n"), x.alias("text"), F.lit("").alias("detail")))
    return t.part.select(
        p.alias("proc_id"), F.col("p_brand").alias("doc_id"), F.col("p_brand").alias("doc_name"), F.col("p_name").alias("title"), F.concat_ws(" ", F.col("p_type"), s("p_size")).alias("breadcrumb"), F.when(F.col("p_size") % 5 == 0, "sop").otherwise("manual").alias("doc_type"),
        F.array(F.concat(F.lit("M"), (F.col("p_size") % 3 + 1).cast("string"))).alias("tags"), F.array().cast("array<string>").alias("name_tags"), F.col("p_size").alias("n_steps"), steps.alias("steps"),
        p.alias("start_pos"), F.concat(F.lit("P"), s("p_partkey")).alias("page"), F.lit("").alias("intro"))


@query("procedure_groups", """SELECT p_partkey AS proc_id, substr(md5(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '|' || lower(p_type)), 1, 16) AS group_key, round(CAST(1 AS DOUBLE) / 3, 4) AS share FROM part""")
def procedure_groups(t: Tables):
    return part_procedures(t).select("proc_id", pr.group_key("title", "steps").alias("group_key"), F.round(pr.action_share("steps"), 4).alias("share"))


RANKED = """q AS (SELECT r_regionkey AS query_id, ['red', 'bolt', 'ring', 'blue', 'small'][r_regionkey + 1] AS w FROM region),
tm AS (SELECT query_id, w AS term FROM q UNION SELECT query_id, 'widget' FROM q), pt AS (SELECT term, p_partkey FROM (SELECT DISTINCT term FROM tm) JOIN part ON contains(lower(p_name || ' ' || p_type || ' ' || p_size), term)),
sim AS (SELECT query_id, p_partkey, p_size / 100.0 AS score FROM q JOIN part ON p_partkey % 5 = query_id AND p_size > 40),
st AS (SELECT query_id, p_partkey, score FROM sim UNION ALL SELECT DISTINCT query_id, p_partkey, 0.3 FROM tm JOIN pt USING (term) WHERE NOT EXISTS (SELECT 1 FROM sim WHERE sim.query_id = tm.query_id AND sim.p_partkey = pt.p_partkey)),
sc AS (SELECT query_id, p.*, round((score + 0.06 * (CAST(contains(lower(p_name || ' ' || p_type || ' ' || p_size), w) AS INTEGER) + CAST(contains(lower(p_name || ' ' || p_type || ' ' || p_size), 'widget') AS INTEGER)) + CASE WHEN p_size % 5 = 0 THEN 0.08 ELSE 0 END)
  * (0.85 + 0.15 * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END) + 0.005 * least(p_size, 10), 6) AS score FROM st JOIN part p USING (p_partkey) JOIN q USING (query_id))"""


def ranked(t: Tables):
    word = F.element_at(F.array(*[F.lit(w) for w in ("red", "bolt", "ring", "blue", "small")]), F.col("r_regionkey") + 1)
    q = t.region.select(F.col("r_regionkey").alias("query_id"), F.array(word, F.lit("widget")).alias("terms"), F.array().cast("array<string>").alias("named"))
    sim = t.part.filter("p_size > 40").join(q.select("query_id"), F.col("p_partkey") % 5 == F.col("query_id")).select("query_id", F.col("p_partkey").alias("proc_id"), (F.col("p_size") / 100.0).alias("score"))
    p = part_procedures(t)
    return pr.rank_procedures(p.withColumn("group_key", pr.group_key("title", "steps")), q, sim, ["M1", "M2", "M3"])


@query("ranked_procedures", f"WITH {RANKED} SELECT query_id, p_partkey AS proc_id, round(score, 4) AS score FROM sc")
def ranked_procedures(t: Tables):
    return ranked(t).select("query_id", "proc_id", F.round("score", 4).alias("score"))


@query("collapsed_procedures", f"""WITH RECURSIVE {RANKED}, o AS (SELECT query_id, p_partkey, p_brand || '|' || p_type || ' ' || p_size AS h, p_name || '|' || p_brand || '|' || p_type AS g, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS i FROM sc),
w AS (SELECT query_id, i, [p_partkey] AS kept, [h] AS hs, [g] AS gs FROM o WHERE i = 1
  UNION ALL SELECT o.query_id, o.i, CASE WHEN len(kept) < 8 AND NOT list_contains(hs, h) AND NOT list_contains(gs, g) THEN list_append(kept, p_partkey) ELSE kept END,
    CASE WHEN len(kept) < 8 AND NOT list_contains(hs, h) AND NOT list_contains(gs, g) THEN list_append(hs, h) ELSE hs END,
    CASE WHEN len(kept) < 8 AND NOT list_contains(hs, h) AND NOT list_contains(gs, g) THEN list_append(gs, g) ELSE gs END FROM w JOIN o ON o.query_id = w.query_id AND o.i = w.i + 1),
f AS (SELECT query_id, kept FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1)
SELECT query_id, generate_subscripts(kept, 1) AS position, unnest(kept) AS proc_id FROM f""")
def collapsed_procedures(t: Tables):
    return pr.collapse_groups(ranked(t)).select("query_id", F.col("position").cast("long").alias("position"), "proc_id")


@query("sibling_procedures", """WITH g AS (SELECT p_brand AS doc_id, p_type || ' ' || p_size AS title, count(*) AS n_parts, arg_min(p_partkey, p_partkey) AS a, arg_max(p_partkey, p_partkey) AS b FROM part GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12)
SELECT doc_id, title, n_parts, CAST(3 * n_parts AS BIGINT) AS n_steps, 'P' || a || '～P' || b AS page FROM g""")
def sibling_procedures(t: Tables):
    return pr.expand_siblings(part_procedures(t)).select("doc_id", "title", "n_parts", F.size("steps").cast("long").alias("n_steps"), "page")


@query("group_documents", "SELECT p_name AS group_key, count(*) AS n_procedures, count(DISTINCT p_brand) AS n_documents FROM part GROUP BY p_name")
def group_documents(t: Tables):
    return pr.group_documents(part_procedures(t).withColumn("group_key", F.col("title")))


@query("also_in", """WITH w AS (SELECT max(p_partkey) AS wanted_id FROM part GROUP BY p_type) SELECT DISTINCT w.wanted_id, q.p_brand AS doc_name FROM w JOIN part p ON p.p_partkey = w.wanted_id JOIN part q ON q.p_name = p.p_name AND q.p_partkey <> p.p_partkey""")
def also_in(t: Tables):
    p = part_procedures(t).withColumn("group_key", F.col("title"))
    return pr.also_in(p, t.part.groupBy("p_type").agg(F.max("p_partkey").alias("proc_id")).select("proc_id"))


@query("unclassified_groups", """SELECT p_name || p_brand AS group_key, min(p_partkey) AS proc_id, CASE WHEN contains(p_name, 'bolt') THEN 'fastener' WHEN contains(p_name, 'ring') THEN 'seal' ELSE 'other' END AS unit FROM part
WHERE p_name || p_brand NOT IN (SELECT p_name || p_brand FROM part WHERE p_size > 45) GROUP BY p_name, p_brand""")
def unclassified_groups(t: Tables):
    p = part_procedures(t).withColumn("group_key", F.concat("title", "doc_id"))
    labels = pr.normalise_labels(p.filter("n_steps > 45").select("group_key", F.lit("?").alias("unit")), ["seal"])
    return pr.unclassified_groups(p, labels, [("fastener", "bolt"), ("seal", "ring")], n=None).select("group_key", "proc_id", "unit")


@query("procedure_status", "SELECT count(*) AS procedures, count(DISTINCT p_brand) AS documents, count_if(p_size > 10) AS with_vector FROM part")
def procedure_status(t: Tables):
    return pr.procedure_status(part_procedures(t), vector=F.col("n_steps") > 10)


# Glossary ------------------------------------------------------------------------------------------


def initials():
    return F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), ""))


INITIALS = "upper(substr(string_split(p_name, ' ')[1], 1, 1) || substr(string_split(p_name, ' ')[2], 1, 1))"
TITLE = "upper(substr(string_split(p_name, ' ')[1], 1, 1)) || substr(string_split(p_name, ' ')[1], 2) || ' ' || upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2)"


def glossary_passages(t: Tables):
    text = F.concat(F.lit("We use the "), "p_name", F.lit(" ("), initials(), F.lit(") here. Also "), initials(), F.lit(" ("), "p_name", F.lit("), not "), initials(), F.lit(" (xylophone).\n| Abbreviation | Meaning |\n|---|---|\n| "),
                    initials(), F.lit(" | "), F.initcap("p_name"), F.lit(" |\nend\n| XX | no |"))
    return spread(t.part, "p_partkey").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("doc_name"), text.alias("text"))


@query("mined_names", f"""SELECT p_brand AS doc_name, {INITIALS} AS abbr, {TITLE} AS "full", count(*) AS n FROM part WHERE {INITIALS} NOT IN ('NO', 'OK', 'NG', 'ON', 'PC', 'ID', 'IP', 'OS', 'PP', 'SW', 'UP', 'AC', 'DC', 'NA', 'VS', 'OR', 'IN', 'IS', 'IT') GROUP BY ALL""")
def mined_names(t: Tables):
    return gl.mine_long_short(glossary_passages(t)).groupBy("doc_name", "abbr", "full").agg(F.count("*").alias("n"))


@query("mined_phrases", f"""SELECT p_brand AS doc_name, {INITIALS} AS abbr, p_name AS "full", count(*) AS n FROM part WHERE {INITIALS} NOT IN ('NO', 'OK', 'NG', 'ON', 'PC', 'ID', 'IP', 'OS', 'PP', 'SW', 'UP', 'AC', 'DC', 'NA', 'VS', 'OR', 'IN', 'IS', 'IT') GROUP BY ALL""")
def mined_phrases(t: Tables):
    return gl.mine_short_long(glossary_passages(t)).groupBy("doc_name", "abbr", "full").agg(F.count("*").alias("n"))


@query("mined_tables", f"""SELECT {INITIALS} AS abbr, {TITLE} AS cell, 'en' AS lang, count(*) AS n FROM part WHERE {INITIALS} NOT IN ('NO', 'OK', 'NG', 'ON', 'PC', 'ID', 'IP', 'OS', 'PP', 'SW', 'UP', 'AC', 'DC', 'NA', 'VS', 'OR', 'IN', 'IS', 'IT') GROUP BY ALL""")
def mined_tables(t: Tables):
    return gl.mine_tables(glossary_passages(t)).groupBy("abbr", "cell", "lang").agg(F.count("*").alias("n"))


SENSES = f"""se AS (SELECT {INITIALS} AS abbr, {TITLE} AS en, count(*) AS n FROM part WHERE {INITIALS} NOT IN ('NO', 'OK', 'NG', 'ON', 'PC', 'ID', 'IP', 'OS', 'PP', 'SW', 'UP', 'AC', 'DC', 'NA', 'VS', 'OR', 'IN', 'IS', 'IT') GROUP BY ALL HAVING count(*) >= 2),
sr AS (SELECT *, row_number() OVER (PARTITION BY abbr ORDER BY n DESC, lower(en)) AS sense_no FROM se)"""


@query("merged_senses", f"WITH {SENSES} SELECT abbr, en AS \"full\", CAST(n * 4 AS BIGINT) AS n, CAST(sense_no AS BIGINT) AS place FROM sr WHERE sense_no <= 3")
def merged_senses(t: Tables):
    p = glossary_passages(t)
    return gl.merge_senses(gl.mine_long_short(p), gl.mine_tables(p)).select("abbr", "full", "n", F.col("rank").cast("long").alias("place"))


@query("sense_documents", f"SELECT abbr, doc_name FROM (SELECT DISTINCT {INITIALS} AS abbr, p_brand AS doc_name FROM part WHERE {INITIALS} NOT IN ('NO', 'OK', 'NG', 'ON', 'PC', 'ID', 'IP', 'OS', 'PP', 'SW', 'UP', 'AC', 'DC', 'NA', 'VS', 'OR', 'IN', 'IS', 'IT')) QUALIFY row_number() OVER (PARTITION BY abbr ORDER BY doc_name) <= 5")
def sense_documents(t: Tables):
    return gl.sense_documents(gl.mine_long_short(glossary_passages(t))).select("abbr", "doc_name")


def senses(t: Tables):
    m = gl.merge_senses(gl.mine_long_short(glossary_passages(t)))
    auto = m.select("abbr", F.col("full").alias("en"), F.array(F.lit("ja1")).alias("ja"), F.array().cast("array<string>").alias("zh"), F.col("rank").alias("ord"), F.lit("").alias("note"))
    manual = t.nation.select(F.concat(F.lit("N"), s("n_nationkey")).alias("abbr"), F.col("n_name").alias("en"), F.array().cast("array<string>").alias("ja"), F.array(F.lit("国")).alias("zh"),
                             F.col("n_nationkey").alias("ord"))
    more = t.region.select(F.lit("RW").alias("abbr"), F.lit("red widget").alias("en"), F.array(F.lit("jb")).alias("ja"), F.array().cast("array<string>").alias("zh"), F.col("r_regionkey").alias("ord")).filter("ord = 0")
    return gl.overlay_manual(auto.drop("note"), manual.unionByName(more))


OVERLAY = f"""{SENSES}, al AS (SELECT abbr, en, 1 AS pri, sense_no AS o FROM sr WHERE sense_no <= 3 UNION ALL SELECT 'N' || n_nationkey, n_name, 0, n_nationkey FROM nation UNION ALL SELECT 'RW', 'red widget', 0, 0),
ov AS (SELECT abbr, arg_min(en, pri * 1000 + o) AS en, CASE WHEN min(pri) = 0 THEN 'manual' ELSE 'auto' END AS src, row_number() OVER (PARTITION BY abbr ORDER BY min(pri * 1000 + o)) AS sense_no,
  CASE WHEN abbr = 'RW' AND lower(arg_min(en, pri * 1000 + o)) = 'red widget' THEN CASE WHEN count(*) = 2 THEN 'jb,ja1' ELSE 'jb' END WHEN min(pri) = 0 THEN '' ELSE 'ja1' END AS ja FROM al GROUP BY abbr, lower(en))"""


@query("overlaid_senses", f"WITH {OVERLAY} SELECT abbr, en, src, ja, sense_no FROM ov")
def overlaid_senses(t: Tables):
    return senses(t).select("abbr", "en", "src", F.array_join("ja", ",").alias("ja"), "sense_no")


@query("missing_abbreviations", """WITH w AS (SELECT string_split(o_orderpriority, '-')[2] AS p, 'C' || (o_custkey % 7) AS doc FROM orders), k AS (SELECT CASE p WHEN 'NOT SPECIFIED' THEN 'NOT' ELSE p END AS abbr, doc FROM w WHERE p <> 'LOW'),
n AS (SELECT abbr, doc, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY abbr) AS total, row_number() OVER (PARTITION BY abbr ORDER BY n DESC, doc) AS i FROM n)
SELECT abbr, CAST(total AS BIGINT) AS total, string_agg(doc, ', ' ORDER BY i) AS docs FROM r WHERE i <= 2 GROUP BY ALL""")
def missing_abbreviations(t: Tables):
    p = t.orders.select(F.concat(F.lit("C"), (F.col("o_custkey") % 7).cast("string")).alias("doc_name"), F.col("o_orderpriority").alias("text"))
    known = t.region.select(F.lit("LOW").alias("abbr"))
    return gl.missing_abbreviations(p, known)


def abbr_questions(t: Tables):
    return t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("why does n"), s("n_nationkey"), F.lit(" stop the RW and RW-12?")).alias("question"))


@query("expanded_abbreviations", f"""WITH {OVERLAY}, x AS (SELECT n_nationkey AS query_id, 'N' || n_nationkey AS abbr, 0 AS o FROM nation WHERE n_nationkey < 100 UNION ALL SELECT n_nationkey, 'RW', 1 FROM nation),
e AS (SELECT query_id, o, sense_no, 0 AS i, en AS term FROM x JOIN ov USING (abbr) WHERE sense_no <= 3 UNION ALL SELECT query_id, o, sense_no, 1, CASE WHEN o = 0 THEN '国' ELSE string_split(ja, ',')[1] END FROM x JOIN ov USING (abbr) WHERE sense_no <= 3),
d AS (SELECT query_id, term, min(o * 1000 + sense_no * 10 + i) AS k FROM e GROUP BY ALL) SELECT query_id, term, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS BIGINT) AS place FROM d QUALIFY place <= 6""")
def expanded_abbreviations(t: Tables):
    return gl.expand_abbreviations(abbr_questions(t), senses(t)).select("query_id", "term", F.col("position").cast("long").alias("place"))


@query("augmented_questions", f"""WITH {OVERLAY} SELECT n_nationkey AS query_id, 'why does n' || n_nationkey || ' stop the RW and RW-12?（N' || n_nationkey || ' = ' || n_name || ' / 国；RW = ' || en || ' / ' || string_split(ja, ',')[1] || '）' AS augmented
FROM nation, ov WHERE ov.abbr = 'RW' AND sense_no = 1""")
def augmented_questions(t: Tables):
    return gl.augment_questions(abbr_questions(t), senses(t)).select("query_id", "augmented")
