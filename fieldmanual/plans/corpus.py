"""Queries over sources and corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmanual.functions import text as tx
from fieldmanual.operators import ordered as od
from fieldmanual.operators import prepare
from fieldmanual.plans.registry import Tables, query, spread
from fieldmanual.sources import readers, sinks


def s(c):
    return F.col(c).cast("string")


@query("passage_ids", """
SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) AS path_id, substr(sha256(text), 1, 12) AS chunk_hash
FROM documents""")
def passage_ids(t: Tables):
    return t.documents.select("doc_id", tx.short_id("doc_id").alias("path_id"), tx.short_id("text").alias("chunk_hash"))


def order_notes(t: Tables):
    """One small note with headings per order."""
    return t.orders.select("o_orderkey", F.concat(
        F.lit("Note "), s("o_orderkey"), F.lit("\n# Order "), s("o_orderkey"), F.lit("\nPriority "), F.col("o_orderpriority"),
        F.lit("\nStatus "), F.col("o_orderstatus"), F.lit("\n## Customer\n"), s("o_custkey")).alias("text"))


@query("heading_sections", """
SELECT o_orderkey, CAST(0 AS BIGINT) AS section_no, '' AS section_title, 'Note ' || o_orderkey AS text FROM orders
UNION ALL SELECT o_orderkey, 1, '# Order ' || o_orderkey, 'Priority ' || o_orderpriority || chr(10) || 'Status ' || o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, 2, '## Customer', CAST(o_custkey AS VARCHAR) FROM orders""")
def heading_sections(t: Tables):
    return prepare.split_by_headings(order_notes(t), ["o_orderkey"])


@query("short_texts_whole", """
SELECT doc_id, CAST(0 AS BIGINT) AS section_no, length(text) AS n FROM documents""")
def short_texts_whole(t: Tables):
    return prepare.split_sections(t.documents, ["doc_id"]).select("doc_id", "section_no", F.length("text").cast("long").alias("n"))


@query("repacked_paragraphs", r"""
WITH RECURSIVE p AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS para FROM (
    SELECT doc_id, list_filter(string_split_regex(text, '\n+'), lambda x: trim(x) <> '') AS l FROM documents)),
w AS (SELECT doc_id, i, 1 AS c, length(para) AS n FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN w.n + length(p.para) > 3072 THEN w.c + 1 ELSE w.c END,
    CASE WHEN w.n + length(p.para) > 3072 THEN length(p.para) ELSE w.n + length(p.para) + 2 END
  FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id, CAST(c - 1 AS BIGINT) AS section_no, CAST(max(n) AS BIGINT) AS n FROM w GROUP BY doc_id, c""")
def repacked_paragraphs(t: Tables):
    docs = t.documents.withColumn(
        "text", F.array_join(F.filter(F.split("text", "\n+"), lambda x: F.trim(x) != ""), "\n\n"))
    return prepare.split_by_headings(docs, ["doc_id"]).select("doc_id", "section_no", F.length("text").cast("long").alias("n"))


SENTENCES = r"""
sent AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
  text, '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l
  FROM documents),
u AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM sent),
v AS (SELECT doc_id, i, s, len(string_split_regex(s, '\s+')) AS w FROM u)"""


@query("sentence_chunks", rf"""
WITH RECURSIVE {SENTENCES},
g AS (SELECT doc_id, i, 1 AS c, w AS n FROM v WHERE i = 1
  UNION ALL SELECT v.doc_id, v.i, CASE WHEN g.n + v.w > 512 THEN g.c + 1 ELSE g.c END, CASE WHEN g.n + v.w > 512 THEN v.w ELSE g.n + v.w END
  FROM g JOIN v ON v.doc_id = g.doc_id AND v.i = g.i + 1),
k AS (SELECT g.doc_id, c, string_agg(s, ' ' ORDER BY g.i) AS body FROM g JOIN v ON v.doc_id = g.doc_id AND v.i = g.i GROUP BY g.doc_id, c),
o AS (SELECT k.doc_id, k.c, k.body, p.body AS prev FROM k LEFT JOIN k p ON p.doc_id = k.doc_id AND p.c = k.c - 1)
SELECT doc_id, CAST(c - 1 AS BIGINT) AS chunk_no, substr(sha256(CASE WHEN prev IS NULL THEN body ELSE
  array_to_string(list_slice(string_split_regex(prev, '\s+'), greatest(len(string_split_regex(prev, '\s+')) - 63, 1), len(string_split_regex(prev, '\s+'))), ' ')
  || ' ' || body END), 1, 12) AS chunk_hash FROM o""")
def sentence_chunks(t: Tables):
    return prepare.chunk_sentences(t.documents, ["doc_id"]).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_hash")


@query("parent_child_chunks", rf"""
WITH RECURSIVE {SENTENCES},
big AS (SELECT doc_id FROM documents WHERE length(text) > 256),
b AS (SELECT v.* FROM v JOIN big USING (doc_id)),
g AS (SELECT doc_id, i, 1 AS c, w AS n FROM b WHERE i = 1
  UNION ALL SELECT b.doc_id, b.i, CASE WHEN g.n + b.w > 256 THEN g.c + 1 ELSE g.c END, CASE WHEN g.n + b.w > 256 THEN b.w ELSE g.n + b.w END
  FROM g JOIN b ON b.doc_id = g.doc_id AND b.i = g.i + 1)
SELECT doc_id, 'parent' AS chunk_type, CAST(1 AS BIGINT) AS n FROM documents WHERE length(text) >= 20
UNION ALL SELECT doc_id, 'child', count(DISTINCT c) FROM g GROUP BY doc_id""")
def parent_child_chunks(t: Tables):
    return prepare.chunk_parent_child(t.documents, ["doc_id"]).groupBy("doc_id", "chunk_type").agg(F.count("*").alias("n"))


@query("section_pages", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, text FROM documents),
p AS (SELECT doc_id, strpos(text, substr(line, 1, 50)) - 1 AS position FROM l)
SELECT doc_id, CAST(position AS BIGINT) AS position, CAST(CASE WHEN position < 0 THEN 1 ELSE position // 1000 + 1 END AS BIGINT) AS page, count(*) AS n
FROM p GROUP BY ALL""")
def section_pages(t: Tables):
    lines = prepare.text_lines(t.documents.select("doc_id", "text", F.col("text").alias("full")), ["doc_id", "full"])
    at = lines.select("doc_id", prepare.section_position(F.col("line"), F.col("full")).alias("position"))
    pages = t.documents.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.length("text"), F.lit(1000))).alias("i", "start_offset")).select(
        "doc_id", (F.col("i") + 1).alias("page"), "start_offset")
    return prepare.assign_page(at, pages, ["doc_id"]).groupBy("doc_id", "position", "page").agg(F.count("*").alias("n"))


@query("legible_lines", r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
  lambda x: len(regexp_extract_all(x, '[A-Za-z0-9\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]')) >= 3
    AND len(regexp_extract_all(x, '[A-Za-z0-9\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]')) * 2 >= length(regexp_replace(x, '\s', '', 'g'))) AS k FROM documents),
t AS (SELECT doc_id, array_to_string(k, chr(10)) AS x FROM l)
SELECT doc_id, CASE WHEN len(regexp_extract_all(x, '[A-Za-z0-9\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]')) >= 30 THEN md5(x) END AS kept FROM t""")
def legible_lines(t: Tables):
    return t.documents.select("doc_id", F.md5(tx.keep_legible_lines("text")).alias("kept"))


@query("lines_without_noise", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
noise AS (SELECT doc_id, line FROM l WHERE line <> '' AND length(line) < 120
  AND NOT regexp_matches(line, '^\s*(?:[-*•]\s+)?(?:(?:step|STEP|Step)\s*)?\d{1,2}\s*[.)．、]([^0-9]|$)') GROUP BY ALL HAVING count(*) >= 5)
SELECT l.doc_id, count(*) AS kept_lines, CAST(sum(length(l.line)) AS BIGINT) AS kept_chars
FROM l LEFT JOIN noise n ON n.doc_id = l.doc_id AND n.line = l.line WHERE n.line IS NULL GROUP BY l.doc_id""")
def lines_without_noise(t: Tables):
    lines = prepare.text_lines(t.documents, ["doc_id"])
    return prepare.drop_repeated_lines(lines, ["doc_id"]).groupBy("doc_id").agg(
        F.count("*").alias("kept_lines"), F.sum(F.length("line")).alias("kept_chars"))


@query("lines_outside_spans", r"""
WITH e AS (SELECT user_id, event_id, event_type,
  last_value(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS inside FROM events)
SELECT user_id, event_id FROM e WHERE coalesce(inside, 0) = 0 AND event_type NOT IN ('signup', 'purchase')""")
def lines_outside_spans(t: Tables):
    k = F.col("event_type")
    return prepare.drop_marked_spans(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id",
                                     k == "signup", k == "purchase").select("user_id", "event_id")


@query("clean_markdown", r"""
SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus || ' - ' || o_custkey AS text FROM orders""")
def clean_markdown(t: Tables):
    raw = F.concat(F.lit("> **"), F.col("o_orderpriority"), F.lit("**<br>~~"), F.col("o_orderstatus"), F.lit("~~ \\- "), s("o_custkey"))
    return t.orders.select("o_orderkey", tx.clean_markdown(raw).alias("text"))


@query("distinct_contents", r"""
SELECT content_key, min(doc_id) AS doc_id FROM (SELECT md5(regexp_replace(text, '[\s*#_|>`\-]+', '', 'g')) AS content_key, doc_id FROM documents)
GROUP BY content_key""")
def distinct_contents(t: Tables):
    return prepare.dedupe_content(t.documents, [F.col("doc_id")]).select("content_key", "doc_id")


@query("packed_windows", r"""
WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents
  WHERE length(trim(text)) >= 40),
g AS (SELECT source, doc_id, i, 1 AS w, n AS len FROM d WHERE i = 1
  UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN g.len + d.n > 2600 THEN g.w + 1 ELSE g.w END, CASE WHEN g.len + d.n > 2600 THEN d.n ELSE g.len + d.n END
  FROM g JOIN d ON d.source = g.source AND d.i = g.i + 1)
SELECT source, CAST(w AS BIGINT) AS window_no, CAST(count(*) AS BIGINT) AS n_passages, CAST(max(len) AS BIGINT) AS n FROM g GROUP BY source, w""")
def packed_windows(t: Tables):
    w = prepare.pack_windows(t.documents, ["source"], "doc_id", min_chars=40)
    return w.select("source", "window_no", F.col("n_passages").cast("long").alias("n_passages"), F.length("text").cast("long").alias("n"))


@query("scored_evidence", r"""
WITH d AS (SELECT source, doc_id, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, CAST(len(regexp_extract_all(text, 'tion|error|ent')) AS BIGINT) AS score FROM d
WHERE pos >= floor(n * 0.05) AND len(regexp_extract_all(text, 'tion|error|ent')) >= 3 AND NOT regexp_matches(lang, '^de$')""")
def scored_evidence(t: Tables):
    df = prepare.score_evidence(t.documents, "source", "doc_id", "tion|error|ent", title="lang", stop_titles="^de$")
    out = prepare.order_candidates(df, F.col("source") == "src0", F.col("lang"), ["source", "doc_id"])
    return out.select("source", "doc_id", F.col("score").cast("long").alias("score"))


def nation_days(t: Tables):
    """One day text per nation and order date."""
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    day = o.groupBy("c_nationkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("k"))
    text = F.concat(F.lit("Orders taken on this day at the site: "), s("n"), F.lit(", last order "), s("k"), F.lit("."))
    return day.select(F.col("c_nationkey").alias("log_id"), "day", text.alias("text"))


NATION_DAYS = """days AS (SELECT c_nationkey AS log_id, CAST(o_orderdate AS DATE) AS day,
  'Orders taken on this day at the site: ' || count(*) || ', last order ' || max(o_orderkey) || '.' AS text
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


@query("week_windows", f"""
WITH RECURSIVE {NATION_DAYS},
d AS (SELECT *, isoyear(day) || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS week, length(text) AS n FROM days WHERE length(trim(text)) >= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY log_id, week ORDER BY day) AS i FROM d),
g AS (SELECT log_id, week, i, text, 0 AS w, n AS len FROM r WHERE i = 1
  UNION ALL SELECT r.log_id, r.week, r.i, r.text, CASE WHEN g.len + r.n > 130 THEN g.w + 1 ELSE g.w END, CASE WHEN g.len + r.n > 130 THEN r.n ELSE g.len + r.n END
  FROM g JOIN r ON r.log_id = g.log_id AND r.week = g.week AND r.i = g.i + 1)
SELECT log_id, week, w AS window_no, md5(string_agg(text, chr(10) ORDER BY i)) AS text_md5, CAST(count(*) AS BIGINT) AS n_days FROM g GROUP BY log_id, week, w""")
def week_windows(t: Tables):
    return prepare.week_windows(nation_days(t), None, limit=130).select(
        "log_id", "week", "window_no", F.md5("text").alias("text_md5"), F.size("day_keys").cast("long").alias("n_days"))


@query("unprocessed_days", f"""
WITH {NATION_DAYS}, k AS (SELECT *, 'd:' || md5(CAST(day AS VARCHAR) || trim(text)) AS day_key FROM days)
SELECT log_id, count(*) AS n FROM k WHERE day_key NOT IN (SELECT k.day_key FROM k JOIN nation ON n_nationkey = log_id WHERE n_regionkey = 2) GROUP BY log_id""")
def unprocessed_days(t: Tables):
    days = nation_days(t)
    old = days.join(t.nation.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("log_id")), "log_id", "left_semi")
    done = old.select(prepare.day_fingerprint(F.col("day"), F.col("text")).alias("day_key"))
    w = prepare.week_windows(days, done, min_chars=0)
    return w.groupBy("log_id").agg(F.sum(F.size("day_keys")).alias("n"))


@query("masked_aliases", r"""
SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' in ' || c_mktsegment, 'Customer', 'K01', 'g'), 'BUILDING', 'K02', 'g') AS text FROM customer""")
def masked_aliases(t: Tables):
    return t.customer.select("c_custkey", tx.mask_aliases(F.concat("c_name", F.lit(" in "), "c_mktsegment"), [
        ("customer", "K01"), ("building", "K02"), ("build", "K03")]).alias("text"))


@query("snippet_pages", r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page, unnest(string_split(text, chr(10))) AS line FROM documents),
sn AS (SELECT doc_id, regexp_replace(max(line), '\s+', '', 'g') AS t FROM l GROUP BY doc_id),
a AS (SELECT sn.doc_id, min(CASE WHEN contains(regexp_replace(line, '\s+', '', 'g'), substr(t, 1, 40)) THEN page END) AS p40,
  min(CASE WHEN contains(regexp_replace(line, '\s+', '', 'g'), substr(t, 1, 24)) THEN page END) AS p24,
  min(CASE WHEN contains(regexp_replace(line, '\s+', '', 'g'), substr(t, 1, 14)) THEN page END) AS p14
  FROM sn JOIN l USING (doc_id) GROUP BY ALL)
SELECT doc_id, CAST(coalesce(p40, p24, p14, 1) AS BIGINT) AS page FROM a""")
def snippet_pages(t: Tables):
    lines = prepare.text_lines(t.documents, ["doc_id"]).select("doc_id", (F.col("line_no") + 1).cast("long").alias("page"), F.col("line").alias("page_text"))
    quoted = lines.groupBy("doc_id").agg(F.max("page_text").alias("snippet")).withColumn("key", F.lit(1))
    return prepare.locate_snippet(quoted, lines, "doc_id", "key").select("doc_id", "page")


@query("code_cells", r"""
SELECT o_orderkey, array_to_string(list_filter(['E' || o_orderkey, o_orderstatus, 'C-' || o_custkey], lambda x: length(x) >= 4 AND regexp_matches(x, '\d')), ' ') AS codes FROM orders""")
def code_cells(t: Tables):
    cell = F.concat(F.lit("E"), s("o_orderkey"), F.lit("<br>"), F.col("o_orderstatus"), F.lit(" / C-"), s("o_custkey"))
    return t.orders.select("o_orderkey", tx.clean_codes(cell).alias("codes"))


@query("text_languages", r"""
SELECT CASE WHEN regexp_matches(text, '[\x{3040}-\x{30ff}\x{ff66}-\x{ff9f}]') THEN 'ja' WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' ELSE 'en' END AS language,
  count(*) AS n FROM documents GROUP BY 1""")
def text_languages(t: Tables):
    return t.documents.groupBy(tx.detect_language("text").alias("language")).agg(F.count("*").alias("n"))


@query("fault_records", """
SELECT o_orderkey, 'fault_date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'machine: M' || o_custkey || ' ' || chr(10) || 'error_code: ' ||
  CASE WHEN o_orderstatus = 'F' THEN 'E' || o_orderkey ELSE '' END || chr(10) || 'symptom: ' || o_orderpriority || chr(10) || 'root_cause: ' || chr(10) || 'solution: ' || chr(10) || 'engineer: ' AS text,
  CASE WHEN o_orderstatus = 'F' THEN 'E' || o_orderkey ELSE '' END AS section_title, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS n_codes FROM orders""")
def fault_records(t: Tables):
    recs = t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("fault_date"), F.concat(F.lit("M"), s("o_custkey")).alias("machine_id"),
        F.lit(None).cast("string").alias("machine_model"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("E"), s("o_orderkey"))).alias("error_code"),
        F.col("o_orderpriority").alias("symptom"), *[F.lit(None).cast("string").alias(c) for c in ("root_cause", "solution", "engineer")])
    return readers.read_fault_records(recs).select("o_orderkey", "text", "section_title", F.size("error_codes").alias("n_codes"))


@query("sheet_rows", """
SELECT p_partkey, 'Sheet:' || p_brand || ' Row:' || (p_partkey + 2) AS section_title,
  'name: ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' | ' || p_size ELSE '' END || ' | type: ' || p_type AS text FROM part""")
def sheet_rows(t: Tables):
    p = t.part.withColumn("size", F.when(F.col("p_size") % 2 == 0, s("p_size")).otherwise(F.lit(" ")))
    return readers.rows_to_text(p, [("p_name", "name"), ("size", ""), ("p_type", "type")], F.col("p_brand"), F.col("p_partkey") + 1, ["p_partkey"])


@query("front_matter", """
SELECT c_custkey, c_name AS title, c_mktsegment || ',' || 'N' || c_nationkey AS tags, 'Account note' || chr(10) || chr(10) || 'Balance of ' || c_custkey AS body FROM customer
WHERE c_nationkey % 2 = 0 UNION ALL SELECT c_custkey, NULL, '', 'Balance of ' || c_custkey FROM customer WHERE c_nationkey % 2 = 1""")
def front_matter(t: Tables):
    front = F.concat(F.lit("---\ntitle: "), F.col("c_name"), F.lit("\ntags: ["), F.col("c_mktsegment"), F.lit(", N"), s("c_nationkey"),
                     F.lit("]\ndescription: Account note\n---\n"))
    text = F.concat(F.when(F.col("c_nationkey") % 2 == 0, front).otherwise(F.lit("")), F.lit("Balance of "), s("c_custkey"))
    return readers.parse_front_matter(t.customer.select("c_custkey", text.alias("text"))).select(
        "c_custkey", "title", F.array_join("tags", ",").alias("tags"), "body")


@query("daily_log", """
SELECT o_orderkey, 1 AS day_no, CAST(o_orderdate AS DATE) AS day, 'site ' || o_custkey || chr(10) || 'opened' AS text FROM orders
UNION ALL SELECT o_orderkey, 2, CAST(o_orderdate AS DATE) + 2, 'closed ' || o_orderstatus FROM orders""")
def daily_log(t: Tables):
    text = F.concat(F.lit("kept by the desk\n"), F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" site "), s("o_custkey"), F.lit("\nopened\n"),
                    F.date_format(F.date_add("o_orderdate", 2), "yyyy-MM-dd"), F.lit("\nclosed "), F.col("o_orderstatus"), F.lit("\n"))
    return readers.parse_daily_log(t.orders.select("o_orderkey", text.alias("text")), ["o_orderkey"]).select("o_orderkey", "day_no", "day", "text")


def code_file():
    return F.concat(F.lit("header\n#"), F.lpad(F.hex("p_size"), 2, "0"), F.lit(" H\n  "), F.col("p_name"), F.lit("\n! hidden\n  01H: first\n     more\n  02H: second\n#"),
                    F.lpad(F.hex("p_partkey"), 8, "0"), F.lit(" H\n"), F.col("p_type"), F.lit("\n"))


@query("sectioned_codes", """
SELECT p_partkey, printf('%02X', p_size) AS code, p_name AS title, 'STG-' || printf('%02X', p_size) || ' STG-' || printf('%02X', p_size) || '-01 STG-' || printf('%02X', p_size) || '-02' AS aliases FROM part
UNION ALL SELECT p_partkey, printf('%08X', p_partkey), p_type, '' FROM part""")
def sectioned_codes(t: Tables):
    files = t.part.select("p_partkey", code_file().alias("text"))
    return readers.parse_sectioned_codes(files, ["p_partkey"], controller=F.lit("STG")).select(
        "p_partkey", "code", "title", F.array_join("aliases", " ").alias("aliases"))


@query("code_definitions", """
SELECT p_partkey, printf('%02X', p_size) AS main, '01' AS detail, 'code file' AS source, p_name AS title, '01H: first' || chr(10) || 'more' AS text FROM part
UNION ALL SELECT p_partkey, printf('%02X', p_size), '7F', 'code file', p_name, NULL FROM part
UNION ALL SELECT p_partkey, 'ZZ', '01', 'not found', NULL, NULL FROM part""")
def code_definitions(t: Tables):
    files = spread(t.part, "p_partkey").select("p_partkey", F.concat(F.lit("U"), s("p_partkey")).alias("unit"), code_file().alias("text"))
    sections = od.cut_lineage(readers.parse_sectioned_codes(files, ["unit"], controller=F.lit("STG")))
    details = readers.code_details(sections, ["unit"])
    main = F.lpad(F.hex("p_size"), 2, "0")
    asked = t.part.select("p_partkey", F.concat(F.lit("U"), s("p_partkey")).alias("unit"), F.explode(F.array(
        F.struct(main.alias("main"), F.lit("01").alias("detail")), F.struct(main.alias("main"), F.lit("7F").alias("detail")),
        F.struct(F.lit("ZZ").alias("main"), F.lit("01").alias("detail")))).alias("x")).select("p_partkey", "unit", "x.*")
    return readers.lookup_code_definition(asked, sections, details, key="p_partkey").drop("unit")


@query("page_passages", r"""
SELECT CAST(doc_id AS VARCHAR) || '_1' AS passage_id, '第1页' AS section_title, length(text) AS n FROM documents
WHERE length(trim(text)) >= 20 AND NOT (regexp_matches(lower(trim(text)), 'intentionally (left )?blank') AND length(trim(text)) < 200)""")
def page_passages(t: Tables):
    return readers.pages_to_passages(t.documents.withColumn("page", F.lit(1))).select(
        "passage_id", "section_title", F.length("text").cast("long").alias("n"))


@query("tree_paths", """
SELECT 'R' || r_regionkey AS node_id, r_name AS path, 1 AS depth FROM region
UNION ALL SELECT 'N' || n_nationkey, r_name || '/' || n_name, 2 FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name NOT LIKE '%NATION_3%'
UNION ALL SELECT 'C' || c_custkey, r_name || '/' || n_name || '/' || c_name, 3 FROM customer JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE n_name NOT LIKE '%NATION_3%'""")
def tree_paths(t: Tables):
    def node(df, key, prefix, parent, parent_prefix, title):
        up = F.concat(F.lit(parent_prefix), s(parent)) if parent else F.lit(None).cast("string")
        return df.select(F.concat(F.lit(prefix), s(key)).alias("node_id"), up.alias("parent_id"), F.col(title).alias("title"))

    nodes = (node(t.region, "r_regionkey", "R", None, "", "r_name").unionByName(node(t.nation, "n_nationkey", "N", "n_regionkey", "R", "n_name"))
             .unionByName(node(t.customer, "c_custkey", "C", "c_nationkey", "N", "c_name")))
    return readers.tree_paths(nodes, exclude=["NATION_3"])


@query("block_markdown", """
WITH b AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'signup' AND value < 5 THEN '' ELSE props END AS txt FROM events),
i AS (SELECT *, sum(CASE WHEN event_type IN ('view', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM b),
n AS (SELECT *, sum(CASE WHEN event_type IN ('signup', 'click') AND txt <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS k FROM i)
SELECT user_id, event_id, CASE WHEN event_type IN ('signup', 'click') THEN k || '. ' || txt WHEN event_type = 'view' THEN txt WHEN event_type = 'purchase' THEN '- ' || txt ELSE txt END AS line
FROM n WHERE txt <> ''""")
def block_markdown(t: Tables):
    kind = (F.when(F.col("event_type").isin("signup", "click"), "ordered").when(F.col("event_type") == "view", "text")
            .when(F.col("event_type") == "purchase", "bullet").otherwise("image"))
    text = F.when((F.col("event_type") == "signup") & (F.col("value") < 5), "").otherwise(F.col("props"))
    blocks = t.events.select("user_id", "event_id", F.col("user_id").alias("parent_id"), kind.alias("block_type"), text.alias("text"),
                             F.lit(1).alias("level"), F.lit(False).alias("done"))
    return readers.blocks_to_markdown(blocks, "user_id", "event_id")


@query("replaced_documents", """
WITH n AS (SELECT doc_id, 'v2 ' || lang AS lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT lang, count(*) AS n FROM (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n) GROUP BY lang""")
def replaced_documents(t: Tables):
    docs = t.documents.select("doc_id", "lang")
    new = docs.join(t.labels.filter("quality = 0").select("doc_id"), "doc_id", "left_semi").withColumn("lang", F.concat(F.lit("v2 "), "lang"))
    return sinks.replace_documents(docs, new, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("deleted_documents", """
SELECT source, count(*) AS deleted FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY source""")
def deleted_documents(t: Tables):
    doomed = t.documents.join(t.labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("source")
    return sinks.delete_documents(t.documents.select("source", "doc_id"), doomed, "source")[1]


@query("cleared_documents", "SELECT source, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY source")
def cleared_documents(t: Tables):
    return sinks.clear(t.documents, "fr", "lang").groupBy("source").agg(F.count("*").alias("n"))


@query("noisy_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def noisy_json(t: Tables):
    noisy = t.events.select("event_id", F.concat(F.lit("Result: ["), "props", F.lit("] done")).alias("answer"))
    return readers.extract_json(noisy, "answer", "array<struct<k:int>>").select("event_id", F.explode("parsed.k").alias("k"))


@query("connection_edges", """
SELECT l_orderkey, l_linenumber, 'W' || l_suppkey AS cable, 'P' || l_partkey AS a_conn, '' AS a_mate, 'J' || l_suppkey AS b_conn, l_returnflag AS b_device, count(*) AS n FROM lineitem GROUP BY ALL""")
def connection_edges(t: Tables):
    obj = F.to_json(F.array(F.struct(
        F.concat(F.lit("W"), s("l_suppkey")).alias("cable"), F.struct(F.concat(F.lit("P"), s("l_partkey")).alias("conn")).alias("a"),
        F.struct(F.concat(F.lit("J"), s("l_suppkey")).alias("conn"), F.col("l_returnflag").alias("device")).alias("b"))))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("Here it is:\n"), obj, F.lit("\nend")).alias("answer"))
    return readers.connection_edges(rows, "answer", ["l_orderkey", "l_linenumber"]).groupBy(
        "l_orderkey", "l_linenumber", "cable", "a_conn", "a_mate", "b_conn", "b_device").agg(F.count("*").alias("n"))


@query("glossary_rows", """
SELECT 'N' || n_nationkey AS abbr, n_name AS en, 'ja' || n_nationkey || '|jb' AS ja, 'zh' AS zh, 'region ' || n_regionkey AS note FROM nation""")
def glossary_rows(t: Tables):
    lines = t.nation.select(F.col("n_nationkey").alias("ord"), F.concat(
        F.lit("n"), s("n_nationkey"), F.lit("\t"), "n_name", F.lit("\tja"), s("n_nationkey"), F.lit(" / jb\tzh\tregion "), s("n_regionkey")).alias("line"))
    return readers.glossary_senses(lines).select("abbr", "en", F.array_join("ja", "|").alias("ja"), F.array_join("zh", "|").alias("zh"), "note")


@query("labelled_sheet", """
SELECT 'C' || o_custkey AS machine, strftime(o_orderdate, '%Y-%m-%d') AS reg_date, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS error_code, 'confirmed' AS review, CAST(NULL AS VARCHAR) AS unit
FROM orders WHERE o_orderpriority <> '5-LOW'""")
def labelled_sheet(t: Tables):
    sheet = t.orders.select(
        F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.concat(F.lit("C"), s("o_custkey"))).alias("Machine No."),
        F.col("o_orderdate").alias("Date"), F.when(F.col("o_orderstatus") == "P", "—").otherwise(F.col("o_orderstatus")).alias("Error Code"))
    return readers.import_labelled_sheet(sheet, {"Machine No.": "machine", "Date": "reg_date", "Error Code": "error_code", "Unit": "unit"}, "Machine No.")


@query("guide_rows", """
WITH e AS (SELECT user_id, event_id, event_type AS k, props FROM events WHERE event_type <> 'error'),
a AS (SELECT *, sum(CASE WHEN k = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS entry_no FROM e),
b AS (SELECT *, sum(CASE WHEN k = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, entry_no ORDER BY event_id) AS named FROM a WHERE entry_no > 0),
c AS (SELECT *, sum(CASE WHEN named = 0 AND k IN ('view', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, entry_no ORDER BY event_id) AS blanks FROM b),
d AS (SELECT *, named + least(blanks, 1) AS cause_no FROM c),
f AS (SELECT *, sum(CASE WHEN k = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, entry_no, cause_no ORDER BY event_id) AS step_no FROM d),
h AS (SELECT user_id, entry_no, min(CASE WHEN k = 'signup' THEN event_id END) AS first FROM f GROUP BY ALL),
cs AS (SELECT user_id, entry_no, cause_no, coalesce(max(CASE WHEN k = 'click' THEN props END), '(no cause given)') AS cause FROM f WHERE cause_no > 0 GROUP BY ALL),
st AS (SELECT user_id, entry_no, cause_no, step_no, max(CASE WHEN k = 'view' THEN props END) AS chk, coalesce(string_agg(CASE WHEN k = 'purchase' THEN props END, '；' ORDER BY event_id), '') AS details
  FROM f WHERE cause_no > 0 AND k IN ('view', 'purchase') GROUP BY ALL)
SELECT h.user_id, CAST(h.entry_no AS BIGINT) AS entry_no, CAST(cs.cause_no AS BIGINT) AS cause_no, cs.cause, CAST(st.step_no AS BIGINT) AS step_no, st.chk AS "check", st.details
FROM h LEFT JOIN cs USING (user_id, entry_no) LEFT JOIN st ON st.user_id = h.user_id AND st.entry_no = h.entry_no AND st.cause_no = cs.cause_no""")
def guide_rows(t: Tables):
    k = F.col("event_type")
    rows = t.events.select(
        "user_id", "event_id", F.when(k == "error", "X axis").alias("axis"), F.lit(None).cast("string").alias("idx"),
        F.when(k == "signup", "5A-1C").alias("code"), F.when(k == "signup", F.col("props")).alias("name"), F.lit(None).cast("string").alias("rate"),
        F.when(k == "click", F.col("props")).alias("cause"), F.when(k == "view", F.col("props")).alias("check"),
        F.when(k == "purchase", F.col("props")).alias("details"))
    out = readers.forward_fill_hierarchy(rows, "event_id", ["user_id"])
    return out.select("user_id", "entry_no", "cause_no", "cause", "step_no", "check", "details")


@query("day_logs_detected", f"""
WITH {NATION_DAYS} SELECT log_id, CAST(1 AS DOUBLE) AS dated_share FROM (SELECT DISTINCT log_id FROM days)""")
def day_logs_detected(t: Tables):
    days = nation_days(t).withColumn("title", s("day"))
    return prepare.is_day_log(days, "log_id", "title").select("log_id", F.round("dated_share", 4).alias("dated_share"))


@query("line_positions", """
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents""")
def line_positions(t: Tables):
    return od.row_positions(t.documents.select("source", "doc_id"), ["source"], "doc_id", "pos")
