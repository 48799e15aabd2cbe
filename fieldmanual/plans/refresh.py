"""Queries over incremental sync and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldmanual.functions.questions import annotate_alarm
from fieldmanual.operators import cases as cs
from fieldmanual.operators import sync
from fieldmanual.operators.ordered import shared_path
from fieldmanual.plans.faults import access_log
from fieldmanual.plans.registry import Tables, query
from fieldmanual.streaming import streams


def s(c):
    return F.col(c).cast("string")


def listing(t: Tables):
    d = F.col("doc_id")
    return t.documents.filter(d % 10 != 0).select(d.alias("file_id"), F.when(d % 7 == 0, F.concat(F.lit("new "), "source")).otherwise(F.col("source")).alias("name"),
                                                  F.when(d % 3 == 0, F.lit(2)).otherwise(F.lit(1)).alias("version"))


def state(t: Tables):
    d = F.col("doc_id")
    return t.documents.filter(d % 9 != 0).select(d.alias("file_id"), F.col("source").alias("name"), F.lit(1).alias("version"), (d % 5).cast("int").alias("fails"), (d % 11 == 0).alias("oversize"),
                                                 F.md5("text").alias("sha"))


DIFF = """li AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 7 = 0 THEN 'new ' || source ELSE source END AS name, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 10 <> 0),
st AS (SELECT doc_id AS file_id, source AS name, 1 AS version, doc_id % 5 AS fails, doc_id % 11 = 0 AS oversize, text FROM documents WHERE doc_id % 9 <> 0),
df AS (SELECT coalesce(l.file_id, s.file_id) AS file_id, CASE WHEN s.file_id IS NULL THEN 'new' WHEN l.file_id IS NULL THEN 'deleted' WHEN l.version <> s.version THEN 'changed' WHEN fails >= 3 THEN 'gave_up'
  WHEN fails > 0 OR oversize THEN 'retry' ELSE 'unchanged' END AS action, coalesce(l.name <> s.name, false) AS renamed FROM li l FULL JOIN st s ON l.file_id = s.file_id)"""


@query("snapshot_diff", f"WITH {DIFF} SELECT file_id, action, renamed FROM df")
def snapshot_diff(t: Tables):
    return sync.diff_snapshots(listing(t), state(t)).select("file_id", "action", "renamed")


@query("same_content", f"WITH {DIFF} SELECT CASE WHEN action = 'changed' AND file_id % 2 = 0 THEN 'same_content' ELSE action END AS action, count(*) AS n FROM df GROUP BY 1")
def same_content(t: Tables):
    d = F.col("doc_id")
    new = t.documents.select(d.alias("file_id"), F.md5(F.when(d % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!")))).alias("sha"))
    return sync.same_content(sync.diff_snapshots(listing(t), state(t)), new, state(t)).groupBy("action").agg(F.count("*").alias("n"))


@query("guarded_deletes", f"WITH {DIFF}, n AS (SELECT count_if(action = 'deleted') AS d FROM df) SELECT CASE WHEN action = 'deleted' AND d > 20 THEN 'delete_held' ELSE action END AS action, count(*) AS n FROM df, n GROUP BY 1")
def guarded_deletes(t: Tables):
    return sync.guard_deletes(sync.diff_snapshots(listing(t), state(t))).groupBy("action").agg(F.count("*").alias("n"))


@query("directory_types", "SELECT source, CASE WHEN source LIKE 'src1%' THEN 'manual' WHEN source LIKE 'src2%' THEN 'log' ELSE 'other' END AS doc_type, source NOT LIKE 'src2%' AS sync, count(*) AS n FROM documents GROUP BY ALL")
def directory_types(t: Tables):
    m = sync.map_directory("source", [("src1", "manual", True), ("src2", "log", False)])
    return t.documents.groupBy("source", m["doc_type"].alias("doc_type"), m["sync"].alias("sync")).agg(F.count("*").alias("n"))


@query("skip_reasons", r"SELECT CASE WHEN contains(lower(source), 'src7') THEN 'path' WHEN lang = 'fr' THEN 'title' WHEN regexp_matches(lang, '^d') THEN 'title rule' WHEN n_chars > 3000 THEN 'too large' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def skip_reasons(t: Tables):
    d = t.documents.withColumn("kind", F.lit("text"))
    reason = sync.skip_reason("source", "lang", "kind", "n_chars", ["SRC7"], ["fr"], ["^d"], ["video"], {"text": 3000})
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("pending_manifest", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))")
def pending_manifest(t: Tables):
    m = t.documents.select("doc_id", F.md5("text").alias("sha"))
    return sync.pending_manifest(m, m.join(t.labels.select("doc_id"), "doc_id")).select("doc_id")


@query("missing_documents", "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def missing_documents(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("name"), "lang")
    return sync.missing_documents(d, t.labels.select(F.col("doc_id").alias("name"))).groupBy("lang").agg(F.count("*").alias("n"))


@query("repaired_paths", """WITH f AS (SELECT p_name AS doc_name, p_brand || '/' || p_partkey AS file_path FROM part WHERE p_size > 48), n AS (SELECT doc_name, count(*) AS n, min(file_path) AS p FROM f GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size > 48 THEN 'ok' WHEN n.n IS NULL THEN 'no file of that name' WHEN n.n > 1 THEN 'several files of that name' ELSE 'repaired' END AS result,
  CASE WHEN p_size <= 48 AND n.n = 1 THEN n.p ELSE p_brand || '/' || p_partkey END AS new_path FROM part LEFT JOIN n ON n.doc_name = p_name""")
def repaired_paths(t: Tables):
    meta = t.part.select("p_partkey", "p_size", F.col("p_name").alias("doc_name"), F.concat("p_brand", F.lit("/"), s("p_partkey")).alias("file_path"))
    return sync.repair_paths(meta, meta.filter("p_size > 48").select("doc_name", "file_path")).select("p_partkey", "result", "new_path")


@query("stale_documents", """WITH m AS (SELECT o_custkey AS doc_id, max(o_orderdate) AS t FROM orders GROUP BY 1), i AS (SELECT c_custkey AS doc_id, TIMESTAMP '1998-01-01' AS x FROM customer WHERE c_custkey % 3 > 0)
SELECT m.doc_id FROM m LEFT JOIN i USING (doc_id) WHERE x IS NULL OR t > x""")
def stale_documents(t: Tables):
    meta = t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderdate").alias("ingested_at"))
    done = t.customer.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("doc_id"), F.lit("1998-01-01").cast("timestamp_ntz").alias("indexed_at"))
    return sync.stale_documents(meta, done).select("doc_id")


@query("resolved_titles", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '.doc' WHEN p_type = 'SMALL' THEN p_name || '.pdf' ELSE p_name END AS title FROM part")
def resolved_titles(t: Tables):
    title = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(".doc"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", sync.resolve_title(title, "p_type", {"SMALL": ".pdf"}).alias("title"))


@query("wiki_nodes", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'day_log' WHEN o_orderpriority = '2-HIGH' THEN 'skip' WHEN o_orderstatus = 'F' THEN 'sop' ELSE 'manual' END AS kind FROM orders""")
def wiki_nodes(t: Tables):
    pri = F.col("o_orderpriority")
    text = F.when(pri == "1-URGENT", F.concat(F.lit("log\n"), F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" x"))).otherwise("short")
    kind = sync.classify_wiki_node(F.concat(F.lit("Worklog "), "o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "a/SOP").otherwise("a/b"), text, pri == "2-HIGH", ["worklog"], "SOP")
    return t.orders.select("o_orderkey", kind.alias("kind"))


@query("throttled_events", """
WITH RECURSIVE e AS (SELECT event_id, user_id % 3 AS k, epoch_us(ts) AS us, event_type = 'error' AS fail, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT k, i, event_id, us AS last, true AS kept FROM e WHERE i = 1
  UNION ALL SELECT e.k, e.i, e.event_id, CASE WHEN e.fail OR e.us - w.last >= 1800000000 THEN e.us ELSE w.last END, e.fail OR e.us - w.last >= 1800000000 FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1)
SELECT event_id FROM w WHERE kept""")
def throttled_events(t: Tables):
    """Three busy keys with a half-hour rule, so that keys span many blocks."""
    log = access_log(t).withColumn("key", F.col("uid") % 3)
    return streams.throttle_events(log, ["key"], 1800).select(F.col("id").alias("event_id"))


@query("event_occurrences", """WITH d AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, lag(day) OVER (PARTITION BY user_id, event_type ORDER BY day) AS b FROM d)
SELECT user_id, event_type, day AS occ_start FROM g WHERE b IS NULL OR day - b > 3""")
def event_occurrences(t: Tables):
    rows = t.events.select("user_id", "event_type", F.lit("").alias("site"), F.to_date("ts").alias("day"))
    return cs.occurrences(rows, ["user_id", "event_type"])


@query("latest_day_texts", "SELECT user_id AS log_id, CAST(ts AS DATE) AS day, arg_max(props, ts) AS text FROM events GROUP BY ALL")
def latest_day_texts(t: Tables):
    d = t.events.select(F.col("user_id").alias("log_id"), F.to_date("ts").alias("day"), F.col("props").alias("text"), F.col("ts").alias("batch"))
    return streams.latest_day_text(d)


@query("late_repairs", """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS b FROM d)
SELECT user_id, day AS occ_start FROM g WHERE (b IS NULL OR day - b > 3) AND day > DATE '2024-01-10'""")
def late_repairs(t: Tables):
    rows = t.events.select("user_id", F.to_date("ts").alias("day"))
    streamed = cs.occurrences(rows.withColumn("site", F.lit("")), ["user_id"]).filter("occ_start <= date '2024-01-10'")
    return streams.reconcile_occurrences(streamed, rows, ["user_id"]).select("user_id", "occ_start")


@query("streamed_occurrences", """WITH a AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id % 97 = 0 AND CAST(ts AS DATE) <= DATE '2024-01-10' AS late FROM events),
g AS (SELECT *, lag(day) OVER (PARTITION BY user_id, event_type ORDER BY day) AS b FROM (SELECT DISTINCT user_id, event_type, day FROM a)),
o AS (SELECT *, lag(day) OVER (PARTITION BY user_id, event_type ORDER BY day) AS b FROM (SELECT DISTINCT user_id, event_type, day FROM a WHERE NOT late)),
n AS (SELECT *, sum(CASE WHEN b IS NULL OR day - b > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY day) AS no FROM o),
s AS (SELECT user_id, event_type, min(day) AS day FROM n GROUP BY user_id, event_type, no HAVING (SELECT max(day) FROM o) - max(day) >= 5)
SELECT g.user_id, g.event_type, g.day AS occ_start, s.day IS NOT NULL AS streamed FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.event_type = g.event_type AND s.day = g.day WHERE g.b IS NULL OR g.day - g.b > 3""")
def streamed_occurrences(t: Tables):
    """Events arrive as files in three periods, each followed by one run of the stream, then late rows of the first period.

    Sessions of days, closed after three days without a row (84 hours on whole days); what the watermark dropped or did
    not close yet is repaired from all events.
    """
    keys, day = ["user_id", "event_type"], F.to_date("ts")
    base = shared_path(t.spark, f"stream-{uuid.uuid4().hex}")
    rows = t.events.select(*keys, F.date_trunc("day", "ts").cast("timestamp").alias("ts"), ((F.col("event_id") % 97 == 0) & (day <= F.lit("2024-01-10"))).alias("late"))
    periods = (day <= F.lit("2024-01-10"), day.between("2024-01-11", "2024-01-20"), day > F.lit("2024-01-20"))
    for part in (*[rows.filter(p & ~F.col("late")) for p in periods], rows.filter("late")):
        part.drop("late").write.mode("append").parquet(f"{base}/in")
        source = t.spark.readStream.schema(part.drop("late").schema).parquet(f"{base}/in")
        streams.write_batches(streams.stream_occurrences(source, "84 hours", keys=keys), f"{base}/out", f"{base}/state").awaitTermination()
    streamed = t.spark.read.parquet(f"{base}/out").select(*keys, "occ_start")
    repairs = streams.reconcile_occurrences(streamed, rows.select(*keys, day.alias("day")), keys)
    return streams.settle_occurrences(streamed, repairs, keys)


@query("annotated_alarms", """SELECT o_orderkey, 'STG - E Detail: 607304' || upper(lpad(printf('%x', o_orderkey % 256), 2, '0')) || ' FFF0FE17 (STG-' || upper(lpad(printf('%x', o_orderkey % 256), 2, '0')) || '-17)' AS text FROM orders""")
def annotated_alarms(t: Tables):
    raw = F.concat(F.lit("STG - E Detail: 607304"), F.lpad(F.hex(F.col("o_orderkey") % 256), 2, "0"), F.lit(" FFF0FE17"))
    return t.orders.select("o_orderkey", annotate_alarm(raw).alias("text"))
