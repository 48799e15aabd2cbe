"""Queries over access control and family tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmanual.functions import equipment as eq
from fieldmanual.operators import access, lexical, tagging
from fieldmanual.operators.ordered import cut_lineage
from fieldmanual.plans.registry import Tables, query
from fieldmanual.plans.search import P, Q, asked, like_sql, passages

NOW = "1998-01-01"
PRINCIPAL = {"uid": "7", "role": "manager", "clearance": 3, "categories": ["F", "O"], "models": ["M1", "M2", "COMMON"], "customers": ["4"]}


def s(c):
    return F.col(c).cast("string")


def users(t: Tables):
    role = F.element_at(F.array(*[F.lit(r) for r in ("trainee", "engineer", "manager", "kb_admin", "auditor")]), F.col("c_nationkey") % 5 + 1)
    return t.customer.select(F.col("c_custkey").alias("uid"), role.alias("role"), (F.col("c_custkey") % 5).cast("int").alias("clearance"),
                             F.when(F.col("c_mktsegment") == "FURNITURE", "left").otherwise("active").alias("status"))


def scopes(t: Tables):
    k = F.col("o_orderkey") % 4
    scope = (F.when(k == 0, F.concat(F.lit("cat:"), "o_orderstatus")).when(k == 1, F.concat(F.lit("model:M"), F.substring("o_orderpriority", 1, 1)))
             .when(k == 2, F.concat(F.lit("customer:"), (F.col("o_custkey") % 10).cast("string"))).otherwise(F.lit("cat:P")))
    return t.orders.select(F.col("o_custkey").alias("uid"), scope.alias("scope"), F.col("o_orderdate").alias("valid_until"))


def acl(t: Tables):
    p = F.col("p_partkey")
    return t.part.select(
        p.alias("doc_id"), F.concat("p_brand", F.lit("-"), "p_type").alias("filename"), (F.col("p_size") % 5).cast("int").alias("sec_level"),
        F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (p % 3 + 1).cast("int")).alias("category"),
        F.when(F.col("p_type") == "SMALL", "pending").otherwise("approved").alias("review_status"),
        F.array(F.when(p % 7 == 0, "ALL").otherwise(F.concat(F.lit("M"), (F.col("p_size") % 5 + 1).cast("string")))).alias("models"),
        F.when(p % 4 > 0, "none").otherwise((p % 10).cast("string")).alias("customer"),
        F.when(p % 5 == 0, "person").otherwise("auto").alias("classified_by"), F.lit("internal").alias("owner_scope"))


USERS = """us AS (SELECT c_custkey AS uid, ['trainee', 'engineer', 'manager', 'kb_admin', 'auditor'][c_nationkey % 5 + 1] AS role, c_custkey % 5 AS clearance,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'left' ELSE 'active' END AS status FROM customer)"""
SCOPES = """sc AS (SELECT o_custkey AS uid, CASE o_orderkey % 4 WHEN 0 THEN 'cat:' || o_orderstatus WHEN 1 THEN 'model:M' || substr(o_orderpriority, 1, 1)
  WHEN 2 THEN 'customer:' || (o_custkey % 10) ELSE 'cat:P' END AS scope, o_orderdate AS valid_until FROM orders)"""
ACL = """acl AS (SELECT p_partkey AS doc_id, p_brand || '-' || p_type AS filename, p_size % 5 AS sec_level, ['F', 'O', 'P'][p_partkey % 3 + 1] AS category,
  CASE WHEN p_type = 'SMALL' THEN 'pending' ELSE 'approved' END AS review_status, CASE WHEN p_partkey % 7 = 0 THEN 'ALL' ELSE 'M' || (p_size % 5 + 1) END AS model,
  CASE WHEN p_partkey % 4 > 0 THEN 'none' ELSE CAST(p_partkey % 10 AS VARCHAR) END AS customer, CASE WHEN p_partkey % 5 = 0 THEN 'person' ELSE 'auto' END AS classified_by FROM part)"""
PRINCIPALS = f"""{USERS}, {SCOPES}, lv AS (SELECT * FROM sc WHERE valid_until > TIMESTAMP '{NOW}'),
pc AS (SELECT uid, substr(scope, 5) AS cat FROM lv WHERE scope LIKE 'cat:%' UNION SELECT uid, 'customer_deliverable' FROM lv WHERE scope LIKE 'customer:%'),
pm AS (SELECT DISTINCT uid, substr(scope, 7) AS model FROM lv WHERE scope LIKE 'model:%'), pk AS (SELECT DISTINCT uid, substr(scope, 10) AS cust FROM lv WHERE scope LIKE 'customer:%'),
pr AS (SELECT uid, role, least(clearance, CASE role WHEN 'trainee' THEN 2 WHEN 'engineer' THEN 3 WHEN 'manager' THEN 4 WHEN 'kb_admin' THEN 4 ELSE 0 END) AS clearance FROM us WHERE status = 'active')"""
SEES = """(review_status = 'approved' AND {cl} >= sec_level AND {cat} AND {mod} AND (customer = 'none' OR {cust}))"""
FIXED = SEES.format(cl="3", cat="category IN ('F', 'O')", mod="(model IN ('ALL', 'M1', 'M2'))", cust="customer IN ('4')")


@query("principals", f"""WITH {PRINCIPALS}
SELECT uid, role, clearance, coalesce((SELECT string_agg(cat, ',' ORDER BY cat) FROM pc WHERE pc.uid = pr.uid), '') AS categories,
  coalesce((SELECT string_agg(model, ',' ORDER BY model) FROM pm WHERE pm.uid = pr.uid), 'ALL') AS models,
  coalesce((SELECT string_agg(cust, ',' ORDER BY cust) FROM pk WHERE pk.uid = pr.uid), '') AS customers,
  (SELECT strftime(max(valid_until), '%Y-%m-%d') FROM lv WHERE lv.uid = pr.uid) AS latest_expiry, 'active' AS status FROM pr""")
def principals(t: Tables):
    return access.list_principals(users(t), scopes(t), F.lit(NOW).cast("timestamp_ntz")).withColumn(
        "latest_expiry", F.date_format("latest_expiry", "yyyy-MM-dd"))


@query("visible_counts", f"""WITH {PRINCIPALS}, {ACL},
sees AS (SELECT pr.uid, count(*) AS n FROM pr JOIN acl ON review_status = 'approved' AND clearance >= sec_level
  AND EXISTS (SELECT 1 FROM pc WHERE pc.uid = pr.uid AND cat = category)
  AND (NOT EXISTS (SELECT 1 FROM pm WHERE pm.uid = pr.uid) OR EXISTS (SELECT 1 FROM pm WHERE pm.uid = pr.uid AND pm.model = acl.model))
  AND (customer = 'none' OR EXISTS (SELECT 1 FROM pk WHERE pk.uid = pr.uid AND cust = customer)) WHERE role NOT IN ('kb_admin', 'auditor') GROUP BY pr.uid)
SELECT uid, CASE WHEN role = 'kb_admin' THEN (SELECT count(*) FROM acl) ELSE coalesce(n, 0) END AS visible_docs FROM pr LEFT JOIN sees USING (uid)""")
def visible_counts(t: Tables):
    p = access.load_principals(users(t), scopes(t), F.lit(NOW).cast("timestamp_ntz"))
    return access.visible_counts(acl(t), p)


@query("visible_documents", f"WITH {ACL} SELECT doc_id FROM acl WHERE {FIXED}")
def visible_documents(t: Tables):
    return access.secure(t.part.select(F.col("p_partkey").alias("doc_id")), acl(t), PRINCIPAL)


@query("secured_search", f"""WITH {ACL}, {Q}, {P}, {like_sql(limit=3, where=f"seq IN (SELECT doc_id FROM acl WHERE {FIXED})")} SELECT * FROM like_hits""")
def secured_search(t: Tables):
    p = passages(t)
    seen = access.secure(p.select(F.col("seq").alias("doc_id")), acl(t), PRINCIPAL).withColumnRenamed("doc_id", "seq")
    return lexical.search_like(p, asked(t), limit=3, visible=seen)


@query("visibility_reasons", f"""WITH {ACL}, r AS (SELECT doc_id, {FIXED} AS visible, concat_ws('；', CASE WHEN review_status <> 'approved' THEN 'not approved' END,
  CASE WHEN sec_level > 3 THEN 'level too high' END, CASE WHEN category = 'P' THEN 'category not granted' END, CASE WHEN model NOT IN ('ALL', 'M1', 'M2') THEN 'model not granted' END,
  CASE WHEN customer NOT IN ('none', '4') THEN 'customer not granted' END) AS reasons FROM acl) SELECT visible, reasons, count(*) AS n FROM r GROUP BY ALL""")
def visibility_reasons(t: Tables):
    return access.explain_visibility(acl(t), PRINCIPAL).groupBy("visible", "reasons").agg(F.count("*").alias("n"))


def classified(t: Tables):
    rules = [(F.col("source") == "src0", (1, "public", "approved", "manual")), (F.col("text").contains("tion") & (F.col("lang") == "en"), (2, "internal", "approved", "note")),
             (F.col("lang") == "fr", (3, "customer:acme", "approved", "delivery"))]
    return access.classify_documents(t.documents, rules)


CLASSIFIED = """cl AS (SELECT doc_id, source, CASE WHEN source = 'src0' THEN 1 WHEN contains(text, 'tion') AND lang = 'en' THEN 2 WHEN lang = 'fr' THEN 3 ELSE 4 END AS sec_level FROM documents)"""


@query("classified_documents", f"""WITH {CLASSIFIED} SELECT sec_level, ['public', 'internal', 'customer:acme', 'restricted'][sec_level] AS owner_scope,
  ['manual', 'note', 'customer_delivery', 'other'][sec_level] AS category, CASE WHEN sec_level = 3 THEN 'acme' ELSE 'none' END AS customer, count(*) AS n FROM cl GROUP BY ALL""")
def classified_documents(t: Tables):
    cat = access.category_of("source_class", "lang", {("manual", "*"): "manual", ("note", "en"): "note", ("delivery", "*"): "customer_delivery"})
    return classified(t).groupBy("sec_level", "owner_scope", cat.alias("category"), access.customer_of("owner_scope").alias("customer")).agg(F.count("*").alias("n"))


@query("applied_classification", f"""WITH {CLASSIFIED}, {ACL}
SELECT coalesce(a.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NOT NULL AND coalesce(a.classified_by, 'auto') = 'auto' THEN c.sec_level ELSE a.sec_level END AS sec_level,
  CASE WHEN c.doc_id IS NOT NULL AND coalesce(a.classified_by, 'auto') = 'auto' THEN 'auto' ELSE a.classified_by END AS classified_by FROM acl a FULL JOIN cl c ON c.doc_id = a.doc_id""")
def applied_classification(t: Tables):
    return access.apply_classification(acl(t), classified(t).select("doc_id", "sec_level"), ["sec_level"])


@query("strictest_names", f"""WITH {ACL}, r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY sec_level DESC, review_status <> 'approved' DESC, doc_id DESC) AS n FROM acl)
SELECT filename, sec_level, review_status, category FROM r WHERE n = 1""")
def strictest_names(t: Tables):
    return access.strictest_per_name(acl(t), "filename", ["sec_level", "review_status", "category"])


@query("document_rows", f"""WITH {ACL} SELECT filename, min(sec_level) AS sec_level, max(category) AS category, max(model) AS models, max(customer) AS customer,
  max(review_status) AS review_status, count(*) AS n_ids FROM acl WHERE contains(lower(filename), 'brand#1') GROUP BY filename HAVING max(category) = 'P'""")
def document_rows(t: Tables):
    return access.list_documents(acl(t), category="P", keyword="brand#1")


@query("visibility_changes", f"""WITH {PRINCIPALS}, {ACL}, bf AS (SELECT DISTINCT uid, filename FROM pc JOIN acl ON category = cat), af AS (SELECT DISTINCT uid, filename FROM pc JOIN acl ON category = cat WHERE review_status = 'approved'
  UNION SELECT DISTINCT uid, 'guide' FROM pk)
SELECT uid, count_if(b.filename IS NULL) AS extra, count_if(a.filename IS NULL) AS missing, count_if(b.filename IS NULL) = 0 AND count_if(a.filename IS NULL) = 0 AS same
FROM bf b FULL JOIN af a USING (uid, filename) GROUP BY uid""")
def visibility_changes(t: Tables):
    live = scopes(t).filter(F.col("valid_until") > F.lit(NOW).cast("timestamp_ntz")).groupBy("uid").agg(F.collect_set("scope").alias("s"))
    # Users of equal grants reach equal files, so files are compared once per combination of grants; a null user's match nothing.
    every = live.select(F.col("uid").alias("__uid"), access.parse_grants("s").alias("g")).select("__uid", "g", F.when(F.col("__uid").isNotNull(), F.to_json(F.struct(
        "g.categories", (F.size("g.customers") > 0).alias("any")))).alias("uid"))
    every = cut_lineage(every)
    g = every.groupBy("uid").agg(F.any_value("g").alias("g"))
    reach = g.select("uid", F.explode("g.categories").alias("category"))
    names = acl(t).select("category", "filename", "review_status").distinct()
    before = reach.join(names, "category").select("uid", "filename")
    after = reach.join(names.filter("review_status = 'approved'"), "category").select("uid", "filename").unionByName(
        g.filter(F.size("g.customers") > 0).select("uid", F.lit("guide").alias("filename")))
    found = access.compare_visibility(before, after).withColumnRenamed("uid", "__class")
    return every.join(found, F.col("uid").eqNullSafe(F.col("__class"))).select(F.col("__uid").alias("uid"), "extra", "missing", "same")


@query("migrated_grants", f"""WITH {SCOPES}, g AS (SELECT uid, CASE WHEN scope LIKE 'customer:%' THEN 'cust:' || substr(scope, 10) ELSE scope END AS scope, valid_until FROM sc
  UNION ALL SELECT uid, 'cat:customer_deliverable', valid_until FROM sc WHERE scope LIKE 'customer:%')
SELECT uid, scope, strftime(max(valid_until), '%Y-%m-%d') AS valid_until FROM g GROUP BY uid, scope""")
def migrated_grants(t: Tables):
    return access.migrate_grants(scopes(t)).withColumn("valid_until", F.date_format("valid_until", "yyyy-MM-dd"))


@query("bulk_update", f"""WITH {ACL}, n AS (SELECT DISTINCT filename FROM acl WHERE sec_level = 4)
SELECT doc_id, CASE WHEN filename IN (SELECT filename FROM n) THEN 'x' ELSE customer END AS customer, CASE WHEN filename IN (SELECT filename FROM n) THEN 'customer:x' ELSE 'internal' END AS owner_scope,
  CASE WHEN filename IN (SELECT filename FROM n) THEN 'ALL' ELSE model END AS models, CASE WHEN filename IN (SELECT filename FROM n) THEN 'u1' ELSE classified_by END AS classified_by FROM acl""")
def bulk_update(t: Tables):
    out = access.bulk_update(acl(t), acl(t).filter("sec_level = 4").select("filename"), "u1", customer="x", models=[])
    return out.select("doc_id", "customer", "owner_scope", F.array_join("models", ",").alias("models"), "classified_by")


@query("filtered_listing", f"WITH {ACL} SELECT DISTINCT p_brand || '-' || p_type AS filename, p_size FROM part WHERE p_brand || '-' || p_type IN (SELECT filename FROM acl WHERE {FIXED})")
def filtered_listing(t: Tables):
    listing = t.part.select(F.concat("p_brand", F.lit("-"), "p_type").alias("filename"), "p_size").distinct()
    return access.filter_listing(listing, acl(t), PRINCIPAL)


@query("fail_closed_names", f"WITH {ACL} SELECT d.doc_id AS filename, coalesce(a.sec_level, 4) AS sec_level, coalesce(a.review_status, 'pending') AS review_status FROM documents d LEFT JOIN acl a ON a.doc_id = d.doc_id AND a.doc_id % 2 = 0")
def fail_closed_names(t: Tables):
    known = acl(t).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("filename"), "sec_level", "review_status")
    return access.fail_closed_missing(t.documents.select(F.col("doc_id").alias("filename")), known)


# Family tags ---------------------------------------------------------------------------------------

RULES = [("T", "tion"), ("E", "err"), ("W", "wh")]


@query("text_families", """SELECT doc_id, concat_ws(',', CASE WHEN contains(text, 'tion') THEN 'T' END, CASE WHEN contains(text, 'err') THEN 'E' END, CASE WHEN contains(text, 'wh') THEN 'W' END) AS families FROM documents""")
def text_families(t: Tables):
    return t.documents.select("doc_id", F.array_join(eq.families("text", RULES), ",").alias("families"))


@query("path_families", """SELECT c_custkey, CASE WHEN n_nationkey = 3 THEN 'COMMON' WHEN n_nationkey % 5 = 1 THEN 'X' WHEN n_regionkey = 2 THEN 'R2' WHEN c_mktsegment LIKE '%BUILD%' THEN 'BLD' ELSE 'none' END AS family
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def path_families(t: Tables):
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    path = F.concat_ws("/", F.concat(F.lit("region"), s("n_regionkey")), F.when(F.col("n_nationkey") % 5 == 1, "five").otherwise("other"), "n_name", "c_mktsegment")
    return c.select("c_custkey", eq.infer_from_path(path, "c_mktsegment", {"region2": "R2", "five": "X"}, [("BLD", "BUILD")], ["NATION_3"], "none").alias("family"))


@query("content_families", """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, 'tion')) AS a, len(regexp_extract_all(text, 'err')) AS b, len(regexp_extract_all(text, 'wh')) AS c, lang FROM documents)
SELECT doc_id, CASE WHEN lang LIKE '%tion%' THEN 'T' ELSE concat_ws(',', CASE WHEN a >= 3 AND a >= greatest(a, b, c) * 0.3 THEN 'T' END, CASE WHEN b >= 3 AND b >= greatest(a, b, c) * 0.3 THEN 'E' END,
  CASE WHEN c >= 3 AND c >= greatest(a, b, c) * 0.3 THEN 'W' END) END AS families FROM c""")
def content_families(t: Tables):
    return t.documents.select("doc_id", F.array_join(eq.infer_from_content("lang", "text", RULES), ",").alias("families"))


@query("file_families", """SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS families FROM documents GROUP BY source""")
def file_families(t: Tables):
    return tagging.infer_multi(t.documents, "source", F.col("lang")).select("source", F.array_join("families", ",").alias("families"))


@query("normalized_tags", """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'M1,M2' ELSE upper(p_type) END || CASE WHEN p_type = 'LARGE' THEN '' ELSE ',LARGE' END AS tags FROM part""")
def normalized_tags(t: Tables):
    return t.part.select("p_partkey", F.array_join(eq.normalize_tags(F.concat(F.lower("p_type"), F.lit(" ;"), F.lit("large")), {"small": ["M1", "M2"]}), ",").alias("tags"))


@query("model_factors", """WITH a AS (SELECT p_partkey, p_size % 5 AS m FROM part)
SELECT p_partkey, m IN (0, 1) AS matches, CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS named, CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 ELSE 0.5 END::DOUBLE AS unnamed FROM a""")
def model_factors(t: Tables):
    m = F.col("p_size") % 5
    tags = F.when(m == 0, F.array(F.lit("COMMON"))).otherwise(F.array(F.concat(F.lit("M"), m.cast("string"))))
    d = t.part.select("p_partkey", tags.alias("tags"), F.array(F.lit("M1")).alias("want"), F.array().cast("array<string>").alias("none"))
    order = ["M1", "M2", "M3", "M4"]
    return d.select("p_partkey", eq.matches_models("tags", "want").alias("matches"), F.round(eq.model_factor("tags", "want", order), 4).alias("named"),
                    F.round(eq.model_factor("tags", "none", order), 4).alias("unnamed"))


@query("retagged_documents", """SELECT new_tags, count(*) AS n FROM (SELECT lang AS old, CASE WHEN contains(text, 'err') THEN lang || ',zz' ELSE lang END AS new_tags FROM documents WHERE source <> 'src0') WHERE old <> new_tags GROUP BY new_tags""")
def retagged_documents(t: Tables):
    now = t.documents.select("doc_id", "source", F.array("lang").alias("families"))
    new = t.documents.select("doc_id", F.when(F.col("text").contains("err"), F.array("lang", F.lit("zz"))).otherwise(F.array("lang")).alias("families"))
    return tagging.tag_counts(tagging.retag_diff(now, new, "doc_id", F.col("source") == "src0"))


@query("primary_models", f"WITH {ACL} SELECT filename, CASE WHEN max(model) = 'ALL' THEN 'COMMON' ELSE max(model) END AS primary_model FROM acl GROUP BY filename")
def primary_models(t: Tables):
    return tagging.primary_model(acl(t))
