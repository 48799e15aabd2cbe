"""Queries over search, vectors, questions and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmanual.functions import questions as qs
from fieldmanual.functions import text as tx
from fieldmanual.operators import fusion, lexical, retrieve, tokens, vectors
from fieldmanual.operators.ordered import cut_lineage, top_k
from fieldmanual.operators.search_index import SearchIndex
from fieldmanual.plans.registry import Tables, query, stored_index


def s(c):
    return F.col(c).cast("string")


def asked(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def passages(t: Tables):
    return t.documents.select(F.col("doc_id").alias("seq"), "text", "source", "lang")


def text_index(t: Tables):
    """The stored index over the text of all passages, with their source and language as further columns."""
    return stored_index(t, "passages", passages(t))


TERMS = r"""list_distinct(list_filter(string_split_regex(regexp_replace({c}, '["*()]', ' ', 'g'), '\s+'), lambda x: x <> ''))"""
Q = "q AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
P = "p AS (SELECT doc_id AS seq, text, source, lang FROM documents)"


def like_sql(hay: str = "text", limit: int = 8, where: str = "true") -> str:
    """Rows of the LIKE search over ctes q and p."""
    return rf"""lq AS (SELECT query_id, {TERMS.format(c='question')} AS terms FROM q),
lh AS (SELECT query_id, seq, CAST(-list_sum(list_transform(terms, lambda x: (length(text) - length(replace(text, x, ''))) // length(x))) AS BIGINT) AS score
  FROM lq JOIN p ON {where} AND len(terms) > 0 AND len(list_filter(terms, lambda x: NOT contains(lower({hay}), lower(x)))) = 0),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, seq) AS rank FROM lh),
like_hits AS (SELECT query_id, seq, score, rank FROM lr WHERE rank <= {limit})"""


def bm25_sql(limit: int = 8, where: str = "true", n: str = "") -> str:
    """Rows of the Okapi search over ctes q and p."""
    return rf"""bq{n} AS (SELECT query_id, list_distinct(list_transform({TERMS.format(c='question')}, lambda x: lower(x))) AS terms FROM q{n}),
bh{n} AS (SELECT query_id, seq, lower(text) AS t, greatest(length(text) - 2, 0) AS len, terms
  FROM bq{n} JOIN p ON {where} AND len(terms) > 0 AND len(list_filter(terms, lambda x: NOT contains(lower(text), x))) = 0),
bt{n} AS (SELECT query_id, seq, t, len, unnest(terms) AS term FROM bh{n}),
bd{n} AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT term FROM bt{n}) JOIN p ON contains(lower(text), term) GROUP BY term),
bs{n} AS (SELECT count(*) AS n_passages, avg(greatest(length(text) - 2, 0)) AS avg_len FROM p),
bx{n} AS (SELECT query_id, seq, -round(sum(greatest(ln((n_passages - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM (SELECT b.*, (length(t) - length(replace(t, term, ''))) // length(term) AS tf FROM bt{n} b) JOIN bd{n} USING (term), bs{n} GROUP BY ALL),
bm25_hits{n} AS (SELECT query_id, seq, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, seq) AS rank FROM bx{n}) WHERE rank <= {limit})"""


@query("trigram_index", r"""
SELECT gram, count(*) AS n_passages, CAST(sum(tf) AS BIGINT) AS total FROM (
  SELECT gram, seq, count(*) AS tf FROM (SELECT doc_id AS seq, unnest(list_transform(range(1, CAST(length(text) - 1 AS BIGINT)), lambda i: substr(lower(text), i, 3))) AS gram FROM documents) GROUP BY ALL) GROUP BY gram""")
def trigram_index(t: Tables):
    return lexical.build_trigram_index(passages(t)).groupBy("gram").agg(F.count("*").alias("n_passages"), F.sum("tf").alias("total"))


@query("search_like", f"WITH {Q}, {P}, {like_sql()} SELECT * FROM like_hits")
def search_like(t: Tables):
    return lexical.search_like(None, asked(t), index=text_index(t))


@query("search_bm25", f"WITH {Q}, {P}, {bm25_sql()} SELECT query_id, seq, round(score, 4) AS score FROM bm25_hits")
def search_bm25(t: Tables):
    return lexical.search_bm25(None, asked(t), index=text_index(t)).select("query_id", "seq", F.round("score", 4).alias("score"))


def source_questions(t: Tables):
    return t.documents.select(F.col("source").alias("query_id"), F.concat(F.lit("the "), "source").alias("question")).distinct()


@query("search_fallback", f"""
WITH q AS (SELECT DISTINCT source AS query_id, 'the ' || source AS question FROM documents), {P}, {like_sql("text || chr(10) || source || chr(10) || lang")}
SELECT query_id, seq, CAST(score AS DOUBLE) AS score, rank, 'like' AS method FROM like_hits""")
def search_fallback(t: Tables):
    cols = ["text", "source", "lang"]
    return lexical.search_with_fallback(None, source_questions(t), index=text_index(t), cols=cols, like_index=stored_index(t, "passages", passages(t), cols))


LONGEST = r"""WITH w AS (SELECT item_id, unnest(string_split_regex(text, '\s+')) AS w FROM benchmark),
q AS (SELECT item_id AS query_id, max(row(length(w), w))[2] AS question FROM w GROUP BY item_id)"""


@query("search_filtered", f"""WITH {Q}, {P}, {bm25_sql(where="lang = 'en' AND source <> 'src0'")} SELECT query_id, seq, round(score, 4) AS score FROM bm25_hits""")
def search_filtered(t: Tables):
    kind = (F.col("lang") == "en") & (F.col("source") != "src0")
    return lexical.search_bm25(None, asked(t), index=text_index(t), where=kind).select("query_id", "seq", F.round("score", 4).alias("score"))


@query("search_refreshed", f"""WITH {Q}, p AS (SELECT doc_id AS seq, text FROM documents WHERE lang <> 'es'), {bm25_sql()}
SELECT query_id, seq, round(score, 4) AS score FROM bm25_hits""")
def search_refreshed(t: Tables):
    """Part of the passages is indexed, the rest appended, and a language deleted again."""
    p = passages(t)
    index = SearchIndex.build(p.where("lang = 'en'"))
    index.append(p.where("lang <> 'en'"))
    index.delete(p.where("lang = 'es'"))
    return lexical.search_bm25(None, asked(t), index=index).select("query_id", "seq", F.round("score", 4).alias("score"))


@query("search_exact", f"""{LONGEST}, {P}, {bm25_sql()} SELECT query_id, seq, round(score, 4) AS score FROM bm25_hits""")
def search_exact(t: Tables):
    word = F.array_max(F.transform(F.split("question", r"\s+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    codes = asked(t).select("query_id", word.alias("code"))
    return lexical.search_exact(None, codes, index=text_index(t)).select("query_id", "seq", F.round("score", 4).alias("score"))


@query("short_ideograph_terms", r"""
SELECT item_id, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: regexp_matches(x, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]') AND length(x) < 3)) > 0 AS needs_like FROM benchmark""")
def short_ideograph_terms(t: Tables):
    return t.benchmark.select("item_id", tx.needs_like("text").alias("needs_like"))


@query("index_status", "SELECT count(*) AS passages, count(DISTINCT doc_id) AS documents FROM documents")
def index_status(t: Tables):
    return lexical.index_status(t.documents)


@query("indexed_paths", "SELECT DISTINCT source AS file_path, lang AS doc_type FROM documents WHERE source <> ''")
def indexed_paths(t: Tables):
    return lexical.indexed_paths(t.documents.select(F.col("source").alias("file_path"), F.col("lang").alias("doc_type")))


@query("team_search", f"""WITH {Q}, p AS (SELECT doc_id AS seq, text FROM documents WHERE lang = 'en'), {bm25_sql()}
SELECT query_id, seq, round(-score, 4) AS score FROM bm25_hits""")
def team_search(t: Tables):
    return lexical.team_search(passages(t).withColumnRenamed("lang", "team_id"), asked(t), "en").select(
        "query_id", "seq", F.round("score", 4).alias("score"))


@query("lexical_with_terms", rf"""
{LONGEST}, b AS (SELECT item_id AS query_id, text AS question FROM benchmark), {P},
q0 AS (SELECT query_id || '#0' AS query_id, regexp_replace(question, '[?？]', ' ', 'g') AS question FROM b), {bm25_sql(8, n="0")},
q1 AS (SELECT query_id || '#1' AS query_id, question FROM q), {bm25_sql(8, n="1")},
h AS (SELECT *, 0 AS term_order FROM bm25_hits0 UNION ALL SELECT *, 1 FROM bm25_hits1 WHERE rank <= 5)
SELECT CAST(string_split(query_id, '#')[1] AS BIGINT) AS query_id, seq, term_order, CAST(rank AS INTEGER) AS rank, term_order * 1000 + CAST(rank AS INTEGER) AS position FROM h""")
def lexical_with_terms(t: Tables):
    word = F.array_max(F.transform(F.split("question", r"\s+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    q = asked(t).withColumn("terms", F.array(word))
    return lexical.retrieve_lexical(None, q, key_terms="terms", index=text_index(t)).select("query_id", "seq", "term_order", "rank", "position")


def part_pages(t: Tables):
    text = F.format_string("%04dA2 to CN%d and A-%d or CN1", F.col("p_partkey") % 10000, F.col("p_size") + 10, F.col("p_size") + 100)
    return t.part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("page"), text.alias("text"))


PART_TOKENS = """tok AS (SELECT p_brand AS doc, p_partkey AS page, unnest([printf('%04dA2', p_partkey % 10000), 'CN' || (p_size + 10), 'A-' || (p_size + 100)]) AS token FROM part)"""


@query("token_index", f"WITH {PART_TOKENS} SELECT * FROM tok")
def token_index(t: Tables):
    return tokens.build_token_index(part_pages(t), ["doc", "page"])


@query("refreshed_tokens", f"""WITH {PART_TOKENS} SELECT CASE WHEN doc = 'Brand#1' THEN 'new' ELSE 'old' END AS state, count(*) AS n FROM tok GROUP BY 1""")
def refreshed_tokens(t: Tables):
    pages = part_pages(t)
    old = tokens.build_token_index(pages, ["doc", "page"]).withColumn("state", F.lit("old"))
    stale = pages.select("doc").filter("doc = 'Brand#1'").distinct()
    new = tokens.refresh_token_index(old, pages.withColumn("state", F.lit("new")), stale, "doc", ["doc", "page", "state"])
    return new.groupBy("state").agg(F.count("*").alias("n"))


@query("token_lookup", f"""
WITH {PART_TOKENS}, a AS (SELECT n_nationkey AS query_id, unnest(['CN' || (n_nationkey + 11), 'A-' || (n_nationkey + 101)]) AS token FROM nation),
n AS (SELECT query_id, doc, page, count(DISTINCT token) AS n_tokens FROM a JOIN tok USING (token) GROUP BY ALL)
SELECT query_id, doc, page, n_tokens FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_tokens DESC, doc, page) AS r FROM n) WHERE r <= 8""")
def token_lookup(t: Tables):
    ask = t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("CN"), (F.col("n_nationkey") + 11).cast("string"), F.lit(" A-"),
                                                                          (F.col("n_nationkey") + 101).cast("string")).alias("q"))
    ask = ask.select("query_id", F.explode(tokens.page_tokens("q")).alias("token"))
    return tokens.lookup_tokens(tokens.build_token_index(part_pages(t), ["doc", "page"]), ask).drop("rank")


@query("page_number_lookup", """
WITH a AS (SELECT DISTINCT n_nationkey AS query_id, unnest([n_nationkey, n_regionkey]) AS page FROM nation)
SELECT p_brand AS doc, query_id, p_partkey AS page FROM a JOIN part ON p_partkey = page""")
def page_number_lookup(t: Tables):
    q = t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("see page "), s("n_nationkey"), F.lit(" and p. "), s("n_regionkey")).alias("question"))
    return tokens.lookup_page_numbers(q, part_pages(t).select("doc", "page"), "query_id", "question").select("doc", "query_id", "page")


@query("page_tags", r"""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)WIDGET') THEN 'block' WHEN regexp_matches(p_name, 'bolt|ring') THEN 'wiring' END AS kind,
  upper(p_brand) AS unit FROM part""")
def page_tags(t: Tables):
    pages = t.part.select("p_partkey", F.concat("p_name", F.lit(" for "), "p_brand").alias("text"))
    return tokens.tag_pages(pages, "text", [("block", "WIDGET"), ("wiring", "bolt|ring")], r"Brand#\d+").select("p_partkey", "kind", "unit")


HITS = """h AS (SELECT l_orderkey AS query_id, l_suppkey AS doc, l_partkey AS page, l_linenumber % 3 + 1 AS channel, row_number() OVER (
  PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank, l_returnflag, l_quantity FROM lineitem)"""


def line_hits(t: Tables, n: int = 12):
    """Line items as search hits: an order is a question, its first lines are the ranked hits."""
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    h = top_k(t.lineitem, ["l_orderkey"], order, n)
    return h.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("page"),
                    (F.col("l_linenumber") % 3 + 1).alias("channel"), "rank", "l_returnflag", "l_quantity")


@query("channel_cascade", f"""
WITH {HITS}, g AS (SELECT * FROM h WHERE rank <= 12), c AS (SELECT query_id, channel, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
f AS (SELECT g.query_id, doc, page, min(g.channel * 1000 + rank) AS k FROM g JOIN b ON b.query_id = g.query_id AND b.channel = g.channel AND before < 2 GROUP BY ALL)
SELECT query_id, doc, page, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, doc, page) AS r FROM f) WHERE r <= 2""")
def channel_cascade(t: Tables):
    return tokens.cascade_candidates(line_hits(t)).select("query_id", "doc", "page", F.col("rank").cast("long").alias("rank"))


@query("page_candidates", f"""
WITH {HITS}, x AS (SELECT query_id, doc, page, 1 AS channel, rank FROM h WHERE rank <= 8 AND l_returnflag = 'A' UNION ALL SELECT query_id, doc, page, 2, rank FROM h WHERE rank <= 12 AND l_returnflag = 'R'),
n AS (SELECT query_id, count_if(channel = 1) AS n1 FROM x GROUP BY query_id),
f AS (SELECT query_id, doc, page, min(channel * 1000 + rank) AS k FROM x JOIN n USING (query_id) WHERE channel = 1 OR n1 < 4 GROUP BY ALL)
SELECT query_id, doc, page, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, doc, page) AS r FROM f) WHERE r <= 4""")
def page_candidates(t: Tables):
    h = line_hits(t)
    return tokens.page_candidates(h.filter("l_returnflag = 'A'"), h.filter("l_returnflag = 'R'")).select(
        "query_id", "doc", "page", F.col("rank").cast("long").alias("rank"))


@query("distinct_excerpts", f"""
WITH {HITS}, f AS (SELECT query_id, doc, l_returnflag, min(rank) AS rank FROM h WHERE rank <= 12 GROUP BY ALL)
SELECT query_id, doc, l_returnflag, CAST(r AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc) AS r FROM f) WHERE r <= 3""")
def distinct_excerpts(t: Tables):
    out = tokens.distinct_excerpts(line_hits(t).withColumnRenamed("rank", "pos"), "query_id", "doc", "l_returnflag", "pos")
    return out.select("query_id", "doc", "l_returnflag", F.col("rank").cast("long").alias("place"))


@query("connection_order", f"""
WITH {HITS}, k AS (SELECT *, CASE channel WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS prio, query_id % 2 = 0 AS asks FROM h WHERE rank <= 12)
SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN asks THEN -prio ELSE 0 END, rank) AS new_position FROM k""")
def connection_order(t: Tables):
    kind = F.element_at(F.array(F.lit("block"), F.lit("wiring"), F.lit("board_circuit")), F.col("channel"))
    h = line_hits(t).withColumn("kind", kind).withColumn("question", F.when(F.col("query_id") % 2 == 0, "How is it Connected").otherwise("What is it"))
    return tokens.rank_connection_pages(h, "query_id", "question", ["connect"], position="rank").select("query_id", "rank", "new_position")


# Vectors -------------------------------------------------------------------------------------------


def label_centroids(t: Tables):
    long = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("embedding")).withColumnRenamed(
        "label", "query_id")


CENTROIDS = """e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL), c AS (SELECT label AS query_id, list(m ORDER BY i) AS v FROM m GROUP BY label)"""


def vector_sql(k: int, where: str = "true") -> str:
    return f"""WITH {CENTROIDS}, sc AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 6) AS score FROM c, embeddings WHERE {where})
SELECT query_id, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sc WHERE score >= 0.3) WHERE r <= {k}"""


@query("vector_topk", vector_sql(8))
def vector_topk(t: Tables):
    return vectors.vector_topk(label_centroids(t), t.embeddings).select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query("vector_topk_secured", vector_sql(8, "vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def vector_topk_secured(t: Tables):
    seen = t.labels.filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return vectors.vector_topk(label_centroids(t), t.embeddings, visible=seen).select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query("vector_topk_blocks", vector_sql(300))
def vector_topk_blocks(t: Tables):
    """The path for more query vectors than may be broadcast, with 300 candidates."""
    return vectors.vector_topk(label_centroids(t), t.embeddings, k=300, max_broadcast=4).select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query("vector_topk_approx")
def vector_topk_approx(t: Tables):
    return vectors.vector_topk_approx(label_centroids(t), t.embeddings)


@query("approximate_recall", """SELECT count(*) AS n_queries, true AS recall_reached, true AS few_scored
FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0)""")
def approximate_recall(t: Tables):
    """Every twentieth vector asks for its nearest: recall of the approximate search against the exact one, and its share of exactly scored pairs."""
    k, n = 8, t.embeddings.count()
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    keep = max(k, n // 12)
    found = vectors.vector_topk_approx(asked, t.embeddings, k, keep=keep)
    per = vectors.topk_recall(found, vectors.vector_topk(asked, t.embeddings, k, threshold=-1.0))
    return per.agg(F.count("*").alias("n_queries"), (F.sum("n_found") / F.sum("n_exact") >= 0.9).alias("recall_reached")).withColumn("few_scored", F.lit(keep * 10 < n))


TFIDF = r"""w AS (SELECT doc_id AS seq, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS f FROM documents),
tf AS (SELECT seq, f, count(*) AS tf FROM w GROUP BY ALL), vo AS (SELECT f, count(*) AS df FROM tf GROUP BY f), nd AS (SELECT count(*) AS n FROM documents),
rw AS (SELECT seq, f, tf * ln((n + 1) / (df + 1)) AS w FROM tf JOIN vo USING (f), nd), nw AS (SELECT seq, sqrt(sum(w * w)) AS norm FROM rw WHERE w > 0 GROUP BY seq),
cv AS (SELECT seq, f, w / norm AS w FROM rw JOIN nw USING (seq) WHERE w > 0)"""
QTFIDF = r"""qw AS (SELECT query_id, unnest(list_filter(string_split_regex(lower(question), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS f FROM sq),
qt AS (SELECT query_id, f, count(*) AS tf FROM qw GROUP BY ALL), qr AS (SELECT query_id, f, tf * ln((n + 1) / (df + 1)) AS w FROM qt JOIN vo USING (f), nd),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qr WHERE w > 0 GROUP BY query_id), qv AS (SELECT query_id, f, w / norm AS w FROM qr JOIN qn USING (query_id) WHERE w > 0),
sm AS (SELECT query_id, seq, round(sum(qv.w * cv.w), 6) AS score FROM qv JOIN cv USING (f) GROUP BY ALL),
sparse_hits AS (SELECT query_id, seq, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM sm WHERE score >= 0.3) WHERE rank <= 8)"""


@query("text_vectors", f"WITH {TFIDF} SELECT seq, count(*) AS n_features, round(max(w), 4) AS top_weight, round(sum(w), 3) AS total FROM cv GROUP BY seq")
def text_vectors(t: Tables):
    return vectors.text_vectors(passages(t), "seq").groupBy("seq").agg(
        F.count("*").alias("n_features"), F.round(F.max("weight"), 4).alias("top_weight"), F.round(F.sum("weight"), 3).alias("total"))


@query("text_similarity", f"WITH sq AS (SELECT item_id AS query_id, text AS question FROM benchmark), {TFIDF}, {QTFIDF} SELECT query_id, seq, round(score, 4) AS score FROM sparse_hits")
def text_similarity(t: Tables):
    p = passages(t)
    vocab = cut_lineage(vectors.text_vocabulary(p, "seq"))
    corpus = cut_lineage(vectors.text_vectors(p, "seq", vocabulary=vocab))
    q = vectors.text_vectors(asked(t), "query_id", "question", vocab)
    return vectors.sparse_topk(q, corpus).select("query_id", "seq", F.round("score", 4).alias("score"))


@query("reused_vectors", """
WITH k AS (SELECT md5(text) AS k, length(text) AS n, doc_id IN (SELECT doc_id FROM labels) AS lab FROM documents), c AS (SELECT DISTINCT k FROM k WHERE lab)
SELECT k.k IN (SELECT k FROM c) AS reused, count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY 1""")
def reused_vectors(t: Tables):
    docs = t.documents.select("doc_id", "text")

    def embed(df):
        return df.withColumn("vector", F.array(F.length("text").cast("double")))

    known = docs.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(F.md5("text").alias("emb_key"), "text").dropDuplicates(["emb_key"])
    out = vectors.reuse_vectors(docs, embed(known).select("emb_key", "vector"), embed)
    return out.groupBy("reused").agg(F.count("*").alias("n"), F.sum(F.element_at("vector", 1)).cast("long").alias("total"))


# Questions -----------------------------------------------------------------------------------------

CODE, COMPONENT, CONCEPT = r"[0-9]{3}", r"(?i)ent[ ,.]", r"(?i)tion"


@query("question_kinds", r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'exact' WHEN regexp_matches(text, '(?i)ent[ ,.]') THEN 'component' WHEN regexp_matches(text, '(?i)tion') THEN 'concept' ELSE 'hybrid' END AS kind,
  CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 0.7 WHEN regexp_matches(text, '(?i)ent[ ,.]') THEN 0.5 WHEN regexp_matches(text, '(?i)tion') THEN 0.3 ELSE 0.5 END::DOUBLE AS lexical,
  CASE WHEN regexp_matches(text, '[0-9]{3}') OR contains(lower(text), 'error') THEN 'troubleshoot' ELSE 'qa' END AS mode,
  regexp_matches(text, 'how') OR regexp_matches(text, '[0-9]{3}') OR contains(lower(text), 'error') OR len(regexp_extract_all(text, '[?？]')) >= 2 AS multistep FROM conversations""")
def question_kinds(t: Tables):
    kind = qs.classify_query("text", CODE, COMPONENT, CONCEPT)
    return t.conversations.select("conv_id", "turn", kind.alias("kind"), qs.route_weights(kind)["lexical"].alias("lexical"),
                                  qs.route_mode("text", CODE, ["error"]).alias("mode"),
                                  qs.needs_multistep("text", CODE, ["error"], "how").alias("multistep"))


@query("question_codes", r"""
WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '(?i)([a-z]{4}tion)', 1), lambda x: upper(x)) AS l FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS codes FROM c""")
def question_codes(t: Tables):
    codes = qs.extract_codes("text", "[a-z]{4}tion")
    return t.conversations.select("conv_id", "turn", F.array_join(codes, ",").alias("codes"))


@query("key_terms", r"""
WITH w AS (SELECT conv_id, turn, list_concat(CASE WHEN contains(lower(text), 'with') THEN ['with', 'avec'] ELSE [] END,
  CASE WHEN contains(lower(text), 'the') THEN ['the'] ELSE [] END, list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]{1,7}'))) AS l FROM conversations),
v AS (SELECT *, list_transform(l, lambda x: lower(x)) AS k FROM w)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(k, lower(x)) = i), ',') AS terms FROM v""")
def key_terms(t: Tables):
    terms = qs.extract_key_terms("text", ["with", "the"], {"with": ["avec"]}, CODE)
    return t.conversations.select("conv_id", "turn", F.array_join(terms, ",").alias("terms"))


@query("query_terms", r"""
SELECT item_id, CAST(len(list_distinct(list_filter(list_concat(regexp_extract_all(lower(text), '([a-z][a-z0-9]{2,}|\d+[a-z][a-z0-9]*)'), regexp_extract_all(lower(text), '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]{2,}')),
  lambda x: x NOT IN ('the', 'and')))) AS BIGINT) AS n_terms FROM benchmark""")
def query_terms(t: Tables):
    return t.benchmark.select("item_id", F.size(qs.query_terms("text", ["the", "and"])).cast("long").alias("n_terms"))


@query("alarm_codes", """
SELECT o_orderkey, 'STG-' || upper(lpad(printf('%x', o_orderkey % 256), 2, '0')) || '-' || upper(lpad(printf('%x', o_custkey % 256), 2, '0')) || ',WS-4A-1B' AS codes FROM orders""")
def alarm_codes(t: Tables):
    text = F.concat(F.lit("STG - FATAL - E Detail: 607304"), F.lpad(F.hex(F.col("o_orderkey") % 256), 2, "0"), F.lit(" FFF0FE"),
                    F.lpad(F.hex(F.col("o_custkey") % 256), 2, "0"), F.lit(" 00000000 and ws_4AH/1BH seen"))
    codes = F.array_join(F.transform(qs.parse_codes(text), lambda x: F.concat_ws("-", x["unit"], x["main"], x["detail"])), ",")
    return t.orders.select("o_orderkey", codes.alias("codes"))


# Fusion --------------------------------------------------------------------------------------------

LISTS = """lx AS (SELECT c_nationkey AS query_id, c_custkey AS doc_id, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS p FROM customer),
sx AS (SELECT c_nationkey AS query_id, c_custkey AS doc_id, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer),
ab AS (SELECT query_id, doc_id, c_mktsegment, 0 AS l, p - 1 AS r, 0.7 / (60 + p - 1) AS c FROM lx WHERE p <= 20 UNION ALL SELECT query_id, doc_id, c_mktsegment, 1, p - 1, 0.3 / (60 + p - 1) FROM sx WHERE p <= 20),
mg AS (SELECT query_id, doc_id, c_mktsegment, round(sum(c), 6) AS score, min(l * 1000 + r) AS first, CASE WHEN count(*) = 2 THEN 'fts+semantic' WHEN min(l) = 0 THEN 'fts' ELSE 'semantic' END AS source FROM ab GROUP BY ALL),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS position FROM mg)"""


def fused_customers(t: Tables, top_n: int | None = None):
    """Customers of a nation ranked twice, each list cut to 20 as a search channel would be."""
    base = t.customer.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("doc_id"), "c_mktsegment", "c_acctbal")
    lex = top_k(base, ["query_id"], [F.desc("c_acctbal"), F.col("doc_id")], 20, "position")
    sem = top_k(base, ["query_id"], [F.col("doc_id")], 20, "position")
    return fusion.rrf_merge(lex, sem, w_lex=0.7, w_sem=0.3, top_n=top_n, payload=["c_mktsegment"])


@query("rank_fusion", f"WITH {LISTS} SELECT query_id, doc_id, c_mktsegment, score, source, position FROM fu WHERE position <= 6")
def rank_fusion(t: Tables):
    return fused_customers(t, 6)


@query("demoted_type", f"""
WITH {LISTS}, d AS (SELECT *, c_mktsegment = 'BUILDING' AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN score * 0.25 ELSE score END AS s2 FROM fu),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, b ORDER BY s2 DESC, position) AS n FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, position) AS p FROM r WHERE NOT b OR n <= 2)
SELECT query_id, doc_id, round(s2, 4) AS score, p AS position FROM k WHERE p <= 30""")
def demoted_type(t: Tables):
    out = fusion.demote_type(fused_customers(t), F.col("c_mktsegment") == "BUILDING", top_n=30)
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"), "position")


@query("model_weighted", f"""
WITH {LISTS}, a AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'BUILDING' END AS named FROM fu WHERE position <= 18),
f AS (SELECT *, round(score * CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 WHEN named IS NOT NULL THEN 1.0 WHEN c_mktsegment = 'BUILDING' THEN 1.0 WHEN c_mktsegment = 'FURNITURE' THEN 0.8 ELSE 0.5 END, 6) AS s2 FROM a
  WHERE named IS NULL OR c_mktsegment IN ('MACHINERY', named))
SELECT query_id, doc_id, s2 AS score, p AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, position) AS p FROM f) WHERE p <= 6""")
def model_weighted(t: Tables):
    tags = F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("COMMON"))).otherwise(F.array("c_mktsegment"))
    named = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("BUILDING"))).otherwise(F.array().cast("array<string>"))
    df = fused_customers(t).withColumn("tags", tags).withColumn("named", named)
    return fusion.merge_for_models(df, "tags", "named", ["BUILDING", "FURNITURE"]).select("query_id", "doc_id", "score", "position")


@query("blended_ranks", f"""
WITH {LISTS}, a AS (SELECT query_id, doc_id, position, CASE WHEN doc_id % 3 > 0 THEN doc_id % 97 END AS m FROM fu WHERE position <= 12),
n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY position) - 1 AS ro,
  row_number() OVER (PARTITION BY query_id ORDER BY m DESC NULLS LAST, position) - 1 AS rm FROM a),
f AS (SELECT *, round(0.6 / (CASE WHEN m IS NULL THEN n ELSE rm END + 3) + 0.4 / (ro + 3), 6) AS fused FROM n)
SELECT query_id, doc_id, round(fused, 4) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, position) AS new_rank FROM f""")
def blended_ranks(t: Tables):
    df = fused_customers(t, 12).withColumn("m", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 97))
    return fusion.blend_ranks(df, "query_id", "m", "position").select("query_id", "doc_id", F.round("fused", 4).alias("fused"), "new_rank")


@query("preferred_order", f"""
WITH {LISTS}, a AS (SELECT query_id, doc_id, position, CASE WHEN c_mktsegment = 'BUILDING' THEN -doc_id END AS pref FROM fu WHERE position <= 12)
SELECT query_id, doc_id, p AS new_position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pref NULLS LAST, position) AS p FROM a) WHERE p <= 6""")
def preferred_order(t: Tables):
    pool = fused_customers(t, 12).withColumnRenamed("doc_id", "item")
    pref = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("item"), (-F.col("c_custkey")).alias("pref_position"))
    return fusion.apply_preferred_order(pool, pref, 6).select("query_id", F.col("item").alias("doc_id"), "new_position")


@query("citations", f"""
WITH {LISTS} SELECT query_id, position, CASE WHEN doc_id % 3 = 0 THEN c_mktsegment || ' p.' || doc_id WHEN doc_id % 3 = 1 THEN c_mktsegment || ' row ' || doc_id ELSE c_mktsegment END AS citation,
  CASE source WHEN 'fts' THEN 'words' WHEN 'semantic' THEN 'meaning' ELSE 'both' END AS source_label, '[' || position || ']' AS block FROM fu WHERE position <= 6""")
def citations(t: Tables):
    kind = F.element_at(F.array(F.lit("manual"), F.lit("checksheet"), F.lit("note")), (F.col("doc_id") % 3 + 1).cast("int"))
    df = fused_customers(t, 6).withColumn("kind", kind)
    return fusion.format_citations(df, {"fts": "words", "semantic": "meaning", "fts+semantic": "both"}, kind="kind", name="c_mktsegment", page="doc_id",
                                   row="doc_id").select("query_id", "position", "citation", "source_label", "block")


@query("citation_groups", f"""
WITH {LISTS}, d AS (SELECT query_id, c_mktsegment, doc_id, position FROM fu WHERE position <= 12), g AS (SELECT query_id, c_mktsegment, min(position) AS first_position, count(*) AS n_parts,
  string_agg(CAST(doc_id AS VARCHAR), '、' ORDER BY position) AS parts FROM d GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_position) AS line_no FROM g""")
def citation_groups(t: Tables):
    return fusion.rollup_citations(fused_customers(t, 12), doc="c_mktsegment", part="doc_id")


@query("chat_history", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, md5(string_agg(role || ': ' || substr(text, 1, 400), chr(10) ORDER BY turn)) AS history, count(*) AS n_turns FROM r WHERE n <= 6 GROUP BY conv_id""")
def chat_history(t: Tables):
    return fusion.history_window(t.conversations).withColumn("history", F.md5("history"))


@query("hybrid_retrieval", rf"""
WITH {Q}, {P}, {bm25_sql()}, sq AS (SELECT * FROM q), {TFIDF}, {QTFIDF},
kd AS (SELECT query_id, CASE WHEN regexp_matches(question, '[0-9]{{3}}') THEN 'exact' WHEN regexp_matches(question, '(?i)ent[ ,.]') THEN 'component' WHEN regexp_matches(question, '(?i)tion') THEN 'concept' ELSE 'hybrid' END AS kind FROM q),
wt AS (SELECT *, CASE kind WHEN 'exact' THEN 0.7 WHEN 'concept' THEN 0.3 ELSE 0.5 END AS wl FROM kd),
ch AS (SELECT query_id, seq, 0 AS l, rank - 1 AS r FROM bm25_hits UNION ALL SELECT query_id, seq, 1, rank - 1 FROM sparse_hits),
mg AS (SELECT query_id, seq, round(sum(CASE WHEN l = 0 THEN wl ELSE 1 - wl END / (60 + r)), 6) AS score, min(l * 1000 + r) AS first,
  CASE WHEN count(*) = 2 THEN 'fts+semantic' WHEN min(l) = 0 THEN 'fts' ELSE 'semantic' END AS source, kind FROM ch JOIN wt USING (query_id) GROUP BY query_id, seq, kind),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, seq) AS p FROM mg)
SELECT query_id, seq, round(score, 4) AS score, f.source, d.source AS doc_name, kind FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, seq) AS n FROM pl WHERE p <= 12) f
JOIN (SELECT doc_id, source FROM documents) d ON d.doc_id = f.seq WHERE n <= 6""")
def hybrid_retrieval(t: Tables):
    p = passages(t).withColumnRenamed("source", "doc_name")
    out = retrieve.retrieve_hybrid(p, asked(t), CODE, COMPONENT, CONCEPT, payload=["doc_name"], index=text_index(t))
    return out.select("query_id", "seq", F.round("score", 4).alias("score"), "source", "doc_name", "kind")


KEY_WORDS = ("ciónes", "enung", "éleau", "ingth")


@query("hybrid_staged", rf"""
WITH {Q}, {P},
q0 AS (SELECT query_id || '#0' AS query_id, regexp_replace(question, '[?？]', ' ', 'g') AS question FROM q), {bm25_sql(8, n="0")},
kt AS (SELECT query_id, unnest(l) AS question, unnest(range(1, len(l) + 1)) AS i FROM (SELECT query_id, list_filter(['{"', '".join(KEY_WORDS)}'], lambda w: contains(lower(question), w)) AS l FROM q)),
q1 AS (SELECT query_id || '#' || i AS query_id, question FROM kt WHERE i <= 4), {bm25_sql(8, n="1")},
lx AS (SELECT CAST(string_split(query_id, '#')[1] AS BIGINT) AS query_id, seq, min(CAST(string_split(query_id, '#')[2] AS BIGINT) * 1000 + rank) AS k
  FROM (SELECT * FROM bm25_hits0 UNION ALL SELECT * FROM bm25_hits1 WHERE rank <= 5) GROUP BY ALL),
sq AS (SELECT * FROM q), {TFIDF}, {QTFIDF},
kd AS (SELECT query_id, CASE WHEN regexp_matches(question, '[0-9]{{3}}') THEN 'exact' WHEN regexp_matches(question, '(?i)ent[ ,.]') THEN 'component' WHEN regexp_matches(question, '(?i)tion') THEN 'concept' ELSE 'hybrid' END AS kind FROM q),
wt AS (SELECT *, CASE kind WHEN 'exact' THEN 0.7 WHEN 'concept' THEN 0.3 ELSE 0.5 END AS wl FROM kd),
ch AS (SELECT query_id, seq, 0 AS l, row_number() OVER (PARTITION BY query_id ORDER BY k, seq) - 1 AS r FROM lx UNION ALL SELECT query_id, seq, 1, rank - 1 FROM sparse_hits),
mg AS (SELECT query_id, seq, round(sum(CASE WHEN l = 0 THEN wl ELSE 1 - wl END / (60 + r)), 6) AS score, min(l * 1000 + r) AS first, kind FROM ch JOIN wt USING (query_id) GROUP BY query_id, seq, kind),
ps AS (SELECT m.*, p.lang, p.source AS doc_name, coalesce(p.source = 'src1' AND query_id % 3 > 0, false) AS b, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, seq) AS p0 FROM mg m JOIN p USING (seq)),
dm AS (SELECT *, CASE WHEN b THEN score * 0.25 ELSE score END AS s1 FROM ps),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id, b ORDER BY s1 DESC, p0) AS n FROM dm),
dp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, p0) AS p1 FROM dr WHERE NOT b OR n <= 2),
md AS (SELECT *, round(s1 * CASE WHEN query_id % 2 = 0 THEN 1.0 WHEN lang = 'en' THEN 1.0 WHEN lang = 'fr' THEN 0.8 ELSE 0.5 END, 6) AS s2 FROM dp WHERE p1 <= 36 AND (query_id % 2 > 0 OR lang = 'en')),
mp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, p1) AS p2 FROM md),
bl AS (SELECT *, CASE WHEN seq % 3 > 0 THEN seq % 97 END AS m FROM mp WHERE p2 <= 12),
bn AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS cn, row_number() OVER (PARTITION BY query_id ORDER BY p2) - 1 AS ro, row_number() OVER (PARTITION BY query_id ORDER BY m DESC NULLS LAST, p2) - 1 AS rm FROM bl),
bf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.6 / (CASE WHEN m IS NULL THEN cn ELSE rm END + 3) + 0.4 / (ro + 3), 6) DESC, p2) AS position FROM bn)
SELECT query_id, position, seq, doc_name, kind, round(s2, 4) AS score FROM bf WHERE position <= 6""")
def hybrid_staged(t: Tables):
    """All stages: key terms, a demoted type, families named by every second question, and an order blended with a model's scores."""
    p = passages(t).withColumnRenamed("source", "doc_name").withColumn("tags", F.array("lang"))
    named = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>"))
    q = asked(t).withColumn("named", named)
    scores = p.where("seq % 3 > 0").select("seq", (F.col("seq") % 97).alias("model_score"))
    out = retrieve.retrieve_hybrid(p, q, CODE, COMPONENT, CONCEPT, payload=["doc_name", "tags"], index=text_index(t), words=KEY_WORDS,
                                   demoted=(F.col("doc_name") == "src1") & (F.col("query_id") % 3 > 0), tags="tags", named="named", priority=["en", "fr"], model_scores=scores)
    return out.select("query_id", "position", "seq", "doc_name", "kind", F.round("score", 4).alias("score"))
