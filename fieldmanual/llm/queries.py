"""Registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmanual.llm import collocations, importance, jaccard, language, line_runs, lm_scoring, mixing, packing, personal, secrets, sharding, transport, vectors_exact

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Only the token constraint binds: no sequence can hold more than 2048 documents or cost more than 2048 squared."""
    return packing.pack_documents(_table(spark, folder, "documents"), capacity=2048, most_pieces=2048, most_attention=2048 * 2048, with_ids=False)


@query("op2_media_columns")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return transport.digest_media(transport.store_media(_table(spark, folder, "documents")))


@query("op3_personal_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_personal(_table(spark, folder, "documents"))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(_table(spark, folder, "documents"))


@query("op5_source_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_lm_scoring")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    wanted = _table(spark, folder, "labels").where("quality = 1")
    return lm_scoring.cross_entropy_difference(_table(spark, folder, "documents"), wanted)


@query("op7_exact_top_k")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return vectors_exact.exact_top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_jaccard_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, folder, "documents"))


@query("op9_sharding")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


@query("op10_secret_scans")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(_table(spark, folder, "documents")))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p FROM spots, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(w)),
totals AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY lang, k, p HAVING count(*) >= 30),  -- parts of a candidate are as frequent
cand AS MATERIALIZED (SELECT *, string_split(p, ' ') AS w FROM f WHERE k >= 2),
cuts AS MATERIALIZED (
  SELECT lang, p, f AS a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS head, array_to_string(list_slice(w, cut + 1, k), ' ') AS tail
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM cand)),
scored AS MATERIALIZED (
  SELECT c.lang, c.p, c.a, c.cut, l.f AS l, r.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.head JOIN f r ON r.lang = c.lang AND r.p = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inner_parts AS MATERIALIZED (
  SELECT lang, f, array_to_string(list_slice(w, s, s + z - 1), ' ') AS p
  FROM (SELECT *, unnest(generate_series(1, k)) AS s FROM cand), (VALUES (2), (3)) t(z) WHERE z < k AND s + z - 1 <= k),
longer AS MATERIALIZED (SELECT lang, p, max(f) AS f FROM inner_parts GROUP BY lang, p),
kept AS (
  SELECT b.*, b.p AS phrase FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.p = b.p
  WHERE g.f IS NULL OR 100 * CAST(g.f AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query("op11_phrase_collocations", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine_collocations(_table(spark, folder, "documents"), least=30, order=4, top=2000, cover_percent=80)


@query("op12_importance_resampling")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), percent=10, least_words=20, buckets=10_000, longest=1, seed=2024)


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, doc_id, string_split(text, chr(10)) AS parts FROM docs),
lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS i FROM parts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS lost FROM keyed k LEFT JOIN often o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id"""


@query("op13_line_dedup", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return line_runs.line_digest(line_runs.dedup_lines(docs, line_runs.split_batches(docs, 6), min_docs=10, least=1, fanout=3))
