"""Pipeline over documents: language, near duplicates, secrets, source mix, packed sequences.

Every stage takes the documents that the one before it kept and returns documents; the last returns pieces of
packed sequences.  Stages meet only through Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmanual.llm import jaccard, language, mixing, packing, secrets
from fieldmanual.llm.common import key_text, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is found; null texts and texts without a letter go.

    Equal (key, text) rows have equal predictions, so the decision joins back on both.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__k": key_text("doc_id"), "__h": F.xxhash64(text)})
    model = language.fit_languages(language.learning_part(docs))
    found = language.predict_languages(keyed, model, keep=("__k", "__h"))
    lost = found.where(F.col("lang_pred") == language.UNKNOWN).select("__k", "__h").distinct()
    return keyed.join(lost, ["__k", "__h"], "left_anti").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least key of every group of near duplicates; documents without words stay.

    Rows are told apart by key and text (a 64-bit hash of both), so other texts under a repeated or null key stay.  A null
    key counts as the greatest; of rows with equal key and text one stays.
    """
    keyed = docs.withColumn("__k", F.xxhash64(F.lit(1), key_text("doc_id"), F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit(""))))
    classes = jaccard.jaccard_join(keyed, key="__k").select(F.col("doc_id").alias("__k"), F.col("component_id").alias("__c"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__k").alias("k"))
    first = classes.join(keyed.select("__k", "doc_id"), "__k").groupBy("__c").agg(F.min(place)["k"].alias("__k"))
    return keyed.join(first.select("__k"), "__k", "left_semi").dropDuplicates(["__k"]).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of every document as the mix of sources takes, which may be none.

    Rows are told apart by a 64-bit hash of all their columns; equal rows are one row with the copies of all of them.
    """
    keyed = docs.withColumn("__k", F.xxhash64(*[F.struct(c).cast("string") for c in docs.columns]))
    copies = mixing.mix_sources(keyed, key="__k").groupBy(F.col("doc_id").alias("__k")).agg(F.sum("copies").alias("copies"))
    met = keyed.dropDuplicates(["__k"]).join(copies.where("copies > 0"), "__k")
    return met.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [("language", keep_languages), ("near_duplicates", one_of_each_group), ("secrets", without_secrets), ("mixing", mixed_to_weights), ("packing", packed)]

#: Hash-based rounding, tokens and trained models cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
