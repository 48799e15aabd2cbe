"""Stored procedures that follow their documents: only documents whose content changed are walked again.

A store is a folder of segments.  Each update appends one segment with the rows of new and changed documents and a
tombstone for each vanished one; readers take the newest build of every document.  A segment counts once the manifest
names it, so an update that dies leaves nothing behind but an unnamed folder.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmanual.functions.text import clean_markdown
from fieldmanual.operators import procedures as pr
from fieldmanual.operators.ordered import cut_lineage, shared_path

PARTS = ("documents", "procedures", "steps", "vectors")
COLUMNS = ("doc_id", "seq", "doc_name", "doc_type", "model", "section_title", "text")


def document_heads(passages: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc_name, doc_type, model, head, n_rows, content) of every document.

    Name and type are those of the first passage, ``head`` is its clean title.  The model is that of ``meta``
    (doc_id, model) where it is not blank, else of the first passage.  ``content`` adds hashes of all rows, so it does not
    depend on their order in the table and is summed before the shuffle.
    """
    row = F.xxhash64("seq", "section_title", "text", "doc_name", "doc_type", F.col("text").isNull(), F.col("section_title").isNull())
    first = F.min(F.struct("seq", "doc_name", "doc_type", "model", "section_title")).alias("x")
    heads = passages.groupBy("doc_id").agg(first, F.count("*").alias("n_rows"), F.sum(row.cast("decimal(20,0)")).alias("content"))
    model = F.nullif("x.model", F.lit(""))
    if meta is not None:
        own = meta.groupBy("doc_id").agg(F.min(F.nullif("model", F.lit(""))).alias("__own"))
        heads, model = heads.join(own, "doc_id", "left"), F.coalesce(F.col("__own"), model)
    model = F.coalesce(model, F.lit(""))
    return heads.select("doc_id", F.coalesce("x.doc_name", F.lit("")).alias("doc_name"), F.coalesce("x.doc_type", F.lit("")).alias("doc_type"), model.alias("model"),
                        clean_markdown(F.coalesce("x.section_title", F.lit(""))).alias("head"), "n_rows",
                        F.md5(F.concat_ws("|", F.col("content").cast("string"), model)).alias("content"))


def procedure_rows(passages: DataFrame, heads: DataFrame, whole: Column, skip: Column, embed_steps: int = 6) -> tuple[DataFrame, DataFrame]:
    """(procedures, steps) of all passages; ``whole`` and ``skip`` are conditions on the columns of :func:`document_heads`.

    A document for which ``whole`` holds is one procedure and each of its sections a step; others give their numbered
    procedures, unless ``skip`` holds.  Steps are a child table, because a whole document may have any number.  The text
    to embed is the title, the breadcrumb and the first ``embed_steps`` steps.
    """
    route = F.when(F.coalesce(whole, F.lit(False)), "whole").when(~F.coalesce(skip, F.lit(False)), "numbered")
    routed = heads.withColumn("kind", route).filter("kind is not null")
    rows = passages.drop("doc_name", "doc_type", "model").join(routed.select("doc_id", "doc_name", "kind"), "doc_id")
    numbered = pr.split_procedures(pr.line_stream(rows.filter("kind = 'numbered'"))).withColumnRenamed("start_pos", "start")
    own = rows.filter("kind = 'whole'")
    sections = pr.whole_document_steps(own).select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("n"), "text", "detail")
    steps = cut_lineage(numbered.select("doc_id", F.col("start").cast("long").alias("start"), F.inline("steps")).select(
        "doc_id", "start", F.col("n").cast("long").alias("n"), "text", "detail").unionByName(sections))
    spans = own.groupBy("doc_id").agg(F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"))
    titled = numbered.select("doc_id", F.col("start").cast("long").alias("start"), "title", "breadcrumb", "intro", "page", "seq_start", "seq_end").unionByName(
        spans.join(routed.select("doc_id", F.col("doc_name").alias("title")), "doc_id").select(
            "doc_id", F.lit(0).cast("long").alias("start"), "title", *[F.lit("").alias(c) for c in ("breadcrumb", "intro", "page")], "seq_start", "seq_end"))
    first = F.array_sort(F.collect_list(F.when(F.col("n") <= max(2, embed_steps), F.struct("n", "text")))).alias("first")  # bounded
    counted = steps.groupBy("doc_id", "start").agg(F.count("*").cast("int").alias("n_steps"), first)
    told = F.transform(F.filter("first", lambda s: s["n"] <= embed_steps), lambda s: s["text"])
    text = F.concat_ws("\n", F.col("title"), F.nullif("breadcrumb", F.lit("")), told)
    proc = F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start").cast("string"))), 1, 16)
    made = titled.join(counted, ["doc_id", "start"]).join(routed.drop("head", "n_rows", "content"), "doc_id").select(
        proc.alias("proc_id"), "doc_id", "doc_name", "doc_type", "model", "kind", "start", "title", "breadcrumb", "intro", "n_steps", "page", "seq_start", "seq_end",
        pr.group_key("title", "first").alias("group_key"), F.md5(text).alias("emb_key"), text.alias("emb_text"))
    return made, steps.withColumn("proc_id", proc)


class ProcedureStore:
    """Handle of a store folder; ``segments`` are the names of its folders, oldest first."""

    def __init__(self, spark: SparkSession, path: str, segments: tuple[str, ...] = (), version: int = 0):
        self.spark, self.path, self.segments, self.version = spark, path, tuple(segments), version

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None) -> ProcedureStore:
        """An empty store; without a path, in a folder of its own below ``spark.checkpoint.dir``."""
        return cls(spark, path or shared_path(spark, f"procedures-{uuid.uuid4().hex}"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ProcedureStore:
        """The newest version of a store that has been updated before."""
        rows = spark.read.parquet(f"{path}/manifest")
        last = rows.orderBy(F.desc("version")).first()  # one row per version
        return cls(spark, path, tuple(last["segments"]), last["version"])

    def _publish(self, segments: tuple[str, ...], version: int) -> None:
        made = self.spark.createDataFrame([(version, list(segments))], "version int, segments array<string>")
        made.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.segments, self.version = segments, version

    def _read(self, part: str) -> DataFrame | None:
        read = [self.spark.read.parquet(f"{self.path}/{name}/{part}") for name in self.segments]
        return reduce(DataFrame.unionByName, read) if read else None

    def documents(self, gone: bool = False) -> DataFrame:
        """(doc_id, content, built, gone) of the newest build of every document; tombstones only if asked for."""
        newest = self._read("documents").groupBy("doc_id").agg(F.max(F.struct("built", "content", "gone")).alias("x")).select("doc_id", "x.*")
        return newest if gone else newest.filter("not gone")

    def _current(self, part: str) -> DataFrame:
        return self._read(part).join(self.documents().select("doc_id", "built"), ["doc_id", "built"], "left_semi")

    def procedures(self, vectors: bool = True) -> DataFrame:
        """The current procedures, with ``built`` (the version that walked their document) and the vector of their text."""
        found = self._current("procedures")
        return found.join(self._read("vectors"), "emb_key", "left") if vectors else found

    def steps(self) -> DataFrame:
        """(proc_id, doc_id, start, n, text, detail, built) of the current procedures."""
        return self._current("steps")

    def changes(self, heads: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """(doc_id, change): ``new``, ``changed`` or ``vanished`` against the store; ``only`` (doc_id) limits both sides."""
        if not self.segments:
            return heads.select("doc_id", F.lit("new").alias("change"))
        known = self.documents().select("doc_id", F.col("content").alias("__known"))
        if only is not None:
            known = known.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
        change = F.when(F.col("content").isNull(), "vanished").when(F.col("__known").isNull(), "new").when(F.col("content") != F.col("__known"), "changed")
        return heads.select("doc_id", "content").join(known, "doc_id", "full_outer").select("doc_id", change.alias("change")).filter("change is not null")

    def update(self, passages: DataFrame, whole: Column, skip: Column, embed: Callable[[DataFrame], DataFrame], meta: DataFrame | None = None,
               only: DataFrame | None = None, embed_steps: int = 6) -> DataFrame:
        """Bring the store to the given passages; returns (change, documents) counts.

        ``passages`` holds all documents (or those of ``only``, when only these are to be followed), with the columns
        ``doc_id``, ``seq``, ``doc_name``, ``doc_type``, ``model``, ``section_title`` and ``text``.  ``embed`` maps
        (emb_key, text) to (emb_key, vector); it sees each text once in the life of the store.  Rows with a null doc_id
        belong to no document and are left out; nothing is published when nothing changed.
        """
        rows = passages.select(*COLUMNS).filter("doc_id is not null")
        if only is not None:
            rows = rows.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
        version, name = self.version + 1, f"segment-{uuid.uuid4().hex}"
        folder, built = f"{self.path}/{name}", F.lit(version).alias("built")
        heads = cut_lineage(document_heads(rows, meta))
        noted = self.changes(heads, only).join(heads.select("doc_id", "content"), "doc_id", "left")
        noted.select("doc_id", "content", built, (F.col("change") == "vanished").alias("gone"), "change").write.parquet(f"{folder}/documents")
        changed = self.spark.read.parquet(f"{folder}/documents")
        counts = changed.groupBy("change").agg(F.count("*").alias("documents"))
        if changed.isEmpty():
            return counts
        todo = changed.filter("not gone").select("doc_id")
        made, steps = procedure_rows(rows.join(todo, "doc_id", "left_semi"), heads.join(todo, "doc_id", "left_semi"), whole, skip, embed_steps)
        made.select("*", built).write.parquet(f"{folder}/procedures")
        steps.select("*", built).write.parquet(f"{folder}/steps")
        texts = self.spark.read.parquet(f"{folder}/procedures").groupBy("emb_key").agg(F.min("emb_text").alias("text"))
        if self.segments:
            texts = texts.join(self._read("vectors").select("emb_key"), "emb_key", "left_anti")
        embed(texts).select("emb_key", "vector").write.parquet(f"{folder}/vectors")
        self._publish((*self.segments, name), version)
        return counts

    def merge(self) -> None:
        """Write what is current as one segment: no tombstones, no older builds, no vectors without a procedure."""
        name = f"segment-{uuid.uuid4().hex}"
        used = self._current("procedures").select("emb_key").distinct()
        current = {"documents": self.documents().withColumn("change", F.lit("merged")), "procedures": self._current("procedures"), "steps": self._current("steps"),
                   "vectors": self._read("vectors").join(used, "emb_key", "left_semi")}
        for part in PARTS:
            current[part].write.parquet(f"{self.path}/{name}/{part}")
        self._publish((name,), self.version + 1)
