"""An updated store equals a full build."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmanual.operators.procedure_store import ProcedureStore

SCHEMA = "doc_id string, seq long, doc_name string, doc_type string, model string, section_title string, text string"


def routes():
    return F.col("doc_type") == "sop", F.col("doc_name").rlike("(?i)report")


def manual(doc, *texts, kind="manual", name=None, model=""):
    return [(doc, i, name or f"{doc}.md", kind, model, f"{i + 1}.{i + 1} Part {i}", t) for i, t in enumerate(texts)]


FIRST = (manual("a", "1. Check the door\n2. Press start\n3. Close it", "1. Set the dial\n2. Turn it off") + manual("b", "1. Check oil\n2. Press go")
         + manual("c", "free text", "more text", kind="sop", model="M9") + manual("d", "1. Check x\n2. Press y", name="Report 5")
         + manual("gone", "1. Open lid\n2. Close lid"))
SECOND = (manual("a", "1. Check the door\n2. Press start\n3. Close it", "1. Set the dial\n2. Turn it off") + manual("b", "1. Check oil\n2. Press go", "1. Fit cap\n2. Press cap")
          + manual("c", "free text", "more text", "a third section", kind="sop", model="M9") + manual("d", "1. Check x\n2. Press y", name="Report 5")
          + manual("new", "1. Open lid\n2. Close lid") + [(None, 0, "n", "manual", "", "t", "1. Check\n2. Press"), ("empty", 0, None, None, None, None, None)])


def test_update_equals_full_build(spark):
    asked = []

    def embed(texts):
        asked.extend(r.text for r in texts.collect())
        return texts.select("emb_key", F.array(F.length("text").cast("double")).alias("vector"))

    first, second = (spark.createDataFrame(rows, SCHEMA) for rows in (FIRST, SECOND))
    meta = spark.createDataFrame([("b", "X1"), ("a", "")], "doc_id string, model string")
    store, full = ProcedureStore.create(spark), ProcedureStore.create(spark)
    assert {(r.change, r.documents) for r in store.update(first, *routes(), embed, meta).collect()} == {("new", 5)}
    before = len(asked)
    assert before == len(set(asked)) == 5  # two of a, one of b, c and gone
    counts = store.update(second.repartition(3), *routes(), embed, meta)
    assert {(r.change, r.documents) for r in counts.collect()} == {("new", 2), ("changed", 2), ("vanished", 1)}
    fresh = asked[before:]
    assert len(fresh) == 2 and set(fresh).isdisjoint(asked[:before])  # the second of b and c; new has the text of a vanished one
    full.update(second, *routes(), embed, meta)
    rows = lambda s: (sorted(map(str, s.procedures().drop("built").collect())), sorted(map(str, s.steps().drop("built").collect())))
    assert rows(store) == rows(full)
    built = {r.doc_id: r.built for r in store.procedures().collect()}
    assert built == {"a": 1, "b": 2, "c": 2, "new": 2}
    got = {(r.doc_id, r.kind, r.model, r.n_steps) for r in store.procedures().collect()}
    assert got == {("a", "numbered", "", 3), ("a", "numbered", "", 2), ("b", "numbered", "X1", 2), ("c", "whole", "M9", 3), ("new", "numbered", "", 2)}
    # Nothing changed: nothing is published.  One document only: the others are left alone.
    version = store.version
    assert store.update(second, *routes(), embed, meta).count() == 0 and store.version == version
    only = spark.createDataFrame([("b",)], "doc_id string")
    assert [(r.change, r.documents) for r in store.update(first, *routes(), embed, meta, only).collect()] == [("changed", 1)]
    assert {r.doc_id for r in store.procedures().collect()} == {"a", "b", "c", "new"} and store.procedures().filter("doc_id = 'b'").count() == 1
    merged = rows(store)
    store.merge()
    again = ProcedureStore.open(spark, store.path)
    assert rows(again) == merged and len(again.segments) == 1 and again.procedures().filter("vector is null").count() == 0
    # A new model alone is a change.
    meta = spark.createDataFrame([("b", "X2")], "doc_id string, model string")
    assert [(r.change, r.documents) for r in again.update(first, *routes(), embed, meta, only).collect()] == [("changed", 1)]
    assert {r.model for r in again.procedures().filter("doc_id = 'b'").collect()} == {"X2"}


def test_empty_passages(spark):
    store = ProcedureStore.create(spark)
    assert store.update(spark.createDataFrame([], SCHEMA), *routes(), lambda t: t.withColumn("vector", F.array(F.lit(0.0)))).count() == 0
    assert store.segments == ()
