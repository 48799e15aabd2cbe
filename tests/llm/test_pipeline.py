"""The pipeline stage by stage against a brute-force version."""

from __future__ import annotations

import collections

import corpus_pipeline
from fieldmanual.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    from tests.llm.test_operators import brute_components

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34 !!", None, "src0", 8), (9003, 'say token = "abcdef0123456789"', None, "src1", 30)], docs.schema)
    docs = stored(docs.unionByName(odd))
    columns = docs.columns
    kept = stored(corpus_pipeline.STAGES[0][1](spark, docs, FOLDER))
    assert {r.doc_id for r in docs.join(kept, "doc_id", "left_anti").collect()} == {9001, 9002} and kept.columns == columns
    single = stored(corpus_pipeline.STAGES[1][1](spark, kept, FOLDER))
    classes = brute_components([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in classes if d == c} and single.columns == columns
    clean = stored(corpus_pipeline.STAGES[2][1](spark, single, FOLDER))
    assert clean.count() == single.count() and "[SECRET]" in clean.where("doc_id = 9003").first().text and clean.columns == columns
    mixed = stored(corpus_pipeline.STAGES[3][1](spark, clean, FOLDER))
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and mixed.columns == columns
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, FOLDER)
    assert collections.Counter(r.doc_id for r in packed.where("piece = 0").collect()) == copies


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0


def test_repeated_and_null_keys_lose_no_text(spark):
    a, b, c = "one text with quite some words in it", "another text that has nothing in common here", "a third text under a null key is kept too"
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (None, a, "en", "s", 1), (None, c, "en", "s", 1), (9, "last of all texts, short", "en", "s", 1), (9, None, "en", "s", 1), (8, "", "en", "s", 1)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = corpus_pipeline.one_of_each_group(spark, docs, FOLDER)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(3, a), (5, b), (None, c), (9, rows[5][1]), (9, None), (8, "")]))
    two = stored(spark.createDataFrame([(1, "x " * 10, None, "p", 1), (1, "y " * 30, None, "q", 1), (None, "z " * 20, None, "q", 1), (None, "z " * 20, None, "q", 1)], docs.schema))
    size = {"p": 10, "q": 70}
    mixed = collections.Counter(r.source for r in corpus_pipeline.mixed_to_weights(spark, two, FOLDER).collect() for _ in r.text.split())
    assert sum(mixed.values()) > 0 and all(mixed[s] <= 3 * size[s] for s in mixed)
