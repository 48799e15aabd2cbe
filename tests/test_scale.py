"""Steps that once grew faster than their input."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
from pyspark.sql import functions as F

from fieldmanual.operators import access, glossary, lexical, prepare, vectors, wiring
from fieldmanual.plans import secure
from fieldmanual.plans.registry import Tables
from fieldmanual.sources import readers


def test_parentheses_are_linear(spark):
    text = "red widget (RW) " + "no parenthesis follows " * 4000 + "(open"
    rows = spark.createDataFrame([("d", text), ("d", None)], "doc_name string, text string")
    glossary.mine_long_short(rows).collect()
    began = time.monotonic()
    assert [tuple(r) for r in glossary.mine_long_short(rows).collect()] == [("d", "RW", "Red Widget")]
    assert time.monotonic() - began < 10


def test_files_are_compared_once_per_grants(spark, tmp_path, monkeypatch):
    day = dt.datetime(2999, 1, 1)
    orders = [(4 * i, i % 50, "O", "1-URGENT", day) for i in range(100)] + [(4, None, "O", "1-URGENT", day), (8, None, "F", "1-URGENT", day)]
    part = [(i, f"B{i % 6}", "SMALL" if i % 2 else "LARGE", 1) for i in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    sizes, plain = [], access.compare_visibility

    def counted(before, after):
        sizes.append(before.count())
        return plain(before, after)

    monkeypatch.setattr(access, "compare_visibility", counted)
    out = secure.visibility_changes(Tables(spark, str(tmp_path))).collect()
    assert sorted(r.uid for r in out if r.uid is not None) == list(range(50)) and len(out) == 51
    assert len({(r.extra, r.missing, r.same) for r in out if r.uid is not None}) == 1
    assert sizes[0] <= 2 * 60


def exchanges_above_generate(df):
    """Shuffles of the plan that move the rows of a generator as they are, before any count."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]
    return plan.count("Exchange")


def test_words_and_grams_are_counted_where_they_are_cut(spark):
    rows = spark.createDataFrame([(1, "Abc abc"), (1, "abc"), (2, None), (None, "x abcd")], "seq long, text string")
    assert exchanges_above_generate(lexical.build_trigram_index(rows)) == 0
    assert exchanges_above_generate(vectors.word_counts(rows, "seq")) == 0
    assert {tuple(r) for r in vectors.word_counts(rows, "seq").collect()} == {(1, "abc", 3), (None, "x", 1), (None, "abcd", 1)}
    assert ("abc", 1, 3) in {tuple(r) for r in lexical.build_trigram_index(rows).collect()}


def test_approximate_search_in_blocks(spark):
    draw = np.random.default_rng(3)
    corpus = spark.createDataFrame([(i, draw.normal(size=16).tolist()) for i in range(2000)] + [(3000, None)], "vec_id long, embedding array<double>")
    asked = corpus.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding").where("embedding is not null")
    whole = corpus.where("embedding is not null")
    exact = vectors.vector_topk(asked, whole, 8, threshold=-1.0)
    for block in (300, 65_536):
        found = vectors.vector_topk_approx(asked, whole, 8, keep=166, block=block)
        per = vectors.topk_recall(found, exact).agg(F.sum("n_found") / F.sum("n_exact")).first()[0]
        assert per >= 0.9 and found.groupBy("query_id").count().where("count <> 8").isEmpty()


def test_best_places():
    draw = np.random.default_rng(4)
    for n in (1, 5, 40):
        for k in (1, 4, 40):
            scores = draw.integers(0, 6, n).astype(float)
            assert vectors._best(scores, k).tolist() == np.argsort(-scores, kind="stable")[:k].tolist()


def test_code_files_are_not_broadcast(spark):
    """Cut code files are many times larger than the planner thinks, so a lookup sends none of them whole to a task."""
    files = spark.createDataFrame([("U1", "#0A H\n  first\n  01H: one\n     more\n#0B H\n  other\n"), (None, "#0A H\n  lost\n")], "unit string, text string")
    sections = readers.parse_sectioned_codes(files, ["unit"])
    asked = spark.createDataFrame([(1, "U1", "0A", "01"), (2, "U1", "0B", "01"), (3, None, "0A", "01"), (4, "U1", "ZZ", None), (4, "U1", "ZZ", None)],
                                  "query_id long, unit string, main string, detail string")
    out = readers.lookup_code_definition(asked, sections, readers.code_details(sections, ["unit"]))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r.source, r.title, r.text) for r in out.collect())
    assert got == [(1, "code file", "first", "01H: one\nmore"), (2, "code file", "other", None), *[(n, "not found", None, None) for n in (3, 4, 4)]]


def test_only_asked_grams_of_a_page_are_shuffled(spark):
    draw = np.random.default_rng(5)
    pages = [(d, p, "".join(draw.choice(list("abcdefgh "), 400))) for d in ("a", "b", None) for p in range(1, 9)] + [("a", 3, "second text of page three"), ("b", 9, None)]
    texts = {k: "".join(t.split()) for *k, t in pages if t for k in [tuple(k)]}
    asked = [("a", i, texts["a", p][n:n + 60]) for i, (p, n) in enumerate([(1, 0), (8, 300), (4, 17)])] + [
        ("a", 3, texts["a", 2][50:70] + "-" * 40), ("a", 4, texts["a", 5][9:14]), ("a", 5, "no such words anywhere"), ("a", 6, ""), ("b", 0, texts["a", 1][:50]), (None, 0, texts["b", 2][:50]), ("c", 0, "x"),
        ("b", 1, texts["b", 7][5:90]), ("b", 1, texts["b", 7][5:90])]
    p = spark.createDataFrame(pages, "doc string, page long, page_text string")
    q = spark.createDataFrame(asked, "doc string, key long, snippet string")
    grams = q.selectExpr("doc", "substring(snippet, 1, 14) __g").where("__g <> ''").distinct()
    flat = p.selectExpr("doc", "page", "regexp_replace(page_text, '\\\\s+', '') __t")
    assert prepare._asked_grams(flat, grams, "doc", 40).count() < 0.02 * sum(len(t) for t in texts.values())
    got = {(r.doc, r.key): r.page for r in prepare.locate_snippet(q, p, "doc", "key").collect()}
    rows = [(d, n, "".join(t.split())) for d, n, t in pages if d and t]
    for d, k, snippet in asked:
        found = [[n for e, n, t in rows if e == d and "".join(snippet.split())[:size] in t] for size in (40, 24, 14)] if d and snippet else []
        assert got[d, k] == next((min(x) for x in found if x), 1)


def test_traces_carry_no_pins_past_the_pin_test(spark):
    met = spark.createDataFrame([(1, "k", i, 9, pins, before) for i, (pins, before) in enumerate([(["1"], ["1", "2"]), (["3"], ["1"]), (None, ["1"]), (["1"], None), (None, None)])],
                                "start_id long, key string, gid long, parent long, pins array<string>, ppins array<string>")
    lean = wiring.compare_pins(met)
    assert not {"pins", "ppins"} & set(lean.columns)
    for junction, want in [(3, [(False, False), (False, True), (True, False), (False, False), (False, False)]), (6, [(False, False)] * 5)]:
        got = wiring.filter_junction(lean, junction, ["start_id", "key"]).orderBy("gid").collect()
        assert [(r.pins_unknown, r.folded) for r in got] == want


def test_merged_edges_and_traces_with_odd_rows(spark):
    """Repeated ids, null ids and rows without keys; cable and keys are read off the signature and it alone is shuffled."""
    rows = [(1, 1, "J1001", "J1002", "4S001-002", "1~2"), (1, 1, "J1001", "J1002", "4S001-002", "1~2"), (2, 2, "P1002", "J1001", "4S001-002", "5"), (3, 2, None, None, "4S009-009", "7"),
            (None, 3, None, None, "4S008-008", None), (None, 4, "J1002", "J1003", None, None), (6, 5, "J1002", "J1004", None, "2"), (7, 6, "CN1", "J1004", None, None), (8, 6, "CN1", "J1005", None, None)]
    e = spark.createDataFrame([(i, "b", *r) for i, *r in rows], "edge_id long, doc string, page long, a_conn string, b_conn string, cable string, wires string")
    e = e.selectExpr("*", *[f"cast(null as string) {c}" for c in ("a_mate", "b_mate", "a_device", "b_device")])
    groups, pages = wiring.merge_edges(e, keep=("a_device", "b_device"))
    got = {(r.gid, r.cab, tuple(r["keys"]), tuple(r.pins or ()), r.n_rows) for r in groups.collect()}
    assert got == {(1, "4S001-002", ("J/P1001", "J/P1002"), ("1", "2", "5"), 3), (3, "4S009-009", (), ("7",), 1), (None, "4S008-008", (), (), 1), (None, "", ("J/P1002", "J/P1003"), (), 1),
                   (6, "", ("J/P1002", "J/P1004"), ("2",), 1), (7, "", ("CN1", "J/P1004"), (), 1), (8, "", ("CN1", "J/P1005"), (), 1)}
    assert {tuple(r) for r in pages.collect()} == {(1, "b", 1), (1, "b", 2), (3, "b", 2), (None, "b", 4), (6, "b", 5), (7, "b", 6), (8, "b", 6)}
    assert {(r.depth, r.gid) for r in wiring.trace(groups, pages, "J1001").collect()} == {(0, 1), (1, 6), (2, 7), (3, 8)}
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("any_value") <= 1 and "b_mate" not in plan.split("max_by")[1].split("best")[0]
