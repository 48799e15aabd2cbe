"""Hand-worked answers for operators whose rules are easy to get wrong."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldmanual.functions import codes as cd
from fieldmanual.functions import equipment as eq
from fieldmanual.functions import questions as qs
from fieldmanual.functions import text as tx
from fieldmanual.operators import access, cases, fusion, glossary, lexical, prepare, procedures, sync, tokens, vectors, wiring
from fieldmanual.operators.ordered import top_k
from fieldmanual.sources import readers, sinks
from fieldmanual.streaming import streams

# (clearance, scopes, changes to a level-3 approved oem_manual document open to all families, visible)
ACCESS = [
    (3, ["internal", "vendor"], {}, True), (3, ["internal"], {}, False), (2, ["internal", "vendor"], {}, False),
    (4, ["internal"], {"sec_level": 2, "category": "sop", "review_status": "pending"}, False),
    (4, ["internal", "customer:y"], {"sec_level": 4, "category": "customer_deliverable", "customer": "x"}, False),
    (4, ["internal", "customer:x"], {"sec_level": 4, "category": "customer_deliverable", "customer": "x"}, True),
    (4, ["internal"], {"category": None}, False), (3, ["cat:oem_manual"], {}, True), (3, ["cat:oem_manual"], {"category": "circuit"}, False),
    (3, ["cat:oem_manual", "model:C"], {"models": ["A"]}, False), (3, ["cat:oem_manual", "model:C"], {"models": ["C"]}, True),
    (3, ["cat:oem_manual", "model:C"], {}, False), (3, ["cat:oem_manual", "model:C", "model:COMMON"], {}, True),
    (3, ["cat:sop", "model:A"], {"category": "sop", "models": ["B", "A"]}, True),
    (3, ["cat:sop", "model:A", "model:COMMON"], {"category": "sop", "models": ["C"]}, False), (3, ["cat:sop", "model:ALL"], {"category": "sop"}, True),
    (3, ["cat:sop", "model:C"], {"category": "sop", "models": ["A", "C"]}, True), (4, ["cat:fault_history"], {"category": "fault_history", "customer": "x"}, False),
    (4, ["cat:fault_history", "cust:x"], {"category": "fault_history", "customer": "x"}, True)]
DOC = "sec_level int, category string, review_status string, models array<string>, customer string"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_access_truth_table(spark):
    for clearance, scopes, changes, want in ACCESS:
        doc = {"sec_level": 3, "category": "oem_manual", "review_status": "approved", "models": ["ALL"], "customer": None} | changes
        g = one(spark, access.parse_grants(F.array(*[F.lit(x) for x in scopes])))
        who = {"role": "manager", "clearance": clearance, **g.asDict()}
        df = spark.createDataFrame([tuple(doc.values())], DOC)
        assert df.select(access.visible(who).alias("v")).first().v is want, (clearance, scopes, changes)
        assert df.select(access.visible({**who, "role": "kb_admin"}).alias("v")).first().v is True
        assert df.select(access.visible({**who, "role": "auditor"}).alias("v")).first().v is False
        assert df.select(access.visible(None).alias("v")).first().v is False
        assert df.select(access.visible(None, security=False).alias("v")).first().v is True
    with pytest.raises(access.PermissionDenied):
        access.secure(df, df, None)


def test_principals(spark):
    users = spark.createDataFrame([("u", "engineer", 3, "active"), ("t", "trainee", 4, "active"), ("z", "engineer", 3, "left")], "uid string, role string, clearance int, status string")
    scopes = spark.createDataFrame([("u", "internal", dt.datetime(2030, 1, 1)), ("u", "customer:x", dt.datetime(2020, 1, 1))], "uid string, scope string, valid_until timestamp")
    got = {r.uid: r for r in access.load_principals(users, scopes, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert set(got) == {"u", "t"} and got["u"].scopes == ["internal"] and got["t"].clearance == 2


def test_secured_search_filters_before_ranking(spark):
    p = spark.createDataFrame([(i, "alpha beta " * (i + 1)) for i in range(6)], "seq long, text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id long, question string")
    seen = p.filter("seq < 3").select("seq")
    got = lexical.search_like(p, q, limit=2, visible=seen)
    assert [r.seq for r in got.orderBy("rank").collect()] == [2, 1]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")


def test_rrf(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4)], "query_id int, doc_id string, position int")
    sem = spark.createDataFrame([(1, "b", 1), (1, "d", 2)], "query_id int, doc_id string, position int")
    got = [(r.doc_id, round(r.score, 6), r.source) for r in fusion.rrf_merge(lex, sem).orderBy("position").collect()]
    assert got == [("b", 0.01653, "fts+semantic"), ("a", 0.008333, "fts"), ("d", 0.008197, "semantic"), ("c", 0.008065, "fts")]


def test_blend_and_preferred(spark):
    df = spark.createDataFrame([(1, i, -m) for i, m in enumerate([2, 0, 3, 1])], "q int, pos int, m int")
    got = [(r.pos, r.fused) for r in fusion.blend_ranks(df, "q", "m", "pos").orderBy("new_rank").collect()]
    assert got == [(1, 0.3), (0, 0.253333), (3, 0.216667), (2, 0.18)]
    pool = spark.createDataFrame([(1, i, i) for i in range(5)], "query_id int, item int, position int")
    pref = spark.createDataFrame([(1, 3, 0), (1, 9, 1), (1, 3, 2), (1, 1, 3)], "query_id int, item int, pref_position int")
    assert [r.item for r in fusion.apply_preferred_order(pool, pref, 3).orderBy("new_position").collect()] == [3, 1, 0]


def test_occurrences(spark):
    d = dt.date
    rows = [("e", "s", d(2024, 1, 1)), ("e", "s", d(2024, 1, 4)), ("e", "s", d(2024, 1, 8)), ("e", "s", None)]
    df = spark.createDataFrame(rows, "entry_key string, site string, day date")
    got = [r.occ_start for r in cases.occurrences(df).orderBy(F.asc_nulls_last("occ_start")).collect()]
    assert got == [d(2024, 1, 1), d(2024, 1, 8), None]


@pytest.mark.parametrize(("times", "fails", "want"), [
    ([0, 30, 59, 60, 100, 121], [], [0, 60, 121]), ([0, 30, 59, 60, 100, 121], [90], [0, 60, 90])])
def test_throttle(spark, times, fails, want):
    t0 = dt.datetime(2024, 1, 1, 23, 59)
    rows = [(i, "u", t0 + dt.timedelta(seconds=s), s not in fails) for i, s in enumerate(sorted(times + fails))]
    df = spark.createDataFrame(rows, "id long, uid string, ts timestamp, ok boolean")
    kept = streams.throttle_events(df, ["uid"], width=4)
    assert [int((r.ts - t0).total_seconds()) for r in kept.orderBy("id").collect()] == want
    assert streams.throttle_events(kept, ["uid"]).count() == len(want)


def steps_of(spark, numbers):
    lines = "\n".join(f"{n}. Press button {i}" for i, n in enumerate(numbers))
    p = spark.createDataFrame([("d", 1, "(1) Title", lines)], "doc_id string, seq long, section_title string, text string")
    out = procedures.split_procedures(procedures.line_stream(p), width=3).collect()
    return [[s.n for s in r.steps] for r in out]


def test_procedures(spark):
    assert steps_of(spark, [1, 2, 5, 3]) == [[1, 2, 3]]
    assert steps_of(spark, [1, 2, 2, 3]) == [[1, 2]]
    assert steps_of(spark, [1]) == []


def test_pins_keys_codes(spark):
    for text, want in [("A1~B2, 7", {"A1", "A2", "B1", "B2", "7"}), ("45~47", {"45", "46", "47"}), ("S, T, U", {"S", "T", "U"}), ("", None)]:
        got = one(spark, cd.parse_pins(F.lit(text)))
        assert (set(got) if got else None) == want
    assert {one(spark, cd.match_key(F.lit(c))) for c in ("STG-4A-1B", "4A-1B", "#4AH-1B")} == {"4A-1B"}
    alarm = "STG - FATAL - E Detail: 60730410 FFF0FE17 00000000 00000000"
    assert one(spark, qs.screen_codes(F.lit(alarm))) == ["STG-10-17"]


def test_variants(spark):
    pages = spark.createDataFrame([("d", p, m) for p, m in [(5, ""), (10, "A"), (25, ""), (40, "A"), (45, ""), (70, ""), (100, "B"), (110, "")]], "doc string, page long, mark string")
    got = {r.page: r.variant for r in wiring.page_variants(pages).collect()}
    assert [got[p] for p in (5, 25, 45, 70, 110)] == ["A", "A", "A", "", "B"]


def test_trace(spark):
    rows = [(1, "b", 1, "J1001", "J1002"), (2, "b", 2, "J1002", "J1003"), (3, "b", 2, "CN1", "J1003"), (4, "b", 3, "CN1", "J1005")]
    e = spark.createDataFrame(rows, "edge_id long, doc string, page long, a_conn string, b_conn string")
    for c in ("cable", "a_mate", "a_device", "b_mate", "b_device", "wires"):
        e = e.withColumn(c, F.lit(None).cast("string"))
    groups, pages = wiring.merge_edges(e)
    got = {r.gid: r.depth for r in wiring.trace(groups, pages, "J1001").collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    assert {r.gid for r in wiring.trace(groups, pages, "J1001", 1).collect()} <= set(got)


def test_trace_many(spark):
    """All starts together give what each gives alone; roots by key, else cable, else a part of a device name."""
    rows = [(1, 1, "J1001", "J1002", None, "Drive Unit", "1~3"), (2, 2, "J1002", "J1003", None, None, "3~4"), (3, 2, "CN1", "J1003", None, None, None),
            (4, 2, "J1003", "J1009", None, None, "9"), (5, 3, "CN1", "J1005", "4S001-002", "Ab", None), (6, 2, "J1003", "J1010", None, None, "4")]
    e = spark.createDataFrame([(i, "b", *r) for i, *r in rows],
                              "edge_id long, doc string, page long, a_conn string, b_conn string, cable string, a_device string, wires string")
    e = e.selectExpr("*", *[f"cast(null as string) {c}" for c in ("a_mate", "b_mate", "b_device")])
    groups, pages = wiring.merge_edges(e)
    texts = ["J1001", "J1003", "4S001-002", "drive", "ab", "b", "nowhere", "", None]
    starts = spark.createDataFrame(list(enumerate(texts)), "start_id long, start string")
    got = {}
    for r in wiring.trace_many(groups, pages, starts).collect():
        got.setdefault(r.start_id, []).append((r.depth, r.parent, r.via, r.gid, r.pins_unknown, r.folded))
    assert sorted((d, g, u, f) for d, _, _, g, u, f in got[0]) == [
        (0, 1, False, False), (1, 2, False, False), (2, 3, True, False), (2, 4, False, True), (2, 6, False, False)]
    assert {g for d, _, _, g, _, _ in got[1] if d == 0} == {2, 3, 4, 6} and [g for d, _, _, g, _, _ in got[2] if d == 0] == [5]
    assert {(d, g) for d, _, _, g, _, _ in got[3]} >= {(0, 1), (1, 2)} and {got[i][0][3] for i in (4, 5)} == {5}
    assert set(got) == {0, 1, 2, 3, 4, 5}
    alone = wiring.trace(groups, pages, texts[0]).collect()
    assert sorted(map(str, map(tuple, alone))) == sorted(map(str, got[0]))


def test_token_correction(spark):
    def fix(token, known, ctx=None):
        t = spark.createDataFrame([("d", 1, token)], "doc string, page int, token string")
        k = spark.createDataFrame([(x,) for x in known], "token string")
        c = spark.createDataFrame([("d", 1, x) for x in ctx], "doc string, page int, token string") if ctx else None
        return wiring.correct_tokens(t, k, context=c).first().fixed

    assert fix("75448", ["7544B"]) == "7544B"
    assert fix("22330", ["2233C", "2233D"], ["2233D"]) == "2233D"
    assert fix("22330", ["2233C", "2233D"]) is None


def test_initials(spark):
    for abbr, name, want in [("FIA", "Field Image Alignment", True), ("ILM", "Interferometric Lens Measurement", True), ("RR", "Reticle of Rotation", True), ("AB", "Alpha", False)]:
        assert one(spark, glossary.initials_ok(F.lit(abbr), F.split(F.lit(name), " "))) is want


def test_packing(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["aaa", "bb", "cccc", "d"])], "doc string, q long, text string")
    for width in (1, 2, 1000):
        assert [r.text for r in prepare.pack_windows(df, ["doc"], "q", limit=5, width=width).orderBy("window_no").collect()] == ["aaabb", "ccccd"]


def test_headings_pages_logs(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nbody a\n## B\nbody b")], "d int, text string")
    assert [(r.section_title, r.text) for r in prepare.split_by_headings(df, ["d"]).orderBy("section_no").collect()] == [("", "intro"), ("# A", "body a"), ("## B", "body b")]
    pages = spark.createDataFrame([("x", 1, 0), ("x", 2, 100)], "doc string, page int, start_offset long")
    at = spark.createDataFrame([("x", 99), ("x", 100), ("x", -1)], "doc string, position long")
    assert {r.position: r.page for r in prepare.assign_page(at, pages, ["doc"]).collect()} == {99: 1, 100: 2, -1: 1}
    log = spark.createDataFrame([(1, "2026/8/5 site\nx\n2026-08-03\ny")], "id int, text string")
    assert [str(r.day) for r in readers.parse_daily_log(log, ["id"]).orderBy("day_no").collect()] == ["2026-08-05", "2026-08-03"]


def test_scalars(spark):
    order = ["A", "B"]
    arr = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    cases_ = [((("B",), ()), 0.8), (((), ()), 1.0), ((("B",), ("A",)), 0.5), ((("A", "B"), ()), 1.0)]
    for (tags, named), want in cases_:
        assert one(spark, eq.model_factor(arr(*tags), arr(*named), order)) == want
    assert [one(spark, tx.needs_like(F.lit(t))) for t in ("漏水", "漏水检测", "ab")] == [True, False, False]
    p = spark.createDataFrame([(1, "abcABCabc")], "seq long, text string")
    q = spark.createDataFrame([(1, "abc")], "query_id int, question string")
    assert [r.score for r in lexical.search_like(p, q).collect()] == [-2]


def test_identifiers(spark):
    good = ["7214A2", "7214A2W-E", "7304A1", "4S018-922", "A-712", "IU-DRV1-X4P", "CN12", "PS1A"]
    found = one(spark, tokens.page_tokens(F.lit(" , ".join(good) + " ; PS1 CN1 A-7 words 2026-07-24")))
    assert set(good) <= set(found) and not {"PS1", "CN1", "A-7"} & set(found) and not any("2026" in x for x in found)


def test_blocks(spark):
    rows = [(1, "ordered", "a"), (2, "ordered", ""), (3, "ordered", "b"), (4, "text", "text"), (5, "ordered", "c")]
    df = spark.createDataFrame([("d", q, "p", k, t, 1, False) for q, k, t in rows], "doc_id string, seq long, parent_id string, block_type string, text string, level int, done boolean")
    assert [r.line for r in readers.blocks_to_markdown(df).orderBy("seq").collect()] == ["1. a", "2. b", "text", "1. c"]


def test_cascade(spark):
    h = spark.createDataFrame([(1, "d", 1, 1, 1), (1, "d", 2, 2, 1), (1, "d", 3, 2, 2), (1, "d", 4, 3, 1)], "query_id int, doc string, page int, channel int, rank int")
    assert [r.page for r in tokens.cascade_candidates(h).orderBy("rank").collect()] == [1, 2]


def test_sync(spark):
    listing = spark.createDataFrame([("k1", "a", 1), ("k2", "b", 2), ("k3", "c", 1), ("k4", "d", 1)], "file_id string, name string, version int")
    state = spark.createDataFrame([("k1", "a", 1, 0, False), ("k2", "b", 1, 0, False), ("k3", "c", 1, 3, False)], "file_id string, name string, version int, fails int, oversize boolean")
    got = {r.file_id: r.action for r in sync.guard_deletes(sync.diff_snapshots(listing, state)).collect()}
    assert got == {"k1": "unchanged", "k2": "changed", "k3": "gave_up", "k4": "new"}
    empty = {r.action for r in sync.guard_deletes(sync.diff_snapshots(listing.limit(0), state)).collect()}
    assert empty == {"delete_held"}


def test_strictest_and_replace(spark):
    acl = spark.createDataFrame([("n", i, lv, st) for i, (lv, st) in enumerate([(2, "approved"), (4, "approved"), (4, "pending")])], "filename string, doc_id int, sec_level int, review_status string")
    r = access.strictest_per_name(acl, "filename", ["sec_level", "review_status"]).first()
    assert (r.sec_level, r.review_status) == (4, "pending")
    cur = spark.createDataFrame([], "doc_name string, text string")
    new = spark.createDataFrame([(f"d{i}", "t") for i in range(60)], "doc_name string, text string")
    once = sinks.replace_documents(cur, new)
    assert once.count() == sinks.replace_documents(once, new).count() == 60


def test_vectors_both_paths_and_sparse_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    c = spark.createDataFrame([(i, rnd.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, rnd.normal(size=8).tolist()) for i in range(7)], "query_id long, embedding array<double>")
    a, b = (sorted(map(tuple, vectors.vector_topk(q, c, max_broadcast=n).collect())) for n in (100, 2))
    assert a == b
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words, 12))) for i in range(60)], "seq long, text string")
    vec = vectors.text_vectors(docs, "seq")
    asked = vec.withColumnRenamed("seq", "query_id").filter("query_id < 9")
    got = sorted((r.query_id, r.seq, r.score) for r in vectors.sparse_topk(asked, vec, None).collect())
    dense = {}
    for r in vec.collect():
        dense.setdefault(r.seq, {})[r.feature] = r.weight
    want = sorted((x, y, round(s, 6)) for x in range(9) for y in dense if (s := sum(w * dense[y].get(f, 0) for f, w in dense[x].items())) >= 0.3)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert top_k(docs, [], [F.col("seq")], 2).count() == 2


def test_ranked_procedures_past_former_limits(spark):
    """300 titles with one term, and a seventh term: all get a score."""
    from fieldmanual.operators import procedures

    procs = spark.createDataFrame([(i, "blue widget" if i < 300 else "lone gasket", "", "manual", ["M1"], [], 2) for i in range(301)],
                                  "proc_id long, title string, breadcrumb string, doc_type string, tags array<string>, name_tags array<string>, n_steps int")
    queries = spark.createDataFrame([(1, ["widget", "one", "two", "three", "four", "five", "gasket"], [])], "query_id long, terms array<string>, named array<string>")
    none = spark.createDataFrame([], "query_id long, proc_id long, score double")
    got = {r.proc_id for r in procedures.rank_procedures(procs, queries, none, ["M1"]).collect()}
    assert got == set(range(301))


def test_procedures_keep_long_bodies(spark):
    """A step followed by 400 lines keeps every line; a bound applies only where it is given."""
    from fieldmanual.operators import procedures

    tail = [f"see item {i}" for i in range(400)]
    lines = spark.createDataFrame([("d", 1, i, "body", x) for i, x in enumerate(["1. Check it", *tail, "2. Press it"])],
                                  "doc_id string, seq int, pos long, kind string, line string")
    steps = procedures.split_procedures(lines).first().steps
    text, detail = steps[0]["text"], steps[0]["detail"]
    assert f"{text} {detail}".split() == " ".join(["Check it", *tail]).split() and 300 <= len(text) < 320 and steps[1]["text"] == "Press it"
    assert procedures.split_procedures(lines, max_detail=50).first().steps[0]["detail"] == detail[:50]


def test_beyond_former_caps(spark):
    """Nine levels, 100 table rows, five cells, 70 new abbreviations, a passage longer than a window."""
    from fieldmanual.operators import glossary, prepare
    from fieldmanual.sources import readers

    nodes = spark.createDataFrame([(i, i - 1 or None, f"n{i}") for i in range(1, 10)] + [(5, 9, "loop")], "node_id int, parent_id int, title string")
    paths = {(r.node_id, r.depth): r.path for r in readers.tree_paths(nodes).collect()}
    assert len(paths) == 9 and paths[9, 9] == "/".join(f"n{i}" for i in range(1, 10))
    code = [chr(65 + i // 26) + chr(65 + i % 26) + "X" for i in range(100)]
    table = "| Abbreviation | b | c | d | e |\n" + "\n".join(f"| {c} | one | two | three | four |" for c in code)
    mined = glossary.mine_tables(spark.createDataFrame([(1, "d", table)], "seq int, doc_name string, text string"))
    assert mined.count() == 400 and mined.select("abbr").distinct().count() == 100
    free = spark.createDataFrame([("d", " ".join(code[:70]))], "doc_name string, text string")
    assert glossary.missing_abbreviations(free, spark.createDataFrame([], "abbr string")).count() == 70
    long = spark.createDataFrame([("d", 1, "ab"), ("d", 2, "0123456789xyz"), ("d", 3, "cd")], "doc string, q int, text string")
    got = prepare.pack_windows(long, ["doc"], "q", limit=5, measure="piece").orderBy("window_no").collect()
    assert [r.text for r in got] == ["ab", "01234", "56789", "xyz", "cd"] and [r.window_no for r in got] == list(range(1, 6))
