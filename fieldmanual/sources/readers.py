"""Readers: text folders, records, sheets, notes, logs, code files, listings, glossary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmanual.functions.rules import blank_to_null
from fieldmanual.functions.text import outer_json, short_id, whole_or_sections
from fieldmanual.operators import ordered as od


def read_text_corpus(spark: SparkSession, folder: str, patterns: str = "*.md;*.txt", doc_type: str = "manual") -> DataFrame:
    """Passages of every matching text file below a folder; files under five characters are left out."""
    globs = [p.strip() for p in patterns.split(";") if p.strip()]
    raw = (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "{" + ",".join(globs) + "}").text(folder)
           .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")))
    docs = (raw.filter(F.length("text") >= 5).dropDuplicates(["file_path"])
            .withColumn("doc_id", short_id("file_path")).withColumn("doc_type", F.lit(doc_type))
            .withColumn("doc_name", F.element_at(F.split("file_path", "/"), -1)))
    return (docs.select("doc_id", "doc_name", "doc_type", "file_path", F.posexplode(whole_or_sections("text")).alias("seq", "s"))
            .select("doc_id", "doc_name", "doc_type", "file_path", F.col("seq").cast("long").alias("seq"),
                    F.col("s.title").alias("section_title"), F.col("s.body").alias("text")))


# Fields of a fault record in the order of its text lines.
FAULT_FIELDS = ("fault_date", "machine_id", "machine_model", "symptom", "error_code", "root_cause", "solution", "engineer")


def fault_record_text(labels: Mapping[str, str] | None = None) -> Column:
    """Seven labelled lines of one fault record; missing values are empty."""
    labels = labels or {}

    def v(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    machine = F.concat(v("machine_id"), F.lit(" "), v("machine_model"))
    lines = [("fault_date", v("fault_date")), ("machine", machine), ("error_code", v("error_code")), ("symptom", v("symptom")),
             ("root_cause", v("root_cause")), ("solution", v("solution")), ("engineer", v("engineer"))]
    return F.concat_ws("\n", *[F.concat(F.lit(labels.get(k, k) + ": "), c) for k, c in lines])


def read_fault_records(df: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """One passage per fault record, titled by its code."""
    code = F.coalesce(F.col("error_code").cast("string"), F.lit(""))
    return (df.withColumn("text", fault_record_text(labels)).withColumn("section_title", code)
            .withColumn("error_codes", F.when(code != "", F.array(code)).otherwise(F.array().cast("array<string>"))))


def rows_to_text(df: DataFrame, header: Sequence[tuple[str, str]], sheet: Column, row_no: Column, keep: Sequence[str]) -> DataFrame:
    """``h: v | h: v`` per data row; empty cells and empty rows dropped, rows counted from 2.

    Only missing and blank cells are empty: a zero is a value here.
    """
    cells = []
    for c, label in header:
        v = blank_to_null(F.col(c).cast("string"))
        cells.append(F.when(v.isNotNull(), F.concat(F.lit(f"{label}: "), v) if label else v))
    text = F.array_join(F.array_compact(F.array(*cells)), " | ")
    return (df.withColumn("text", text).filter("text <> ''")
            .withColumn("section_title", F.concat(F.lit("Sheet:"), sheet, F.lit(" Row:"), (row_no + 1).cast("string")))
            .select(*keep, "section_title", "text"))


def parse_front_matter(df: DataFrame, text: str = "text", list_fields: Sequence[str] = ("tags", "error_codes")) -> DataFrame:
    """Flat ``key: value`` front matter as a map, list fields as arrays, description put before the body.

    Text without a closed front block keeps an empty map and its whole body.
    """
    block = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)"
    c = F.col(text)
    has = c.rlike(block)
    pairs = F.transform(F.filter(F.split(F.regexp_extract(c, block, 1), "\n"), lambda x: x.rlike(r"^\s*[A-Za-z_]+\s*:")),
                        lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))).alias("k"),
                                           F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    # The last of a repeated key counts, so keys are made unique before the map is built.
    unique = F.filter(pairs, lambda p, i: F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))),
                                                   lambda q: q["k"] == p["k"]) == F.lit(False))
    meta = F.when(has, F.map_from_entries(unique)).otherwise(F.create_map().cast("map<string,string>"))
    rest = F.when(has, F.regexp_replace(c, block, "")).otherwise(c)
    out = df.withColumn("meta", meta).withColumn("__rest", rest)
    for f in list_fields:
        raw = F.regexp_replace(F.coalesce(F.try_element_at("meta", F.lit(f)), F.lit("")), r"[\[\]'\"]", "")
        out = out.withColumn(f, F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != ""))
    day = F.coalesce(F.try_element_at("meta", F.lit("fault_date")), F.try_element_at("meta", F.lit("timestamp")))
    desc = F.nullif(F.try_element_at("meta", F.lit("description")), F.lit(""))
    return (out.withColumn("fault_date", day).withColumn("body", F.concat_ws("\n\n", desc, F.trim("__rest")))
            .withColumn("title", F.try_element_at("meta", F.lit("title"))).drop("__rest"))


DAY_LINE = r"^[ \t　]*(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})(?:[ \t　]+([^\n]*))?$"


def parse_daily_log(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """(keep, day_no, day, title, text): one row per dated part of a log, in file order."""
    cut = F.split(F.col(text), r"(?m)(?=^[ \t　]*\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}(?:[ \t　].*)?$)")
    rows = df.select(*keep, F.posexplode(cut).alias("day_no", "part"))
    first = F.regexp_extract("part", r"^\n*([^\n]*)", 1)
    y, m, d = (F.regexp_extract("__first", DAY_LINE, i) for i in (1, 2, 3))
    day = F.to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    title = F.trim(F.regexp_extract("__first", DAY_LINE, 4))
    body = F.trim(F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(F.trim(
        F.regexp_replace(F.regexp_replace("part", r"^\n*[^\n]*\n?", ""), r"^\s+|\s+$", "")), F.lit(""))))
    return (rows.withColumn("__first", first).filter(F.col("__first").rlike(DAY_LINE))
            .select(*keep, "day_no", day.alias("day"), title.alias("title"), body.alias("text")).filter("text <> ''"))


def parse_sectioned_codes(df: DataFrame, keep: Sequence[str], text: str = "text", controller: Column | None = None) -> DataFrame:
    """(keep, code, title, details, aliases, text): a code file cut at ``#HH H`` lines.

    Lines that start with ``!`` are comments.  A two-digit section gets field-notation aliases for the
    code and each of its detail lines.
    """
    lines = F.filter(F.split(F.regexp_replace(F.col(text), "\r", ""), "\n"), lambda x: ~x.startswith("!"))
    clean = F.array_join(lines, "\n")
    cut = F.split(clean, r"(?m)(?=^#(?:[0-9A-Fa-f]{8}|[0-9A-Fa-f]{2})\s?H)")
    rows = df.withColumn("__c", controller if controller is not None else F.lit("")).select(
        *keep, "__c", F.posexplode(cut).alias("part_no", "part"))
    code = F.upper(F.regexp_extract("part", r"^#([0-9A-Fa-f]{8}|[0-9A-Fa-f]{2})\s?H", 1))
    body = F.regexp_replace("part", r"^#[0-9A-Fa-f]+\s?H[ \t]*:?", "")
    title = F.trim(F.regexp_extract(body, r"^\s*([^\n]+)", 1))
    details = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^\s*([0-9A-Fa-f]{2})H\s*:"), 1), F.upper))
    rows = rows.withColumn("code", code).filter("code <> ''").withColumn("title", title).withColumn(
        "details", details).withColumn("body", F.regexp_replace(body, r"^\s+|\s+$", ""))
    base = F.concat_ws("-", F.nullif("__c", F.lit("")), F.col("code"))
    aliases = F.when(F.length("code") == 2, F.concat(F.array(base), F.transform("details", lambda x: F.concat(base, F.lit("-"), x))
                                                     )).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("aliases", aliases).select(
        *keep, "part_no", "code", "title", "details", "aliases",
        F.concat_ws("\n", F.nullif(F.array_join("aliases", " "), F.lit("")), F.col("body")).alias("text"))


def code_details(sections: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, main, detail, title, text): detail lines of a section with their deeper-indented continuation."""
    lines = sections.select(*keep, F.col("code").alias("main"), "title", F.split("text", "\n").alias("lines"))
    start = F.struct(F.lit(-1).alias("n"), F.array().cast("array<struct<d:string,ind:int,t:string>>").alias("out"),
                     F.lit(False).alias("open"))

    def indent(x):
        return F.length(F.regexp_extract(x, r"^(\s*)", 1))

    def add(acc, x):
        d = F.upper(F.regexp_extract(x, r"^\s*([0-9A-Fa-f]{2})H\s*:", 1))
        last = F.try_element_at(acc["out"], F.lit(-1))
        deeper = (d == "") & acc["open"] & (F.trim(x) != "") & (indent(x) > last["ind"])
        opened = F.concat(acc["out"], F.array(F.struct(d.alias("d"), indent(x).alias("ind"), F.trim(x).alias("t"))))
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(
            last["d"].alias("d"), last["ind"].alias("ind"), F.concat(last["t"], F.lit("\n"), F.trim(x)).alias("t"))))
        return F.struct(acc["n"].alias("n"), F.when(d != "", opened).when(deeper, grown).otherwise(acc["out"]).alias("out"),
                        ((d != "") | deeper).alias("open"))

    out = F.aggregate("lines", start, add, lambda a: a["out"])
    return (lines.select(*keep, "main", "title", F.explode(out).alias("x"))
            .select(*keep, "main", F.col("x.d").alias("detail"), "title", F.col("x.t").alias("text")))


# Fixed value: tasks that share the rows of a lookup.
TASKS = 240


def lookup_code_definition(asked: DataFrame, sections: DataFrame, details: DataFrame, tables: DataFrame | None = None,
                           key: str = "query_id", unit: str = "unit") -> DataFrame:
    """(key, unit, main, detail, source, title, text): definitions of the asked codes, or ``not found``.

    ``sections`` and ``details`` come from code files; ``tables`` (unit, main, detail, title, text) from
    table chapters, where a detail matches the end of the asked digits.  Code files grow many times over when they are
    cut, which the planner does not see, so no side is broadcast: all are sorted by unit and code, in small tasks.
    """
    asked = asked.repartition(TASKS, unit, "main")
    titles = sections.select(unit, F.col("code").alias("main"), "title").hint("merge")
    texts = details.select(unit, "main", "detail", "text").hint("merge")
    one = (asked.join(titles, [unit, "main"]).join(texts, [unit, "main", "detail"], "left")
           .select(key, unit, "main", "detail", F.lit("code file").alias("source"), "title", "text"))
    both = one
    if tables is not None:
        t = tables.select(unit, "main", F.col("detail").alias("__d"), "title", "text")
        two = (asked.join(t, [unit, "main"]).filter(F.col("detail").isNull() | F.col("detail").endswith(F.col("__d")))
               .select(key, unit, "main", "detail", F.lit("table").alias("source"), "title", "text"))
        both = one.unionByName(two)
    found = both.select(key, unit, "main", "detail").distinct().withColumn("__f", F.lit(True))
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (key, unit, "main", "detail")]
    none = (asked.alias("a").join(found.hint("merge").alias("f"), cond, "left_anti").select(
        key, unit, "main", "detail", F.lit("not found").alias("source"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("text")))
    return both.unionByName(none)


def pages_to_passages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text",
                      blank: str = r"intentionally (?:left )?blank") -> DataFrame:
    """One passage per page; short pages and blank-page notices dropped."""
    t = F.trim(text)
    keep = (F.length(t) >= 20) & ~(F.lower(t).rlike(blank) & (F.length(t) < 200))
    return pages.filter(keep).select(
        F.concat_ws("_", F.col(doc).cast("string"), F.col(page).cast("string")).alias("passage_id"), doc, page,
        F.concat(F.lit("第"), F.col(page).cast("string"), F.lit("页")).alias("section_title"), F.col(text).alias("text"))


def tree_paths(nodes: DataFrame, max_depth: int | None = None, exclude: Sequence[str] = (), node: str = "node_id",
               parent: str = "parent_id", title: str = "title") -> DataFrame:
    """(node, path, depth): ancestor titles joined by ``/``, excluded words pruning their subtree.

    A level is one join with the level above, until a level is empty or ``max_depth`` is reached; a node below itself
    is left out.
    """
    def allowed(df):
        for word in exclude:
            df = df.filter(~F.col(title).contains(word))
        return df

    base = allowed(nodes.select(node, parent, title))
    level = base.filter(F.col(parent).isNull()).select(node, F.col(title).alias("path"), F.lit(1).alias("depth"), F.array(node).alias("__above"))
    out, depth = level.drop("__above"), 1
    while max_depth is None or depth < max_depth:
        depth += 1
        up = level.select(F.col(node).alias(parent), F.col("path").alias("__p"), "__above")
        level = od.cut_lineage(base.join(up, parent).filter(~F.array_contains("__above", F.col(node))).select(
            node, F.concat_ws("/", "__p", title).alias("path"), F.lit(depth).alias("depth"), F.concat("__above", F.array(node)).alias("__above")))
        if level.isEmpty():
            break
        out = out.unionByName(level.drop("__above"))
    return out


def blocks_to_markdown(blocks: DataFrame, doc: str = "doc_id", seq: str = "seq", width: int = od.WIDTH) -> DataFrame:
    """(doc, seq, line): typed blocks as markdown lines, ordered items numbered per parent.

    Numbering restarts after a block of another type under the same parent; empty ordered items,
    images, the page block and unknown types neither count nor restart.  ``block_type`` is one of
    page, heading, text, bullet, ordered, todo, code, quote, image.
    """
    known = F.col("block_type").isin("heading", "text", "bullet", "todo", "code", "quote")
    t = F.trim(F.coalesce("text", F.lit("")))
    b = blocks.withColumn("__t", t).withColumn("__reset", (known & (F.col("__t") != "")).cast("int"))
    b = b.withColumn("__num", ((F.col("block_type") == "ordered") & (F.col("__t") != "")).cast("int"))
    keys = [doc, "parent_id"]
    b = od.running_sum(b, keys, seq, "__reset", "__island", width=width)
    b = od.running_sum(b, [*keys, "__island"], seq, "__num", "__n", width=width)
    level = F.least(F.coalesce("level", F.lit(1)), F.lit(6))
    kind = F.col("block_type")
    line = (F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("__t")))
            .when(kind == "bullet", F.concat(F.lit("- "), F.col("__t")))
            .when(kind == "todo", F.concat(F.when(F.coalesce("done", F.lit(False)), "- [x] ").otherwise("- [ ] "), F.col("__t")))
            .when(kind == "code", F.concat(F.lit("```\n"), F.col("__t"), F.lit("\n```")))
            .when(kind == "quote", F.concat(F.lit("> "), F.col("__t")))
            .when(kind == "ordered", F.concat(F.col("__n").cast("string"), F.lit(". "), F.col("__t")))
            .when(kind.isin("text", "image"), F.col("__t")))
    return b.filter((F.col("__t") != "") & line.isNotNull()).select(doc, seq, line.alias("line"))


def join_lines(lines: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """One markdown text per document, for callers that need it as a value."""
    return lines.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "line"))),
                                                          lambda x: x["line"]), "\n\n").alias("markdown"))


# Fields of one wiring connection.
CONNECTION = T.ArrayType(T.StructType([
    T.StructField("cable", T.StringType()), T.StructField("wires", T.StringType()), T.StructField("note", T.StringType()),
    *[T.StructField(end, T.StructType([T.StructField(f, T.StringType()) for f in ("conn", "mate", "device", "device_no", "ref")]))
      for end in ("a", "b")]]))


def extract_json(df: DataFrame, c: str, schema, kind: str = "array", out: str = "parsed") -> DataFrame:
    """Parse the widest JSON span of a noisy text; failure gives NULL."""
    return df.withColumn(out, F.from_json(outer_json(c, kind), schema))


def connection_edges(df: DataFrame, c: str, keep: Sequence[str]) -> DataFrame:
    """Edge columns of the connection objects in a model answer, NULL as empty text."""
    rows = extract_json(df, c, CONNECTION).select(*keep, F.explode("parsed").alias("x"))

    def s(p):
        return F.coalesce(F.col(f"x.{p}"), F.lit(""))

    ends = [s(f"{e}.{f}").alias(f"{e}_{f}") for e in ("a", "b") for f in ("conn", "mate", "device", "device_no", "ref")]
    return rows.select(*keep, s("cable").alias("cable"), s("wires").alias("wires"), s("note").alias("note"), *ends)


def page_status(df: DataFrame, c: str, keep: Sequence[str], tokens: str = "tokens") -> DataFrame:
    ok = F.from_json(outer_json(c), CONNECTION).isNotNull()
    return df.select(*keep, F.when(ok, "ok").otherwise("fail").alias("status"), F.col(tokens))


GLOSSARY_COLUMNS = "abbr string, en string, ja string, zh string, note string"


def read_glossary_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(abbr, ord, en, ja array, zh array, note, src) of a hand-written table; several rows are several senses."""
    raw = spark.read.option("wholetext", True).text(path)
    lines = raw.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    return glossary_senses(lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#")))


def glossary_senses(lines: DataFrame) -> DataFrame:
    cells = F.transform(F.split("line", "\t"), lambda x: F.trim(x))

    def cell(i):
        return F.coalesce(F.get(cells, F.lit(i)), F.lit(""))

    def names(i):
        return F.filter(F.transform(F.split(cell(i), "/"), lambda x: F.trim(x)), lambda x: x != "")

    return lines.select(F.upper(cell(0)).alias("abbr"), "ord", cell(1).alias("en"), names(2).alias("ja"), names(3).alias("zh"),
                        cell(4).alias("note"), F.lit("manual").alias("src")).filter("abbr <> ''")


def import_labelled_sheet(df: DataFrame, label_map: Mapping[str, str], first: str, day: str = "reg_date",
                          code: str = "error_code") -> DataFrame:
    """Rename labelled columns to case fields, tolerate missing ones, blank dashes, dates to ISO, review confirmed."""
    picked = []
    for label, name in label_map.items():
        picked.append((F.col(f"`{label}`") if label in df.columns else F.lit(None).cast("string")).alias(name))
    out = df.filter(blank_to_null(F.col(f"`{first}`").cast("string")).isNotNull()).select(*picked)
    if day in out.columns:
        out = out.withColumn(day, F.date_format(F.col(day).cast("timestamp"), "yyyy-MM-dd"))
    if code in out.columns:
        out = out.withColumn(code, F.when(F.trim(code).isin("-", "—"), "").otherwise(F.coalesce(code, F.lit(""))))
    return out.withColumn("review", F.lit("confirmed"))


def forward_fill_hierarchy(df: DataFrame, order: str, sheet: Sequence[str] = ("sheet",), code_pattern: str = r"^[0-9A-F]{2}-[0-9A-FX]{2}$",
                           group_pattern: str | None = None, name_only: bool = False, width: int = od.WIDTH) -> DataFrame:
    """(sheet, entry_no, entry fields, cause_no, rate, cause, step_no, check, details): sparse guide rows carried down.

    Columns: axis, idx, code, name, rate, cause, check, details.  A code row (or a numbered name) opens an
    entry, a cause opens a cause, a check opens a step; a lone detail joins the step above with ``；``.
    Axis and group labels carry down.  Entries with neither code nor cause are dropped.
    """
    def v(c):
        return blank_to_null(F.col(c).cast("string"))

    is_code = F.coalesce(v("code").rlike(code_pattern), F.lit(False))
    keys = list(sheet)
    b = df.withColumn("__group", F.when(v("code").rlike(group_pattern) & ~is_code, v("code")) if group_pattern else F.lit(None).cast("string"))
    b = b.withColumn("__axis", F.when(~F.coalesce(v("axis").rlike(code_pattern), F.lit(False)), F.element_at(F.split(v("axis"), r"\s+"), 1)))
    b = od.carry_many(b, keys, order, {"__group_c": F.col("__group"), "__axis_c": F.col("__axis")}, width=width)
    b = b.filter(F.col("__group").isNull())
    opens = (v("name").isNotNull() & v("idx").rlike(r"^\d+(\.\d+)?$")) if name_only else is_code
    b = b.withColumn("__open", F.coalesce(opens, F.lit(False)).cast("int"))
    b = od.cut_lineage(od.running_sum(b, keys, order, "__open", "entry_no", width=width).filter("entry_no > 0"))
    ek = [*keys, "entry_no"]
    # A check or detail before any cause opens an unnamed one.
    has = v("cause").isNotNull()
    work = v("check").isNotNull() | v("details").isNotNull()
    b = b.withColumn("__has", has.cast("int")).withColumn("__work", work.cast("int"))
    b = od.running_sum(b, ek, order, "__has", "__named", width=width)
    b = od.running_sum(b.withColumn("__blank", F.when((F.col("__named") == 0) & (F.col("__work") == 1), 1).otherwise(0)),
                       ek, order, "__blank", "__blanks", width=width)
    b = b.withColumn("cause_no", F.col("__named") + F.least(F.col("__blanks"), F.lit(1)))
    ck = [*ek, "cause_no"]
    b = od.cut_lineage(od.running_sum(b.withColumn("__chk", v("check").isNotNull().cast("int")), ck, order, "__chk", "step_no", width=width))
    title = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(v("name").isNotNull(), F.struct(F.col(order).alias("o"), v("name").alias("t"))))),
                                     lambda x: x["t"]), " ") if name_only else F.min_by(F.coalesce(v("name"), v("code")), order)
    heads = b.groupBy(*ek).agg(
        F.min_by(F.when(is_code, v("code")), order).alias("error_code"), title.alias("title"),
        F.min_by("__axis_c", order).alias("axis"), F.min_by("__group_c", order).alias("group"), F.max("cause_no").alias("n_causes"))
    heads = heads.filter((F.col("n_causes") > 0) | F.col("error_code").isNotNull()).withColumn(
        "title", F.when(F.col("group").isNotNull(), F.concat("title", F.lit("（"), F.col("group"), F.lit("）"))).otherwise(F.col("title")))
    causes = b.filter("cause_no > 0").groupBy(*ck).agg(
        F.coalesce(F.min_by(v("cause"), F.when(has, F.col(order))), F.lit("(no cause given)")).alias("cause"),
        F.coalesce(F.max(F.when(has, v("rate").try_cast("int"))), F.col("cause_no")).alias("rate"))
    parts = F.array_sort(F.collect_list(F.when(v("details").isNotNull(), F.struct(F.col(order).alias("o"), v("details").alias("d")))))
    steps = b.filter("cause_no > 0 and __work = 1").groupBy(*ck, "step_no").agg(
        F.max(v("check")).alias("check"), parts.alias("p")).withColumn(
        "details", F.array_join(F.transform("p", lambda x: x["d"]), "；")).drop("p")
    return (heads.drop("n_causes").join(causes, ek, "left").join(steps, ck, "left"))


def per_machine(entries: DataFrame, machines: Sequence[str]) -> DataFrame:
    """One copy of every entry for each machine."""
    return entries.withColumn("machine", F.explode(F.array(*[F.lit(m) for m in machines])))


