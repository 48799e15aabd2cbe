"""Full-text search over passages: substring terms, Okapi scores, LIKE fallback.

A query term holds no blank, so each of its occurrences lies inside one blank-separated word.  Terms
are therefore matched against the vocabulary, through shared n-grams, and passages are reached by an
equi-join on the word.  One anchor term per query finds the candidates; the other terms are verified
on the candidate's text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmanual.functions import text as tx
from fieldmanual.operators.ordered import cut_lineage, top_k
from fieldmanual.operators.search_index import SearchIndex

# Okapi parameters (Robertson & Zaragoza 2009).
K1, B = 1.2, 0.75


def haystack(cols: Sequence[str]):
    return F.concat_ws("\n", *[F.col(c) for c in cols])


def build_trigram_index(passages: DataFrame, seq: str = "seq", cols: Sequence[str] = ("text",)) -> DataFrame:
    """Postings (gram, seq, tf) of the case-folded three-character substrings."""
    grams = tx.ngrams(haystack(cols), 3)
    # Texts are dealt by passage before they are cut, so that no gram is shuffled for its count.
    return (passages.select(*dict.fromkeys([seq, *cols])).repartition(seq).select(seq, F.explode(grams).alias("gram"))
            .groupBy("gram", seq).agg(F.count("*").alias("tf")))


def build_word_index(passages: DataFrame, seq: str = "seq", cols: Sequence[str] = ("text",)) -> DataFrame:
    """Postings (word, seq, n) of the blank-separated words, case-folded.  Write it once, search it often."""
    words = F.filter(F.split(F.lower(haystack(cols)), r"\s+"), lambda w: w != "")
    return passages.select(seq, F.explode(words).alias("word")).groupBy("word", seq).agg(F.count("*").alias("n"))


def prepare_queries(queries: DataFrame, key: str = "query_id", question: str = "question") -> DataFrame:
    """(key, terms, anchor): distinct case-folded terms and the longest of them."""
    terms = F.array_distinct(F.transform(tx.query_words(question), F.lower))
    anchor = F.array_max(F.transform(F.col("terms"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    return (queries.select(key, tx.query_words(question).alias("raw_terms"), terms.alias("terms"))
            .filter(F.size("terms") > 0).withColumn("anchor", anchor["t"]))


def terms_in_words(terms: DataFrame, vocab: DataFrame | None, tails: DataFrame | None = None) -> DataFrame:
    """(term, word, times) for every vocabulary word that contains a term.

    A term is looked up by its rarest gram (three characters, or the whole of a shorter term) among the ``tails``
    (tail, word) that an index stores, or those of ``vocab``.
    """
    t = terms.select("term").distinct().withColumn("g", F.least(F.length("term"), F.lit(3)))
    term_grams = (t.select("term", "g", F.explode(tx.tails("term", 3)).alias("tail")).filter(F.length("tail") >= F.col("g"))
                  .select("term", F.substr("tail", F.lit(1), F.col("g")).alias("gram")).distinct())
    wanted = term_grams.select("gram").distinct()
    # At most three lengths, in one row.
    sizes = F.broadcast(t.agg(F.collect_set("g").alias("sizes")))
    heads = F.transform(F.filter("sizes", lambda n: n <= F.length("tail")), lambda n: F.substr(F.col("tail"), F.lit(1), n))
    if tails is None:
        tails = vocab.select("word").distinct().select("word", F.explode(tx.tails("word", 3)).alias("tail"))
    word_grams = (tails.join(sizes, F.lit(True)).select("word", F.explode(heads).alias("gram")).join(wanted, "gram", "left_semi"))
    word_grams = cut_lineage(word_grams)
    # The rarest gram is chosen on counts; a term with an unseen gram matches nothing.
    weight = word_grams.groupBy("gram").agg(F.count("*").alias("words"))
    anchor = (term_grams.join(weight, "gram", "left").groupBy("term")
              .agg(F.min_by("gram", F.struct("words", "gram")).alias("gram"), F.bool_and(F.col("words").isNotNull()).alias("seen"))
              .filter("seen").select("term", "gram"))
    return (word_grams.join(anchor, "gram").filter(F.col("word").contains(F.col("term")))
            .select("term", "word").distinct().withColumn("times", tx.occurrences(F.col("word"), F.col("term"))))


def term_passages(terms: DataFrame, postings: DataFrame, seq: str = "seq") -> DataFrame:
    """(term, seq) of the passages that contain each term."""
    found = terms_in_words(terms, postings)
    return postings.join(found, "word").select("term", seq).distinct()


def indexed_passages(terms: DataFrame, index: SearchIndex) -> DataFrame:
    """(term, seq) of the passages that contain each term, from the postings of the words that contain it."""
    found = cut_lineage(terms_in_words(terms, None, index.tails()).select("term", "word"))
    return index.postings(found).join(found, "word").select("term", index.seq).distinct()


def term_frequencies(terms: DataFrame, index: SearchIndex) -> DataFrame:
    """(term, df): number of passages that contain each term.

    Terms of up to three characters occur nearly everywhere; their numbers are stored in the index.  Longer ones are
    counted from the postings of their words.
    """
    t = terms.select("term").distinct()
    by_gram = index.gram_df().join(t.withColumnRenamed("term", "gram"), "gram").select(F.col("gram").alias("term"), "df")
    long = t.filter(F.length("term") > 3)
    return by_gram.unionByName(indexed_passages(long, index).groupBy("term").agg(F.count("*").alias("df")))


def candidates(prepared: DataFrame, index: SearchIndex, key: str, visible: DataFrame | None = None) -> DataFrame:
    """(key, seq) of the passages, among ``visible`` ones if given, that contain the anchor term of a query."""
    anchors = prepared.select(key, F.col("anchor").alias("term"))
    met = indexed_passages(anchors, index)
    if visible is not None:
        met = met.join(visible.select(index.seq).distinct(), index.seq, "left_semi")
    return met.join(anchors, "term").select(key, index.seq)


def _verified(index: SearchIndex, prepared: DataFrame, key: str, visible: DataFrame | None, where, keep: Sequence[str]) -> DataFrame:
    """(key, seq, terms, raw_terms, __hay, ...) of passages that hold all terms of a query and meet ``where`` (a condition on stored columns)."""
    rows = index.passages()
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(index.seq, "__hay", "__len", *[F.col(c).alias(f"__{c}") for c in keep])
    return (rows.join(candidates(prepared, index, key, visible), index.seq).join(prepared.select(key, "raw_terms", "terms"), key)
            .filter(F.forall("terms", lambda t: F.col("__hay").contains(t))))


def search_like(passages: DataFrame | None, queries: DataFrame, key: str = "query_id", question: str = "question",
                seq: str = "seq", text: str = "text", cols: Sequence[str] = ("text",), limit: int | None = 8,
                index: SearchIndex | None = None, visible: DataFrame | None = None, where=None) -> DataFrame:
    """Every term must occur in one of the index's columns, ignoring case; scored by case-sensitive counts in the text.

    ``visible`` (rows of seq) and ``where`` (a condition on the passages' type, model or other columns) restrict the
    passages before ranking and limit.  Without an index, one is built from ``passages`` over ``cols``.
    """
    index = index or SearchIndex.build(passages, seq=seq, cols=cols)
    found = _verified(index, prepare_queries(queries, key, question), key, visible, where, [text])
    score = -F.aggregate("raw_terms", F.lit(0).cast("long"), lambda a, t: a + tx.occurrences(F.col(f"__{text}"), t))
    hits = found.select(key, index.seq, score.alias("score"))
    return top_k(hits, [key], [F.col("score"), F.col(index.seq)], limit) if limit else hits


def search_bm25(passages: DataFrame | None, queries: DataFrame, key: str = "query_id", question: str = "question",
                seq: str = "seq", text: str = "text", limit: int | None = 8, index: SearchIndex | None = None,
                visible: DataFrame | None = None, where=None, cols: Sequence[str] | None = None) -> DataFrame:
    """All terms of a query must occur (as case-folded substrings) in the index's columns; lower score is better.

    Term counts and lengths are taken over all passages; ``visible`` and ``where`` filter before ranking and limit.
    """
    index = index or SearchIndex.build(passages, seq=seq, cols=cols or [text])
    found = _verified(index, prepare_queries(queries, key, question), key, visible, where, [])
    tf = found.select(key, index.seq, F.col("__len").alias("len"), F.explode(F.transform(
        "terms", lambda t: F.struct(t.alias("term"), tx.occurrences(F.col("__hay"), t).alias("tf")))).alias("x")).select(key, index.seq, "len", "x.*")
    # A few rows per verified hit, read for the term counts and for the scores.
    tf = cut_lineage(tf)
    # One row, so the product is a plain column append.
    stats = F.broadcast(index.stats())
    idf = F.greatest(F.log((F.col("n_passages") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.nullif(F.col("avg_len"), F.lit(0))))
    scored = (tf.join(term_frequencies(tf, index), "term").join(stats, F.lit(True)).groupBy(key, index.seq)
              .agg((-F.round(F.sum(part), 6)).alias("score")))
    return top_k(scored, [key], [F.col("score"), F.col(index.seq)], limit) if limit else scored


def search_with_fallback(passages: DataFrame | None, queries: DataFrame, key: str = "query_id",
                         question: str = "question", index: SearchIndex | None = None, cols: Sequence[str] | None = None,
                         like_index: SearchIndex | None = None, **options) -> DataFrame:
    """Okapi search; queries with no hit, or with short ideograph terms, take the LIKE search.

    The LIKE search looks in all of ``cols`` (the text alone if not given), which ``like_index`` holds.
    """
    seq, text = options.get("seq", "seq"), options.get("text", "text")
    cols = list(cols or [text])
    index = index or SearchIndex.build(passages, seq=seq, cols=[text])
    if like_index is None:
        like_index = index if cols == [text] else SearchIndex.build(passages, seq=seq, cols=cols)
    ranked = cut_lineage(search_bm25(None, queries.filter(~tx.needs_like(question)), key, question, index=index, **options))
    rest = queries.join(ranked.select(key).distinct(), key, "left_anti")
    like = search_like(None, rest, key, question, index=like_index, **options)
    columns = ranked.columns
    return (ranked.withColumn("score", F.col("score").cast("double")).withColumn("method", F.lit("bm25"))
            .unionByName(like.select(*columns).withColumn("score", F.col("score").cast("double"))
                         .withColumn("method", F.lit("like"))))


def search_exact(passages: DataFrame | None, codes: DataFrame, key: str = "query_id", code: str = "code", **options) -> DataFrame:
    """The whole code as one phrase; short codes take the LIKE search."""
    phrase = codes.withColumn(code, F.regexp_replace(F.trim(code), r"\s+", ""))
    return search_with_fallback(passages, phrase, key, code, **options)


def retrieve_lexical(passages: DataFrame | None, questions: DataFrame, key: str = "query_id",
                     question: str = "question", codes: str | None = None,
                     expansions: str | None = None, key_terms: str | None = None, limit: int = 8, extra_limit: int = 5,
                     each: int = 4, **options) -> DataFrame:
    """First code of a question, else the question; then the first ``each`` expansions and the first ``each`` key terms."""
    main = F.regexp_replace(question, "[?？]", " ")
    if codes:
        main = F.when(F.size(codes) > 0, F.get(F.col(codes), F.lit(0))).otherwise(main)
    asks = F.array(F.struct(F.lit(0).alias("term_order"), main.alias("ask")))
    extras = [F.slice(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), 1, each) for c in (expansions, key_terms) if c]
    if extras:
        extra = F.transform(F.array_distinct(F.concat(*extras)),
                            lambda t, i: F.struct((i + 1).alias("term_order"), t.alias("ask")))
        asks = F.concat(asks, F.when(F.size(codes) > 0, F.array().cast(
            "array<struct<term_order:int,ask:string>>")).otherwise(extra) if codes else extra)
    long = (questions.select(key, F.explode(asks).alias("a")).select(key, "a.*")
            .withColumn("ask_id", F.concat_ws("#", F.col(key).cast("string"), "term_order")))
    hits = search_with_fallback(passages, long, "ask_id", "ask", limit=limit, **options)
    seq = options.get("seq", "seq")
    back = hits.join(long.select("ask_id", key, "term_order"), "ask_id")
    back = back.filter((F.col("term_order") == 0) | (F.col("rank") <= extra_limit))
    return back.select(key, seq, "score", "term_order", "rank",
                       (F.col("term_order") * max(1000, (limit or 0) + 1, extra_limit + 1) + F.col("rank")).alias("position"))


def index_status(passages: DataFrame, doc: str = "doc_id") -> DataFrame:
    return passages.agg(F.count("*").alias("passages"), F.countDistinct(doc).alias("documents"))


def indexed_paths(meta: DataFrame, path: str = "file_path", kind: str = "doc_type") -> DataFrame:
    return meta.filter(F.coalesce(F.col(path), F.lit("")) != "").select(path, kind).distinct().orderBy(path, kind)


def team_search(passages: DataFrame, queries: DataFrame, team: str, team_col: str = "team_id", **options) -> DataFrame:
    """Search inside one tenant; larger scores are better and there is no fallback."""
    view = passages.filter(F.col(team_col) == team)
    return search_bm25(view, queries, **options).withColumn("score", -F.col("score"))
