"""Language identification by known words first, backing off to ever shorter character n-grams.

Word counts per language come from a sample of labelled documents.  The model keeps words seen often enough, at most
``most_words`` of them, and the n-grams of all words; a word outside the vocabulary is scored by its longest known
n-grams, each position backing off to shorter ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmanual.llm.common import held_out, part_of, stored

# Runs of letters: word characters that are no digit and no other number form (², ½, ①, Ⅷ).
LETTERS = re.compile(r"[^\W\d_]+")
NUMBER_FORMS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
BLANKED = str.maketrans(NUMBER_FORMS, " " * len(NUMBER_FORMS))
# A set of the first plane is one bitmap; with the many ranges beyond it, every character would be held against each of them.
MAY_HOLD_NUMBERS = re.compile("[" + "".join(c for c in NUMBER_FORMS if c < "\U00010000") + "\U00010000-\U0010FFFF]")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """The words of a text, lower case."""
    text = text.lower()
    if not text.isascii() and MAY_HOLD_NUMBERS.search(text):
        text = text.translate(BLANKED)
    return LETTERS.findall(text)


@dataclass
class LanguageModel:
    """Log probabilities per language: one row of ``word_scores`` per known word, of ``gram_scores`` per known n-gram."""

    languages: list[str]
    words: list[str]
    word_scores: np.ndarray
    grams: list[str]
    gram_scores: np.ndarray
    order: int


def word_counts(labelled: DataFrame, text: str = "text", lang: str = "lang", most_held: int = 300_000) -> DataFrame:
    """``lang``, ``word``, ``count`` over all rows: counted in each task first, then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def out():
            for language, counts in held.items():
                if not counts:
                    continue
                yield pd.DataFrame({"lang": language, "word": list(counts.keys()), "count": list(counts.values())})
            held.clear()

        for batch in batches:
            for language, t in zip(batch["lang"], batch["text"]):
                if t:
                    held.setdefault(language, Counter()).update(words_of(t))
            if sum(map(len, held.values())) > most_held:
                yield from out()
        yield from out()

    parts = labelled.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).mapInPandas(count, "lang string, word string, count long")
    return parts.groupBy("lang", "word").agg(F.sum("count").alias("count"))


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """``lang``, ``gram``, ``count``: character n-grams of 1 to ``order`` letters of all words, with word-end marks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: Counter = Counter()
            for language, word, times in zip(batch["lang"], batch["word"], batch["count"]):
                w = f"^{word}$"
                for k in range(1, order + 1):
                    for i in range(len(w) - k + 1):
                        held[language, w[i:i + k]] += times
            if held:
                yield pd.DataFrame([(a, g, c) for (a, g), c in held.items()], columns=["lang", "gram", "count"])

    return words.mapInPandas(count, "lang string, gram string, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def _top(counts: DataFrame, item: str, languages: Sequence[str], most: int, least: int) -> tuple[list[str], np.ndarray]:
    """The ``most`` most frequent items that occur ``least`` times or more, and their counts by language, as Arrow columns."""
    by = [F.sum(F.when(F.col("lang") == x, F.col("count")).otherwise(0)) for x in languages]
    totals = counts.groupBy(item).agg(F.sum("count").alias("total"), F.array(*by).cast("array<long>").alias("by"))
    found = totals.where(F.col("total") >= least).orderBy(F.desc("total"), item).limit(most).select(item, "by").toArrow()
    return found[item].to_pylist(), found["by"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, len(languages)).astype(float)


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", order: int = 4, most_words: int = 200_000, most_grams: int = 100_000,
                  least: int = 2, smooth: float = 0.5) -> LanguageModel:
    """Fit on all rows with a language; the size of the model is bounded by its parameters.

    Rows with a null language or text teach nothing.  Without any row the model knows no language.
    """
    words = stored(word_counts(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang))
    grams = stored(gram_counts(words, order))
    sizes = words.groupBy("lang").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("kinds")).orderBy("lang").toPandas()
    languages = sizes["lang"].tolist()
    known, counts = _top(words, "word", languages, most_words, least)
    total = sizes["n"].to_numpy(float) if languages else np.zeros(0)
    word_scores = np.log((counts + smooth) / (total + smooth * (len(known) + 1)))
    pieces, gram = _top(grams, "gram", languages, most_grams, least)
    gram_scores = np.zeros_like(gram)
    size = np.array([len(g) for g in pieces])
    for k in range(1, order + 1):
        rows = size == k
        gram_scores[rows] = np.log((gram[rows] + smooth) / (gram[rows].sum(axis=0) + smooth * (rows.sum() + 1)))
    return LanguageModel(languages, known, word_scores, pieces, gram_scores, order)


class LanguageScorer:
    """Scores batches of texts with a model."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known = {w: i for i, w in enumerate(model.words)}
        self.grams = {g: i for i, g in enumerate(model.grams)}

    def _back_off(self, words: list[str]) -> np.ndarray:
        """Per word the mean over its positions of the log probability of the longest known n-gram that starts there."""
        rows, ends, get, lengths = [], [], self.grams.get, range(self.model.order, 0, -1)
        for word in words:
            w = f"^{word}$"
            for i in range(len(w)):
                for k in lengths:
                    if (row := get(w[i:i + k])) is not None:
                        rows.append(row)
                        break
            ends.append(len(rows))
        sums = np.concatenate([np.zeros((1, len(self.model.languages))), np.cumsum(self.model.gram_scores[rows], axis=0)])
        ends = np.array([0, *ends])
        return np.diff(sums[ends], axis=0) / np.maximum(1, np.diff(ends))[:, None]

    def __call__(self, texts) -> list[tuple[str, float]]:
        split = [words_of(t) if t else [] for t in texts]
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(split)
        fresh = {w: len(self.known) + i for i, w in enumerate(set().union(*split).difference(self.known))}
        table = np.concatenate([self.model.word_scores, self._back_off(list(fresh))])
        out = []
        self.known.update(fresh)
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = table[list(map(self.known.__getitem__, words))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        for w in fresh:
            del self.known[w]
        return out


def predict_languages(documents: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` per row, and the columns in ``keep``; the prediction sees the text alone.

    A null text, or one without a letter, is ``und`` with score 0.  Equal scores go to the first language by name.
    """
    kind = dict(documents.dtypes)[key]
    shared = documents.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))  # bounded by the model's parameters

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = LanguageScorer(LanguageModel(*shared.value))
        for batch in batches:
            texts = batch["text"].tolist()
            found = [f for low in range(0, len(texts), 512) for f in score(texts[low:low + 512])]
            yield batch.drop(columns="text").assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    slim = documents.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"), *keep)
    more = "".join(f", `{c}` {t}" for c, t in documents.select(*keep).dtypes) if keep else ""
    return slim.mapInPandas(predict, f"doc_id {kind}, held_out boolean{more}, lang_pred string, score double")


def learning_part(documents: DataFrame, key: str = "doc_id", lang: str = "lang", learn_rows: int = 20_000) -> DataFrame:
    """About ``learn_rows`` of the documents that are not held out and have a language."""
    return part_of(documents.where(~held_out(key) & F.col(lang).isNotNull()), key, learn_rows)


def identify_languages(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learn_rows: int = 20_000, **options) -> DataFrame:
    """Fit on about ``learn_rows`` of the documents that are not held out and have a language, then predict all of them.

    Repeated rows are rows of their own.  An empty table, or one without a labelled document, predicts ``und``.
    """
    return predict_languages(documents, fit_languages(learning_part(documents, key, lang, learn_rows), text, lang, **options), key, text)
