"""Very long runs of marks, digits and matches; forms of numbers are no letters."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from fieldmanual.llm import language, personal, secrets

PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_personal_is_linear():
    model = ((-1.0, []), (1.0, 0.0, 2.0))
    texts = ["1" + " ." * 500_000 + " 1", "1 " * 500_000, "1" * 1_000_000, "1" + "." * 1_000_000 + "1", " at " * 200_000 + "me" * 60 + " [at] b.org"]
    began = time.monotonic()
    for text in texts:
        personal.selected_spans(text, personal.base_spans(text), model)
    assert time.monotonic() - began < 60
    assert (0, 800_000, 800_131) in personal.proposals(texts[-1])  # a local part of any length


def test_base_addresses_match_the_plain_pattern():
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice("1234500..  a") for _ in range(draw.randrange(40)))
        plain = [(1, *m.span()) for m in PLAIN_IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [c for c in personal.base_spans(text) if c[0] == 1] == plain


def test_proposals_keep_spaced_numbers():
    text = "call (030) 123 4567 or 4111 - 1111 1111 1111, not 1 . . . . . . 23456789012"
    found = personal.proposals(text)
    assert (3, 5, 19) in found and (2, 23, 44) in found and not any(b < 49 < e for _, b, e in found)
    assert not any(b < text.index("1 . .") + 2 < e for _, b, e in found)


def test_number_forms_are_no_letters():
    model = language.LanguageModel(["en"], ["a"], language.np.zeros((1, 1)), ["a"], language.np.zeros((1, 1)), 1)
    assert [x for x, _ in language.LanguageScorer(model)(["²", "½①", "Ⅷⅷ", "a²", "一"])] == ["und", "und", "und", "en", "en"]


def test_secret_spans_of_many_matches(spark):
    draw = random.Random(3)
    texts = ["", "0123456789abcdef", *("".join(draw.choice(("x ", "é", "0123456789abcdef", "0123456789abcdef01", " ")) for _ in range(n)) for n in (5, 9, 10, 17, 40_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [tuple(s) for s in r.s] for r in docs.select("i", secrets.spans_of(F.col("text"), secrets.HEX).alias("s")).collect()}
    assert got == {i: [m.span() for m in re.finditer(secrets.HEX, t)] for i, t in enumerate(texts)}


def test_letter_runs_are_fast():
    text = "Größe über Straße, ключ и замок " * 20_000
    began = time.process_time()
    plain = re.findall(r"[^\W\d_]+", text.lower())
    middle = time.process_time()
    assert language.words_of(text) == plain
    assert time.process_time() - middle < 5 * (middle - began) + 0.1
    assert language.words_of("Ab²c ½ Ⅷ x٣y \U0001F101z") == ["ab", "c", "x", "y", "z"]
