"""Ordered rule lists compiled to columns.

A rule list is ``[(label, regex), ...]``.  Vocabulary lives with the caller, never in the engine.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(c, rules: Rules, default=None) -> Column:
    """Label of the first rule whose regex occurs in the column."""
    c, out = col(c), F.lit(default)
    for label, pattern in reversed(list(rules)):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def all_matches(c, rules: Rules) -> Column:
    """Labels of every matching rule, in rule order."""
    c = col(c)
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(label)) for label, p in rules]))


def first_prefix(c, rules: Iterable[tuple[str, str]], default=None) -> Column:
    """Value of the first ``(prefix, value)`` pair the column starts with."""
    c, out = col(c), F.lit(default)
    for prefix, value in reversed(list(rules)):
        out = F.when(c.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def any_keyword(c, words: Sequence[str]) -> Column:
    """True when any word occurs, ignoring case."""
    c = F.lower(col(c))
    return reduce(lambda a, b: a | b, [c.contains(w.lower()) for w in words], F.lit(False))


def lookup(c, mapping: dict, default=None) -> Column:
    c, out = col(c), F.lit(default)
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def blank_to_null(c) -> Column:
    """Missing text is NULL inside the engine."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def distinct_ci(arr: Column) -> Column:
    """Drop case-insensitive repeats from an array of words, keeping first spellings in order."""
    lowered = F.transform(arr, F.lower)
    return F.filter(arr, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
