"""Equipment-family tags: inference, normalisation, matching and ranking factor."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmanual.functions.rules import Rules, all_matches, col

COMMON = "COMMON"
ALL = "ALL"


def families(c, rules: Rules) -> Column:
    return all_matches(c, rules)


def infer_from_path(path, name, folders: dict[str, str], rules: Rules, common: Sequence[str] = (),
                    default: str | None = None) -> Column:
    """Common folder, else nearest known ancestor folder, else families in the name, else default."""
    parts = F.split(col(path), "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    table = F.create_map(*[F.lit(x) for kv in folders.items() for x in kv]) if folders else None
    nearest = (F.try_element_at(F.filter(F.transform(F.reverse(dirs), lambda d: F.try_element_at(table, d)),
                                         F.isnotnull), F.lit(1)) if folders else F.lit(None))
    is_common = (F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in common])) if common else F.lit(False))
    named = all_matches(name, rules)
    return (F.when(is_common, F.lit(COMMON))
            .otherwise(F.coalesce(nearest, F.when(F.size(named) > 0, F.array_join(named, ",")), F.lit(default))))


def infer_from_content(cover, body, rules: Rules) -> Column:
    """Families named on the cover; else body families with at least max(3, 30 % of the top count)."""
    on_cover = all_matches(cover, rules)
    counts = F.array(*[F.struct(F.lit(label).alias("family"),
                                F.regexp_count(col(body), F.lit(p)).alias("n")) for label, p in rules])
    top = F.array_max(F.transform(counts, lambda s: s["n"]))
    strong = F.filter(counts, lambda s: (top >= 3) & (s["n"] >= F.greatest(F.lit(3.0), top * 0.3)))
    return F.when(F.size(on_cover) > 0, on_cover).otherwise(F.transform(strong, lambda s: s["family"]))


def normalize_tags(c, spellings: dict[str, Sequence[str]]) -> Column:
    """Split a tag text and map old spellings to families; unknown tags are upper-cased."""
    parts = F.filter(F.split(col(c), r"[,，;/\s]+"), lambda p: p != "")
    if not spellings:
        return F.array_distinct(F.transform(parts, F.upper))

    def mapped(p):
        out = F.array(F.upper(p))
        for old, new in spellings.items():
            out = F.when(F.upper(p) == old.upper(), F.array(*[F.lit(x) for x in new])).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(parts, mapped)))


def untagged(tags) -> Column:
    tags = col(tags)
    return tags.isNull() | (F.size(tags) == 0) | F.array_contains(tags, COMMON)


def matches_models(tags, want) -> Column:
    """No wish, no tag or a common tag matches; else the two sets must overlap."""
    tags, want = col(tags), col(want)
    return want.isNull() | (F.size(want) == 0) | untagged(tags) | F.coalesce(F.arrays_overlap(tags, want), F.lit(False))


def model_factor(tags, named, priority: Sequence[str]) -> Column:
    """Ranking factor: 1 or 0.5 when the question names families, else by family priority."""
    tags, named = col(tags), col(named)
    order = F.array(*[F.lit(p) for p in priority]) if priority else F.array().cast("array<string>")

    def weight(t):
        pos = F.array_position(order, t)
        return F.when(pos > 0, F.greatest(F.lit(1.0) - (pos - 1) * 0.2, F.lit(0.5))).otherwise(F.lit(0.5))

    return (F.when(untagged(tags), F.lit(1.0))
            .when(F.coalesce(F.size(named), F.lit(0)) > 0,
                  F.when(F.arrays_overlap(tags, named), F.lit(1.0)).otherwise(F.lit(0.5)))
            .otherwise(F.array_max(F.transform(tags, weight))))


def first_specific(models, default: str) -> Column:
    """First family that is neither ALL nor COMMON."""
    m = F.filter(col(models), lambda x: ~x.isin(ALL, COMMON))
    return F.coalesce(F.try_element_at(m, F.lit(1)), F.lit(default))


def or_all(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))
