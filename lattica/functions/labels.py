"""Label sets as sorted ARRAY<STRING> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _array(labels: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in labels)) if labels else F.array().cast("array<string>")


def canonical(labels: Column) -> Column:
    """Sorted and distinct, so that equal sets are equal arrays; null is the empty set."""
    return F.array_sort(F.array_distinct(F.coalesce(labels, _array([]))))


def with_labels(labels: Column, add: list[str], where: Column | None = None) -> Column:
    """The set with further labels, in the rows where the condition holds."""
    both = canonical(F.array_union(F.coalesce(labels, _array([])), _array(add)))
    return both if where is None else F.when(where, both).otherwise(canonical(labels))


def has_any(labels: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(labels, _array(wanted)), F.lit(False))


def has_all(labels: Column, wanted: list[str]) -> Column:
    return F.size(F.array_intersect(F.coalesce(labels, _array([])), _array(wanted))) == len(set(wanted))


def name_matches(name: Column, patterns: list[str]) -> Column:
    """Whether a name fits a pattern wholly: `*` stands for anything, `|` for itself. No pattern fits nothing."""
    if not patterns:
        return F.lit(False)
    return name.rlike("^(" + "|".join(p.replace("|", "\\|").replace("*", ".*") for p in patterns) + ")$")
