"""Set measures on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_set(values: Column) -> Column:
    """Distinct members; NULL counts as the empty set."""
    return F.array_distinct(F.coalesce(values, F.array().cast("array<string>")))


def set_f1(gold: Column, predicted: Column) -> Column:
    """F1 of two label sets: both empty 1, one empty 0."""
    g, p = as_set(gold), as_set(predicted)
    hits = F.size(F.array_intersect(g, p)).cast("double")
    total = F.size(g) + F.size(p)
    return (
        F.when(total == 0, F.lit(1.0))
        .when((F.size(g) == 0) | (F.size(p) == 0), F.lit(0.0))
        .otherwise(2.0 * hits / total)
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united members, both empty 1."""
    x, y = as_set(a), as_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(x, y)).cast("double") / union
    )


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(as_set(a), as_set(b))) == 0
