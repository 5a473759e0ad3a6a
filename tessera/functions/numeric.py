"""Numeric and array functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_features(a: Column, b: Column) -> dict[str, Column]:
    """Integer-aware comparison of two lists of numbers: -1 where a side has none."""
    ok = (F.size(a) > 0) & (F.size(b) > 0)
    first = F.try_element_at(a, F.lit(1))
    both, any_ = F.array_intersect(a, b), F.array_union(a, b)

    def known(c: Column) -> Column:
        return F.when(ok, c.cast("double")).otherwise(F.lit(-1.0))

    return {
        "int_first_eq": known(first == F.try_element_at(b, F.lit(1))),
        "int_a0_in_b": known(F.array_contains(b, first)),
        "int_a0_mindiff": known(F.log1p(F.array_min(F.transform(b, lambda x: F.abs(x - first))))),
        "int_jacc": known(F.size(both) / F.size(any_)),
        "int_a_only": F.size(F.array_except(a, b)).cast("double"),
        "int_b_only": F.size(F.array_except(b, a)).cast("double"),
    }


def legal_edits(a: Column, b: Column) -> dict[str, Column]:
    """Legal forms (canonical) added, dropped, on each side and on one side only."""
    add, drop = F.array_except(b, a), F.array_except(a, b)
    return {
        "legal_added": F.size(add).cast("double"),
        "legal_dropped": F.size(drop).cast("double"),
        "legal_a": F.size(F.array_distinct(a)).cast("double"),
        "legal_b": F.size(F.array_distinct(b)).cast("double"),
        "legal_xor": (F.size(add) + F.size(drop)).cast("double"),
    }


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(low))
    return F.least(c, F.lit(high)) if high is not None else c


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def prior_shift(p: Column, odds: float) -> Column:
    """A probability under negatives ``odds`` times as frequent."""
    return p / (p + (1 - p) * odds)


def poisson_binomial(q: Column) -> Column:
    """The distribution of the number of successes of independent trials: element k is P(k)."""

    def step(pmf: Column, p: Column) -> Column:
        stay = F.concat(F.transform(pmf, lambda x: x * (1 - p)), F.array(F.lit(0.0)))
        move = F.concat(F.array(F.lit(0.0)), F.transform(pmf, lambda x: x * p))
        return F.zip_with(stay, move, lambda x, y: x + y)

    return F.aggregate(q, F.array(F.lit(1.0)), step)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 for two empty ones."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def word_z_features(a: Column, z: Column, prefix: str) -> dict[str, Column]:
    """Of words ``a`` with known scores in the map ``z``: how many, how many known, least, largest and mean score."""
    known = F.filter(F.transform(a, lambda t: F.try_element_at(z, t)), lambda x: x.isNotNull())
    return {f"{prefix}_n": F.size(a).cast("double"), f"{prefix}_k": F.size(known).cast("double"), f"{prefix}_min": F.array_min(known), f"{prefix}_max": F.array_max(known), f"{prefix}_mean": mean(known)}
