"""Decisions: one entity for a record, expected-F selection, lists of exceptions, vetoes and the order they apply in."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import best_first


def assign(p: DataFrame, threshold: float, rid: str = "rid", sid: str = "sid", score: str = "p") -> DataFrame:
    """(rid, sid, score): every record's best entity, where its score reaches the threshold."""
    best = p.filter(F.col(score) >= threshold).groupBy(rid).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(sid)).alias("n"))).alias("b"))
    return best.select(rid, (-F.col("b.n")).alias(sid), F.col("b.s").alias(score))


def assign_by_rank(p: DataFrame, threshold: float, rid: str = "rid", sid: str = "sid", score: str = "p") -> DataFrame:
    """As ``assign``, for entity keys that aren't numbers."""
    out = p.withColumn("rn", F.row_number().over(best_first(rid, score, [sid]))).filter("rn = 1").drop("rn")
    return out.filter(F.col(score) >= threshold)


def in_list(d: DataFrame, pairs: DataFrame, name: str, keys: tuple[str, str] = ("rid", "sid")) -> DataFrame:
    """``d`` with a flag for pairs that a list holds."""
    return d.join(pairs.select(*keys).distinct().withColumn(name, F.lit(True)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def override(d: DataFrame, restore: DataFrame, reject: DataFrame, score: str = "q") -> DataFrame:
    """Scores of restored pairs become 1, then those of rejected pairs 0."""
    d = in_list(in_list(d, restore, "is_restored"), reject, "is_rejected")
    return d.withColumn(score, F.when(F.col("is_rejected"), 0.0).when(F.col("is_restored"), 1.0).otherwise(F.col(score))).drop("is_restored", "is_rejected")


def veto(main: DataFrame, second: DataFrame, rid: str = "rid", sid: str = "sid", score: str = "q") -> DataFrame:
    """The lesser of two models' scores where both choose one entity, else 0."""
    other = second.select(rid, F.col(sid).alias("sid_b"), F.col(score).alias("q_b"))
    same = F.coalesce(F.col(sid) == F.col("sid_b"), F.lit(False))
    return main.join(other, rid, "left").withColumn(score, F.when(same, F.least(score, "q_b")).otherwise(0.0)).drop("sid_b", "q_b")


def group_threshold(d: DataFrame, group: str, thresholds: dict[str, float], default: float, score: str = "q") -> DataFrame:
    """Rows whose score reaches their group's threshold."""
    limit: Column = F.lit(default)
    for g, t in thresholds.items():
        limit = F.when(F.col(group) == g, t).otherwise(limit)
    return d.filter(F.col(score) >= limit)


def number_veto(d: DataFrame, threshold: float, reach: int, sid: str = "sid", own: str = "ks", number: str = "kr", score: str = "q", least: int = 2) -> DataFrame:
    """Accepted records at a number other than the entity's, within ``reach``, fall to 0 where ``least`` of them share it."""
    from pyspark.sql import Window

    shifted = (F.col(score) >= threshold) & (F.col(number) >= 0) & (F.col(own) >= 0) & (F.col(number) != F.col(own)) & (F.abs(F.col(number) - F.col(own)) <= reach)
    d = d.withColumn("shifted", F.coalesce(shifted, F.lit(False)))
    n = F.count_if("shifted").over(Window.partitionBy(sid, number))
    return d.withColumn("n_shifted", n).withColumn(score, F.when(F.col("shifted") & (F.col("n_shifted") >= least), 0.0).otherwise(F.col(score))).drop("shifted", "n_shifted")


def assemble(main: DataFrame, vetoes: list[DataFrame], restore: DataFrame | None, reject: DataFrame | None, threshold: float, thresholds: dict[str, float] | None = None, group: str = "country", blank: list[str] | None = None, numbers: tuple[float, int] | None = None) -> DataFrame:
    """The final links: vetoes, the number veto, restored and rejected pairs, thresholds, blanked groups, in that order."""
    d = main
    for v in vetoes:
        d = veto(d, v)
    if numbers:
        d = number_veto(d, *numbers)
    empty = d.select("rid", "sid").limit(0)
    if restore is not None or reject is not None:
        d = override(d, restore if restore is not None else empty, reject if reject is not None else empty)
    d = group_threshold(d, group, thresholds or {}, threshold) if group in d.columns else d.filter(F.col("q") >= threshold)
    return d.filter(~F.col(group).isin(blank)) if blank else d


def expected_f(q: list[float], k: int, missed: float = 0.0, beta2: float = 0.25) -> float:
    """Expected F0.5 of accepting the first ``k`` of probabilities ``q``, ``missed`` matches expected outside them."""

    def pmf(ps: list[float]) -> list[float]:
        out = [1.0]
        for p in ps:
            out = [(out[i] * (1 - p) if i < len(out) else 0.0) + (out[i - 1] * p if i else 0.0) for i in range(len(out) + 1)]
        return out

    inside, outside = pmf(q[:k]), pmf(q[k:])
    if k == 0:
        return outside[0]  # right only if nothing is true
    total = 0.0
    for tp, a in enumerate(inside):
        if not tp:
            continue
        for fn, b in enumerate(outside):
            precision, recall = tp / k, tp / (tp + fn + missed)
            total += a * b * (1 + beta2) * precision * recall / (beta2 * precision + recall)
    return total


def _counts_of_true(p: np.ndarray) -> Iterator[np.ndarray]:
    """For k from all down to none, the distribution of the number of true ones among the first k; about sqrt(n) of them are held."""

    def step(row: np.ndarray, x: float) -> np.ndarray:
        out = np.append(row * (1 - x), 0.0)
        out[1:] += row * x
        return out

    size = max(1, math.isqrt(len(p)))
    row, marks = np.ones(1), []
    for k in range(len(p) + 1):
        if k % size == 0:
            marks.append(row)
        if k < len(p):
            row = step(row, p[k])
    for i in reversed(range(len(marks))):
        rows = [marks[i]]
        for k in range(i * size, min((i + 1) * size - 1, len(p))):
            rows.append(step(rows[-1], p[k]))
        yield from reversed(rows)


def best_k(q: list[float], missed: float = 0.0) -> int:
    """How many of the most probable to accept for the best expected F0.5; the fewest of equally good.

    With t true ones among the first k and f among the rest, F is 5 t / (t + f + missed + 4 k). ``rest[u - 1]`` is the mean of
    1 / (u + f + missed) over f; moving the k-th candidate to the rest is one step of it. The work is quadratic in the number of
    candidates, whatever their number; memory grows with its power of 1.5.
    """
    p = np.asarray(q, np.float64)
    n = len(p)
    values = np.empty(n + 1)
    rest = 1 / (np.arange(1, 5 * n + 2) + missed)
    for k, true in zip(range(n, 0, -1), _counts_of_true(p), strict=False):
        t = np.arange(1, k + 1)
        values[k] = 5 * (true[1:] * t) @ rest[t + 4 * k - 1]
        rest = (1 - p[k - 1]) * rest[:-1] + p[k - 1] * rest[1:]
    values[0] = np.prod(1 - p)
    return int(np.argmax(np.round(values, 12)))


def select_expected_f(p: DataFrame, sid: str = "sid", rid: str = "rid", score: str = "p", odds: float = 1.0, missed: float = 0.0) -> DataFrame:
    """The pairs whose acceptance maximises every entity's expected F0.5, over all of its candidates.

    One entity's candidates are one row of (score, id), as blocking leaves few of them.
    """
    lists = p.groupBy(sid).agg(F.sort_array(F.collect_list(F.struct(F.col(score).alias("s"), F.col(rid).alias("r"))), asc=False).alias("c"))
    shifted = F.transform("c", lambda x: x["s"] / (x["s"] + (1 - x["s"]) * odds))

    @F.pandas_udf("int")
    def how_many(q: pd.Series) -> pd.Series:
        return q.map(lambda x: best_k([float(v) for v in x], missed))

    chosen = lists.withColumn("k", how_many(shifted))
    return chosen.select(sid, F.explode(F.slice("c", 1, F.col("k"))).alias("x")).select(sid, F.col("x.r").alias(rid), F.col("x.s").alias(score))
