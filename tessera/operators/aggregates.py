"""Aggregations of profiles: rates, quantiles, histograms, mixtures, vocabularies, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_table(df: DataFrame, by: list[str], rates: dict[str, str]) -> DataFrame:
    """Means of flags by group, and one row for all, in one pass."""
    aggs = [F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(n) for n, c in rates.items()], F.grouping_id().alias("gid")]
    out = df.groupingSets([by, []], *by).agg(*aggs)
    whole = F.col("gid") != 0
    return out.select(*[F.when(whole, "ALL").otherwise(F.col(b)).alias(b) for b in by], "n", *rates)


def quantiles(df: DataFrame, by: list[str], columns: list[str], at: list[float]) -> DataFrame:
    """(by, column, q, value): exact quantiles with linear interpolation, in long form."""
    aggs = [F.percentile(c, F.array(*[F.lit(q) for q in at])).alias(c) for c in columns]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(q)).alias("q"), F.element_at(c, i + 1).alias("value")) for c in columns for i, q in enumerate(at)])).alias("r")
    return wide.select(*by, rows).select(*by, "r.*")


def shares(df: DataFrame, by: str) -> DataFrame:
    """Value counts with shares; null is a value."""
    c = df.groupBy(by).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("total")).alias("share"))  # the total is one row


def density(df: DataFrame, value: str, by: str, low: float = 0.0, high: float = 1.0, bins: int = 50) -> DataFrame:
    """Histogram densities; the last bin is closed on the right and values outside are left out."""
    inside = df.filter((F.col(value) >= low) & (F.col(value) <= high))
    b = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).alias("bin")
    return bin_density(inside.groupBy(by, b).agg(F.count("*").alias("n")), by, low, high, bins)


def bin_density(c: DataFrame, by: str, low: float, high: float, bins: int) -> DataFrame:
    """Densities of counted bins (by, bin, n)."""
    total = c.groupBy(by).agg(F.sum("n").alias("t"))
    return c.join(total, by).select(by, "bin", (F.col("n") / F.col("t") / ((high - low) / bins)).alias("density"))


def mixture_share(h: DataFrame, target: str, first: str, second: str, step: float = 0.001) -> DataFrame:
    """One row: the w that fits target = (1 - w) * first + w * second best in squares, on a grid of [0, 1].

    The squared error is quadratic in w, so three sums over the bins give it at every grid point.
    """
    a, b = F.col(target) - F.col(first), F.col(second) - F.col(first)
    s = h.agg(F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"))
    n = int(round(1 / step))
    grid = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")
    x = s.select("*", grid).withColumn("w", F.col("i") / n)
    err = F.col("aa") - 2 * F.col("w") * F.col("ab") + F.col("w") * F.col("w") * F.col("bb")
    return x.agg(F.min_by("w", F.struct(F.round(err, 12).alias("e"), F.col("i"))).alias("w"))


def document_frequency(df: DataFrame, tokens: Column, by: list[str]) -> DataFrame:
    """(by, token, df): rows whose tokens include each token."""
    return df.select(*by, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("df"))


def idf(df: DataFrame, tokens: Column, by: list[str]) -> DataFrame:
    """(by, token, df, idf): natural logarithm of rows over document frequency, without smoothing."""
    n = df.groupBy(*by).agg(F.count("*").alias("n")) if by else df.agg(F.count("*").alias("n"))
    f = document_frequency(df, tokens, by)
    f = f.join(n, by) if by else f.crossJoin(F.broadcast(n))  # one row
    return f.select(*by, "token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def top_values(df: DataFrame, column: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The most frequent values with their shares; ties in order of the value."""
    by = by or []
    c = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    if by:
        ranked = c.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), column))).filter(F.col("rn") <= n).drop("rn")
        return ranked.join(df.groupBy(*by).agg(F.count("*").alias("total")), by).select(*by, column, "n", (F.col("n") / F.col("total")).alias("share"))
    total = df.agg(F.count("*").alias("total"))
    return c.orderBy(F.desc("n"), column).limit(n).crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def concentration(df: DataFrame, column: str, by: str, tops: list[int]) -> DataFrame:
    """Distinct values of each group, and the share of rows that its most frequent values have."""
    c = df.groupBy(by, column).agg(F.count("*").alias("n"))
    r = c.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), column)))
    return r.groupBy(by).agg(F.count("*").alias("distinct"), *[(F.sum(F.when(F.col("rn") <= t, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"top{t}") for t in tops])


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, duplicates): rows beyond the first of each value, and of whole rows."""
    aggs = [(F.count(c) - F.countDistinct(c)).alias(c) for c in columns] + [(F.count("*") - F.countDistinct(F.struct(*df.columns))).alias("row")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("duplicates")) for c in [*columns, "row"]])).alias("r")).select("r.*")


def namesakes(df: DataFrame, key: list[str], other: DataFrame | None = None) -> DataFrame:
    """``df`` with the number of rows (of ``other``) that have the same key; 0 if none."""
    c = (other if other is not None else df).groupBy(*key).agg(F.count("*").alias("namesakes"))
    return df.join(c, key, "left").withColumn("namesakes", F.coalesce("namesakes", F.lit(0)))
