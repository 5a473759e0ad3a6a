"""Joins beyond equality: ranges by buckets, salted skew, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_semi(left: DataFrame, right: DataFrame, block: str, number: str, low: int, high: int) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` in the same block whose number is ``low`` to ``high`` below.

    Numbers fall into buckets as wide as the reach, so a match is in one of two buckets and the join stays an equality join.
    """
    width = max(high, 1)
    r = right.select(F.col(block).alias("rb"), F.col(number).alias("rn"), F.floor(F.col(number) / width).alias("bucket")).distinct()
    x = left.withColumn("bucket", F.floor((F.col(number) - low) / width))
    either = r.union(r.select("rb", "rn", F.col("bucket") + 1))
    hit = (x[block] == either["rb"]) & (x["bucket"] == either["bucket"]) & (x[number] - either["rn"]).between(low, high)
    return x.join(either, hit, "left_semi").drop("bucket")


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """An inner join whose hot keys are dealt over ``salts`` tasks: the small side is given once for each salt.

    For engines or joins where adaptive skew splitting doesn't apply; elsewhere a plain join is cheaper.
    """
    b = big.withColumn("salt", F.floor(F.rand(7) * salts).cast("int"))
    s = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [key, "salt"]).drop("salt")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """``df`` with a dimension's value, or a default where it has none."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def set_difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct rows of ``a`` that ``b`` lacks, and the reverse."""
    x = a.subtract(b).agg(F.count("*").alias("missing"))
    y = b.subtract(a).agg(F.count("*").alias("unknown"))
    return x.crossJoin(y)  # one row each
