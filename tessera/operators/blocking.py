"""Key blocking: keys of a row, the volume of candidate pairs they would give, and the pairs."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Numbers of 64 bits in a signature of a set of words.
BITS = 4


def keys(w: Column, kind: str) -> Column:
    """An array of keys from words: the longest, any, the first three letters of the first, any number or the longest number."""
    numbers = F.filter(w, lambda t: t.rlike(r"^\d+$"))
    if kind == "longest":
        return F.array(X.longest_token(w))
    if kind == "any":
        return F.array_distinct(w)
    if kind == "prefix":
        return F.array(F.substring(F.element_at(w, 1), 1, 3))
    return F.array_distinct(numbers) if kind == "number" else F.array_compact(F.array(X.longest_token(numbers)))


def volume(left: DataFrame, right: DataFrame, key: Column, block: str) -> DataFrame:
    """One row: key blocks, the largest and the sum of pairs. Sizes are multiplied, no pair is made."""

    def sizes(df: DataFrame, n: str) -> DataFrame:
        return df.select(block, F.explode(key).alias("k")).groupBy(block, "k").agg(F.count("*").alias(n))

    x = sizes(left, "n1").join(sizes(right, "n2"), [block, "k"])
    return x.agg(F.count("*").alias("blocks"), F.max(F.col("n1") * F.col("n2")).alias("largest"), F.sum(F.col("n1") * F.col("n2")).alias("volume"))


def pairs(left: DataFrame, right: DataFrame, key: Column, block: str, most: int | None = None, left_id: str = "sid", right_id: str = "rid") -> DataFrame:
    """Distinct pairs with a key in common. ``most``: keys of more pairs are too common to say anything and are left out."""
    a = left.select(block, left_id, F.explode(key).alias("k"))
    b = right.select(block, right_id, F.explode(key).alias("k"))
    if most is not None:
        n = a.groupBy(block, "k").agg(F.count("*").alias("n1")).join(b.groupBy(block, "k").agg(F.count("*").alias("n2")), [block, "k"])
        rare = n.filter(F.col("n1") * F.col("n2") <= most).select(block, "k")
        a = a.join(rare, [block, "k"], "left_semi")
    return a.join(b, [block, "k"]).select(left_id, right_id).distinct()


def shared_words(left: DataFrame, right: DataFrame, words: str, block: str, left_id: str = "sid", right_id: str = "rid") -> DataFrame:
    """(sid, rid, jaccard) of pairs with a word in common: an inverted-index join and a count, sets are never compared."""
    a = left.select(block, left_id, F.size(F.array_distinct(words)).alias("n1"), F.explode(F.array_distinct(words)).alias("t"))
    b = right.select(block, right_id, F.size(F.array_distinct(words)).alias("n2"), F.explode(F.array_distinct(words)).alias("t"))
    both = a.join(b, [block, "t"]).groupBy(left_id, right_id, "n1", "n2").agg(F.count("*").alias("m"))
    return both.select(left_id, right_id, (F.col("m") / (F.col("n1") + F.col("n2") - F.col("m"))).alias("jaccard"))


def similar_words(left: DataFrame, right: DataFrame, words: str, block: str, least: float, left_id: str = "sid", right_id: str = "rid") -> DataFrame:
    """(sid, rid, jaccard) of pairs of at least ``least``.

    Such sets share at least o = ceil(least / (1 + least) * (n1 + n2)) words, so the rarest word they share has o - 1 others behind it in both,
    counted from the rarest; only such meetings are kept, and common words hardly ever are among them. The words themselves travel only for pairs
    whose signatures allow as few different words as ``least`` does. The sides are read several times.
    """
    a = left.select(block, left_id, F.array_distinct(words).alias("w"))
    b = right.select(block, right_id, F.array_distinct(words).alias("w"))
    df = a.select(block, "w").unionAll(b.select(block, "w")).select(block, F.explode("w").alias("t")).groupBy(block, "t").agg(F.count("*").alias("df"))

    def prefix(d: DataFrame, key: str, n: str) -> DataFrame:
        x = d.select(block, key, F.size("w").alias("n"), F.explode("w").alias("t")).join(df, [block, "t"])
        x = x.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("df", "t")))
        x = x.filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
        x = x.join(signed(d.select(key, "w"), "w", f"{n}_bits").drop("w"), key)
        return x.select(block, "t", key, F.col("n").alias(n), (F.col("n") - F.col("nth") + 1).alias(f"{n}_left"), f"{n}_bits")

    met = prefix(a, left_id, "n1").join(prefix(b, right_id, "n2"), [block, "t"])
    both = F.col("n1") + F.col("n2")
    enough = F.least("n1_left", "n2_left") >= both * (least / (1 + least)) - 1e-9
    apart = at_least_apart(F.col("n1_bits"), F.col("n2_bits")) <= both * ((1 - least) / (1 + least)) + 1e-9
    pairs_ = met.filter(enough & apart).select(left_id, right_id).distinct()
    x = pairs_.join(a.select(left_id, F.col("w").alias("wa")), left_id).join(b.select(right_id, F.col("w").alias("wb")), right_id)
    j = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return x.select(left_id, right_id, j.alias("jaccard")).filter(F.col("jaccard") >= least)


def signed(d: DataFrame, words: str, name: str) -> DataFrame:
    """``d`` with a signature of distinct words in ``name``: of each of ``64 * BITS`` bits whether the number of words that hash to it is odd."""
    x = d.withColumn("bit_at", F.transform(words, lambda t: F.pmod(F.xxhash64(t), F.lit(64 * BITS)).cast("int")))
    zero, one = (F.lit(i).cast("long") for i in (0, 1))

    def bits(i: int) -> Column:
        mine = F.filter("bit_at", lambda p: F.floor(p / 64) == i)
        return F.aggregate(mine, zero, lambda y, p: y.bitwiseXOR(F.call_function("shiftleft", one, p.bitwiseAND(63))))

    return x.withColumn(name, F.struct(*[bits(i).alias(f"b{i}") for i in range(BITS)])).drop("bit_at")


def at_least_apart(x: Column, y: Column) -> Column:
    """How many words only one of two sets has, at least: a word of both changes no bit, another at most one."""
    return reduce(add, [F.bit_count(x[f"b{i}"].bitwiseXOR(y[f"b{i}"])) for i in range(BITS)])
