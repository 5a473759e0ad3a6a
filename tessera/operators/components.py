"""Connected components of an edge list, by local contraction and alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Tasks that the neighbours of one node are dealt over.
SALTS = 32


def _dealt(e: DataFrame) -> DataFrame:
    """Edges with a salt of the far end, so that a hub's neighbours are many groups."""
    return e.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))


def _least(e: DataFrame) -> DataFrame:
    """(a, s, m): for the groups of neighbours of each node, the least neighbour of all its groups."""
    parts = e.groupBy("a", "s").agg(F.min("b").alias("m"))
    return parts.select("a", "s").join(parts.groupBy("a").agg(F.min("m").alias("m")), "a")


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least of its neighbourhood."""
    both = _dealt(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return both.filter("b > a").join(_least(both), ["a", "s"]).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    e = _dealt(e)
    least = _least(e)
    near = e.join(least, ["a", "s"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def _forest(e: DataFrame) -> DataFrame:
    """Each task's edges as stars: every node tied to the least that the task's own edges reach."""

    def run(batches):
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.schema) for b in batches if b.num_rows]
        if held:
            a, b, schema = zip(*held, strict=True)
            made = stars(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema[0], strict=True)], names=["a", "b"])

    return e.mapInArrow(run, e.schema)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list that aren't the least of their component, and that least."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(node))
    while True:
        low = np.minimum(up[x], up[y])
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        while (up[up] != up).any():
            up = up[up]
        apart = up[x] != up[y]
        if not apart.any():
            break
        x, y = x[apart], y[apart]
    own = up != np.arange(len(node))
    return node[own], node[up[own]]


def _settled(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down = 1 AND up = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (whole numbers or texts) that isn't its own.

    Works on whole tables: tasks first contract the edges they hold, then each step is an aggregation and a join over all, its result
    stored in the shared folder, until the edges are stars. Edges with a null end are left out.
    """
    x, y = F.col(a), F.col(b)
    e = edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    e = written(e, "edges")
    while not _settled(e):
        e = written(_forest(e), "edges")
        if not _settled(e):
            e = written(_small_star(_large_star(e)), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
