"""Resolving a stream of new records against a static reference list.

Each record is decided on its own (block, shared words, best entity), so micro-batches need no state. Rules that look at all
claims of an entity (context, peers, census) are for batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import blocking, decide
from ..session import written


def link_batch(records: DataFrame, entities: DataFrame, threshold: float, block: str = "country") -> DataFrame:
    """(rid, sid, p) of the records of one batch; ``entities`` and ``records``: entity_id, business_name and the block."""

    def words(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col("entity_id").alias(key), block, X.words(X.norm_basic(F.col("business_name"))).alias("w"))

    c = blocking.shared_words(words(entities, "sid"), words(records, "rid"), "w", block).withColumnRenamed("jaccard", "p")
    return decide.assign_by_rank(c, threshold).select("rid", "sid", "p")


def link_stream(records: DataFrame, entities: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, threshold: float = 0.5, block: str = "country") -> StreamingQuery:
    """Start a query that links every micro-batch and hands it to ``sink`` with its number, so a repeated batch can be told."""
    base = written(entities, "stream-entities")

    def step(batch: DataFrame, number: int) -> None:
        sink(link_batch(batch, base, threshold, block), number)

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
