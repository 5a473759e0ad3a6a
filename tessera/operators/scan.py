"""Every query row against every base row of its part, in Python over Arrow batches: queries are held, base rows streamed past them.

Only the rows travel, never pairs: a part's queries are dealt over chunks, and each chunk gets the part's base rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import width

#: Queries that a task holds at once, for rows of a few hundred bytes; of ids alone more would do.
HELD = 8192
#: Tasks a scan is dealt over for each shuffle partition: chunks are few and of unlike work.
SPREAD = 4


def scan(queries: DataFrame, base: DataFrame, part: Column, columns: dict[str, tuple[Column, Column]], fold: Callable, schema: str, held: int = HELD) -> DataFrame:
    """Rows of ``fold``'s results. ``columns``: name to expressions on a query and on a base row; the first is the id; rows without a part or id meet
    nothing.

    ``fold(queries)`` gets an Arrow table of at most about ``held`` queries of one part and returns an object with ``add(base)``, called with
    every base row of the part in tables of bounded size, and ``rows()``, which gives record batches of ``schema``.
    """
    names = list(columns)
    key = F.to_json(F.struct(part.alias("p")), {"ignoreNullFields": "false"})
    q = queries.filter(part.isNotNull() & columns[names[0]][0].isNotNull()).select(key.alias("part"), *[columns[n][0].alias(n) for n in names])
    b = base.filter(part.isNotNull() & columns[names[0]][1].isNotNull()).select(key.alias("part"), *[columns[n][1].alias(n) for n in names])
    chunks = q.groupBy("part").agg(F.ceil(F.count("*") / held).cast("int").alias("chunks"))
    deal = F.pmod(F.xxhash64(names[0]), F.col("chunks")).cast("int")
    q = q.join(chunks, "part").select("part", deal.alias("chunk"), F.lit(0).alias("side"), *names)
    b = b.join(chunks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"), *names)
    both = q.unionByName(b).repartition(SPREAD * width(queries.sparkSession), "part", "chunk").sortWithinPartitions("part", "chunk", "side")

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, mine, state = None, [], None
        for batch in batches:
            for key_, side, rows in runs(batch):
                if key_ != at:
                    if state is not None:
                        yield from state.rows()
                    at, mine, state = key_, [], None
                if side == 0:
                    mine.append(rows)
                    continue
                if not mine and state is None:
                    continue  # no query was dealt to this chunk
                if state is None:
                    state, mine = fold(pa.Table.from_batches(mine)), []
                state.add(pa.Table.from_batches([rows]))
        if state is not None:
            yield from state.rows()

    return both.mapInArrow(run, schema)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(part and chunk, side, rows) of each run of a sorted batch."""
    if not batch.num_rows:
        return
    part = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    chunk, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    new = (np.diff(part) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)
    starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(starts, starts[1:], strict=False):
        yield (batch.column(0)[lo].as_py(), int(chunk[lo])), int(side[lo]), batch.slice(lo, hi - lo).select(range(3, batch.num_columns))
