"""Appending computed columns to a DataFrame batch by batch, in bounded slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship, table

SLICE_BYTES, SLICE_ROWS = 4 << 20, 30_000


#: The vocabulary or tokenizer that this worker keeps over the tasks of an operator.
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]):
    """What ``make`` gives, made once for the tasks of an operator. Only one thing is kept: those of other operators go first."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Forget what is kept, and give its memory back."""
    _KEPT.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the offsets of its rows; null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blobs(col: pa.Array) -> list[bytes]:
    """Each row's text as bytes; null is empty."""
    return pc.fill_null(col, "").cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice has about ``most`` bytes of ``text`` (one row at least, ``SLICE_ROWS`` at most)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, at = utf8(b.column(b.schema.get_field_index(text)))
        lo = 0
        while lo < b.num_rows:
            hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1), lo + SLICE_ROWS)
            yield b.slice(lo, hi - lo)
            lo = hi


def appended(df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[pa.Array], list], most: int = SLICE_BYTES, keeps: bool = False) -> DataFrame:
    """``df`` with the columns ``fields``, which ``fn`` computes from slices of the column ``text``.

    An input column of the same name as a new one is replaced. ``keeps``: whether ``fn`` uses something ``kept``; if not, what
    other operators left in the worker goes first.
    """
    ship(df.sparkSession)
    base = df.drop(*[f.name for f in fields if f.name != text])  # the text itself may be rewritten
    keep = base.columns
    replaces = [f.name for f in fields if f.name in keep]
    schema = T.StructType([f for f in base.schema.fields if f.name not in replaces] + fields)
    names = schema.names
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        if not keeps:
            release()
        for b in slices(batches, text, most):
            made = fn(b.column(b.schema.get_field_index(text)))
            old = [b.column(i) for i, n in enumerate(b.schema.names) if n not in replaces]
            yield pa.RecordBatch.from_arrays(old + [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)], names=names)
        trim()

    return base.mapInArrow(run, schema)
