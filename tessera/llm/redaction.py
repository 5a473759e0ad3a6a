"""Replacing secrets in texts by the name of their kind."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import appended
from .secrets import MAX_RATIO, cached, scan


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, overlapping ones together, replaced by ``[KIND]`` of the first."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocab: str, pattern: str, text: str = "text", *, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Every row of ``docs`` with its secrets replaced. Null stays null, empty stays empty, repeated rows are changed
    alike, other columns stay as they are, texts of any length are scanned whole, an empty table stays empty."""

    def fn(col: pa.Array) -> list:
        enc, out = cached(vocab, pattern).encode_ordinary, []
        for t in col.to_pylist():
            if t:
                base, extra = scan(t, enc, max_ratio)
                if base or extra:
                    t = redacted(t, base + extra)
            out.append(t)
        return [out]

    return appended(docs, text, [T.StructField(text, T.StringType())], fn, keeps=True).select(*docs.columns)
