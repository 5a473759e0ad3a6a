"""Byte spans of documents: gathering them by document, and removing them from the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import blobs, slices, trim
from .exchange import NULL_KEY, dealt, mix, opened, ranges

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
MARKS = [T.StructField("span_starts", T.ArrayType(T.LongType(), False)), T.StructField("span_ends", T.ArrayType(T.LongType(), False))]


def identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with its columns renamed by place (no name can clash) and a document's identity (k, h), and the text's new name.

    k is the key (null has a value of its own), h a hash of the text. Rows that repeat key and text are one document given again;
    each gets that document's result.
    """
    names = docs.columns
    d, t = docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index(text)}"
    k = F.coalesce(F.col(f"c{names.index(key)}").cast("long"), F.lit(NULL_KEY))
    return d.withColumns({"k": k, "h": F.xxhash64(F.coalesce(F.col(t), F.lit("")))}), t


def ids(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("k", "h")]


def to_documents(k: np.ndarray) -> np.ndarray:
    """The exchange key that brings a document's entries together."""
    return mix(k.view(np.uint64))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal runs (spans that touch are one)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    first = np.flatnonzero(new)
    return s[first], e[np.r_[first[1:] - 1, len(s) - 1]]


def by_document(entries: DataFrame, n_cols: int, make: Callable[..., list[np.ndarray]], names: list[str], kind: str = "array<long>") -> DataFrame:
    """Rows (k, h, *names) from entries whose documents are (k, h): ``make`` gets a document's columns and returns lists, or none."""

    def run(batches):
        for _, blobs in ranges(batches):
            rows = documents_of(blobs, n_cols)
            held = []
            for k, h, cols in rows:
                made = make(*cols)
                if made is not None:
                    held.append((k, h, *made))
                if len(held) >= 2000:
                    yield out(held)
                    held = []
            if held:
                yield out(held)
        trim()

    def out(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array([x.tolist() for x in c], pa.list_(pa.int64())) for c in cols[2:])], names=["k", "h", *names])

    return dealt(entries).mapInArrow(run, "k long, h long, " + ", ".join(f"{n} {kind}" for n in names))


def documents_of(blobs: list[bytes], n_cols: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Each document of a range with its entries' columns."""
    parts = [opened(x, n_cols)[1:] for x in blobs]
    *cols, k, h = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((h, k))
    k, h, cols = k[order], h[order], [c[order] for c in cols]
    cut = np.r_[0, np.flatnonzero((k[1:] != k[:-1]) | (h[1:] != h[:-1])) + 1, len(k)]
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(k[lo]), int(h[lo]), [c[lo:hi] for c in cols]


def squeezed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with each text compressed on its own, null an empty one: less to shuffle."""
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField(text, T.BinaryType())])

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, text):
            texts = pa.array([packer.compress(t) for t in blobs(b.column(b.schema.get_field_index(text)))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in keep), texts], names=schema.names)

    return docs.mapInArrow(run, schema)


def joined(docs: DataFrame, spans: DataFrame, text: str) -> DataFrame:
    """``docs`` (identified) with their spans, texts compressed."""
    s = spans.select(F.col("k").alias("span_k"), F.col("h").alias("span_h"), "span_starts", "span_ends")
    docs = squeezed(docs.withColumn("span_null", F.col(text).isNull()), text)
    return docs.join(s, (docs["k"] == s["span_k"]) & (docs["h"] == s["span_h"]), "left").drop("span_k", "span_h")


def snapped(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    """What is left of a text without the spans, each narrowed to whole characters."""
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e < len(raw) and e > s and raw[e] & 0xC0 == 0x80:
            e -= 1
        out.append(raw[at:s])
        at = max(at, e)
    return b"".join([*out, raw[at:]])


def removal(docs: DataFrame, text: str, columns: list[T.StructField], digest: bool, keep_text: bool = True) -> DataFrame:
    """What ``joined`` gives, with counts and the digest of what is left of each text, or the text replaced by it.

    ``columns``: those of the table before it was ``identified``.
    """
    names = [f.name for f in FIELDS] if digest else []
    base = [(f"c{i}", f) for i, f in enumerate(columns) if f.name not in names and (keep_text or not digest or f"c{i}" != text)]
    schema = T.StructType([f for _, f in base] + (FIELDS if digest else []))

    def rows_of(b):
        at = {n: i for i, n in enumerate(b.schema.names)}
        return zip(*(b.column(at[c]).to_pylist() for c in (text, "span_starts", "span_ends", "span_null")), strict=True)

    def run(batches):
        unpacker = zstandard.ZstdDecompressor()
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                rows, left = [], []
                for z, s, e, null in rows_of(b):
                    t, s, e = unpacker.decompress(z), s or [], e or []
                    if keep_text or not digest:
                        left.append(None if null else snapped(t, s, e).decode() if not digest else t.decode())
                    if digest:
                        kept = b"".join(t[x:y] for x, y in zip([0, *e], [*s, len(t)], strict=True))
                        rows.append((len(t), len(t) - len(kept), len(s), hashlib.sha256(kept).hexdigest()))
                cols = [pa.array(left, pa.string()) if c == text else b.column(b.schema.get_field_index(c)) for c, _ in base]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(c) for c in zip(*rows, strict=True)] if digest else []), names=schema.names)

    return docs.mapInArrow(run, schema)
