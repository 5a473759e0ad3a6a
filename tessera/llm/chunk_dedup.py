"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes cuts a text wherever its upper bits are zero, so an insertion moves the cuts near it
and no others. Chunks are known by 128-bit digests; all but the first occurrence (in order of doc_id and place) of each are
duplicates. Runs of duplicate chunks of at least ``min_span`` bytes are removed: a single short chunk may recur by chance in
clean prose, a run of them doesn't.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from ..session import input_bytes, ship
from .columns import documents, slices, utf8
from .exchange import SCHEMA, FirstPlaces, Outbox, bits_for, dealt, later_places, mix, opened, passed, ranges, sent
from .spans import by_document, identified, ids, joined, merged, removal, to_documents

MASK_BITS, MIN_CHUNK, MAX_CHUNK, MIN_SPAN = 4, 12, 128, 100
PART = 1 << 20  # bytes of text worked on at a time
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over j < 32, by doubling the span."""
    h, step = GEAR[data], 1
    while step < 32:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h, step = nxt, 2 * step
    return h


def chunk_entries(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Upper and lower digest, text, start in the text and length of every chunk.

    The hash looks back over 32 bytes; zero bytes are put before each text, so that it doesn't depend on the one before it.
    """
    n = len(at) - 1
    padded = np.zeros(len(data) + 32 * n, np.uint8)
    shift = 32 * (np.repeat(np.arange(n), np.diff(at)) + 1)
    padded[np.arange(len(data)) + shift] = data
    at2 = at + 32 * np.arange(n + 1)
    lo, hi = at2[:-1] + 32, at2[1:]
    h = gear_hashes(padded) if len(padded) else np.empty(0, np.uint32)
    found = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1 if len(h) else np.empty(0, np.int64)
    starts, owner = [], []
    begin, stop = np.searchsorted(found, lo), np.searchsorted(found, hi)
    for d in range(n):
        own = _chunk_starts(found[begin[d] : stop[d]].tolist(), int(lo[d]), int(hi[d]))
        starts += own
        owner += [d] * len(own)
    starts, owner = np.array(starts, np.int64), np.array(owner, np.int64)
    ends = np.r_[starts[1:], 0]
    last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.empty(0, bool)
    ends[last] = hi[owner[last]]
    raw = padded.tobytes()
    digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    d = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    return d[:, 0], d[:, 1], owner, (starts - lo[owner]).astype(np.uint32), (ends - starts).astype(np.uint16)


def _chunk_starts(found: list[int], lo: int, end: int) -> list[int]:
    out = [lo] if end > lo else []
    for c in found:
        while c - lo > MAX_CHUNK:
            lo += MAX_CHUNK
            out.append(lo)
        if MIN_CHUNK <= c - lo and c < end:
            lo = c
            out.append(lo)
    while end - lo > MAX_CHUNK:
        lo += MAX_CHUNK
        out.append(lo)
    return out


def duplicate_chunks(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """Entries (start, length) of the documents of ``docs`` (identified), for all but the first occurrence of each chunk."""

    def send(batches):
        box = FirstPlaces(bits, 64, lambda key, start, length: (start, length))

        def rows():
            for b in slices(batches, text, PART):
                hi, lo, owner, start, length = chunk_entries(*utf8(b.column(b.schema.get_field_index(text))))
                yield from box.add(ids(b), hi, owner, start, length, lo)
            yield from box.flush()

        yield from sent(rows())

    def first(batches):
        box = Outbox(bits, 64)

        def rows():
            known = []
            for blobs in passed(ranges(batches), 1 << bits, known):
                hi, start, length, lo, k, h = (np.concatenate(c) for c in zip(*(opened(x, 3) for x in blobs), strict=True))
                order = np.lexsort((start, h, k, lo, hi))
                hi, start, length, lo, k, h = (c[order] for c in (hi, start, length, lo, k, h))
                later = later_places(hi, lo, k, h, start)
                start, length, k, h = (c[later] for c in (start, length, k, h))
                yield from box.add([k, h], to_documents(k), np.arange(len(k)), start, length)
                yield from known
                known.clear()
            yield from known
            yield from box.flush()

        yield from sent(rows())

    return dealt(docs.select("k", "h", text).mapInArrow(send, SCHEMA)).mapInArrow(first, SCHEMA)


def chunk_spans(docs: DataFrame, text: str, min_span: int) -> DataFrame:
    """(k, h, span_starts, span_ends): maximal runs of duplicate chunks of at least ``min_span`` bytes."""

    def make(start, length):
        s, e = merged(start.astype(np.int64), start.astype(np.int64) + length)
        ok = e - s >= min_span
        return [s[ok], e[ok]]

    return by_document(duplicate_chunks(docs, text, bits_for(input_bytes(docs))), 2, make, ["span_starts", "span_ends"])


def chunk_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", *, min_span: int = MIN_SPAN, digest: bool = True, keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with counts and the digest of what is left, or (``digest=False``) with its text replaced by that.

    ``keep_text=False`` leaves the text out of a result with digests.

    Null and empty texts have no chunks. Rows that repeat key and text are one document. A null key is a key of its own, before all
    others. Columns named as a result are replaced. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    d, t = identified(docs, key, text)
    return removal(joined(d, chunk_spans(d, t, min_span), t), t, docs.schema.fields, digest, keep_text)


def op9_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    return chunk_dedup(documents(spark, sf_dir), keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
