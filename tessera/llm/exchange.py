"""Dealing large sets of small entries between tasks as compressed arrays.

An entry is a key, the document it comes from and a few numbers. Tasks sort entries by key, cut them into ranges of the key
space and send each range as one compressed row: differences of sorted keys, and columns stored byte plane by byte plane, take a
fraction of the rows they stand for. The receiving side gets every entry of a range together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import width
from .columns import release, trim

NULL_KEY = -(1 << 63)
FLUSH = 1_000_000


def pack(cols: list[np.ndarray]) -> bytes:
    import zstandard

    head, body = [len(cols)], []
    for c in cols:
        c = np.ascontiguousarray(c)
        head += [ord(c.dtype.kind) << 8 | c.dtype.itemsize, len(c)]
        body.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return np.array(head, "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n = int(np.frombuffer(blob, "<i8", 1)[0])
    head = np.frombuffer(blob, "<i8", 2 * n, 8)
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[8 + 16 * n :]), 0, []
    for code, rows in head.reshape(-1, 2).tolist():
        size = code & 255
        planes = np.frombuffer(body, np.uint8, rows * size, at).reshape(size, rows)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(code >> 8)}{size}"))
        at += rows * size
    return out


class Outbox:
    """Entries of a task, sent by ranges of the key (its upper ``bits``) once enough are held.

    ``docs``: columns that describe a document; each range carries those of the documents it mentions.
    """

    def __init__(self, bits: int, key_bits: int, flush: int = FLUSH):
        self.shift, self.flush_at = key_bits - bits, flush
        self.n_ranges = 1 << bits
        self._clear()

    def _clear(self):
        self.held, self.docs, self.n, self.n_docs = [], [], 0, 0

    def add(self, docs: list[np.ndarray], keys: np.ndarray, doc: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """``doc``: each entry's row in ``docs``."""
        if len(keys):
            self.held.append([keys, doc.astype(np.int32) + np.int32(self.n_docs), *cols])
            self.docs.append(docs)
            self.n += len(keys)
            self.n_docs += len(docs[0])
        if self.n >= self.flush_at:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.n:
            return
        cols = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        docs = [np.concatenate(c) for c in zip(*self.docs, strict=True)]
        self._clear()
        order = np.argsort(cols[0])
        cols, docs = yield from self.settled([c[order] for c in cols], docs)
        cuts = np.searchsorted(cols[0] >> np.uint64(self.shift), np.arange(self.n_ranges + 1, dtype=np.uint64))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            keys, doc, *rest = (c[cuts[r] : cuts[r + 1]] for c in cols)
            used = np.zeros(len(docs[0]), bool)
            used[doc] = True
            place = np.cumsum(used) - 1
            own = [d[used] for d in docs]
            yield r, pack([np.diff(keys, prepend=np.uint64(0)), place[doc].astype(np.uint16 if len(own[0]) < 65536 else np.uint32), *rest, *own])


    def settled(self, cols: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """What of the sorted entries is still to be sent; a kind of box may settle entries among those it holds."""
        yield from ()
        return cols, docs


class FirstPlaces(Outbox):
    """Entries (key; start, length, identity) of documents (k, h) of which only the earliest place of each key and identity
    matters to others.

    Later places that a task holds are known to be duplicates: they don't go to the key's range, where a hot key's would all meet,
    but straight to their documents, as ranges after the ``n_ranges`` of keys (see ``passed``). ``form`` gives the columns they have
    there.
    """

    def __init__(self, bits: int, key_bits: int, form):
        super().__init__(bits, key_bits)
        self.form, self.direct = form, Outbox(bits, 64)

    def settled(self, cols, docs):
        key, doc, start, size, ident = cols
        same = key[1:] == key[:-1]
        i = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        if not len(i):
            return cols, docs
        k, h = (d[doc[i]] for d in docs[:2])
        order = np.lexsort((start[i], h, k, ident[i], key[i]))
        i, k, h = i[order], k[order], h[order]
        later = i[later_places(key[i], ident[i], k, h, start[i])]
        k, h = (d[doc[later]] for d in docs[:2])
        yield from self.direct.add([k, h], mix(k.view(np.uint64)), np.arange(len(later)), *self.form(key[later], start[later], size[later]))
        for r, blob in self.direct.flush():
            yield r + self.n_ranges, blob
        keep = np.ones(len(key), bool)
        keep[later] = False
        return [c[keep] for c in cols], docs


def later_places(key, ident, k, h, start) -> np.ndarray:
    """Which of entries in order of all five columns are not at the first place of their key and identity.

    A document given twice is at one place.
    """
    top = np.r_[True, (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])]
    head = np.maximum.accumulate(np.where(top, np.arange(len(key)), 0))
    return (k != k[head]) | (h != h[head]) | (start != start[head])


def passed(groups, n_ranges: int, out: list):
    """The ranges of keys; rows that go straight to documents are put in ``out``, for the caller to send on."""
    for r, blobs in groups:
        if r >= n_ranges:
            out += [(r - n_ranges, b) for b in blobs]
        else:
            yield blobs


def opened(blob: bytes, n_cols: int) -> list[np.ndarray]:
    """Key, the entry's columns (``n_cols`` of them), then its document's columns."""
    cols = unpack(blob)
    doc = cols[1]
    return [np.cumsum(cols[0], dtype=np.uint64), *cols[2 : 2 + n_cols], *(d[doc] for d in cols[2 + n_cols :])]


def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["r", "blob"])


SCHEMA = "r int, blob binary"


def sent(rows: Iterator[tuple[int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches. These tasks need memory: what other operators keep in this worker goes first, and what is freed goes back."""
    release()
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)
    trim()


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a range in one task, next to each other."""
    return df.repartition(width(df.sparkSession), "r").sortWithinPartitions("r")


def ranges(batches) -> Iterator[tuple[int, list[bytes]]]:
    """Each range with its rows."""
    at, held = None, []
    for b in batches:
        for r, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r != at and held:
                yield at, held
                held = []
            at = r
            held.append(blob)
    if held:
        yield at, held


def bits_for(size: int) -> int:
    """Key bits for ranges of about 4 MB of an input of ``size`` bytes, 2**6 at least and 2**20 at most."""
    return min(20, max(6, (size >> 22).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def doc_range(ids: np.ndarray, bits: int) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64))


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def prefix_sums(data: np.ndarray, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) * base**i, and the inverse powers: (s[j] - s[i]) * inv[i] depends on data[i:j] alone."""
    n = len(data)
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    inverse = np.full(n + 1, pow(int(base), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return sums, inverse
