"""Suffix-array deduplication of long substrings with a distributed difference-cover algorithm.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or same document and earlier
start). Sorting all suffixes of a corpus isn't needed for that, only those whose first ``length`` bytes can have an equal:

1. Every start has an anchor: of the ``length - GRAM + 1`` strings of GRAM bytes in its window, the rightmost of those whose
   hash is least. Equal windows have their anchors at equal places, so starts whose anchor's string occurs once in the
   corpus have no equal and drop out. Anchors, one for about 26 starts, are counted by ranges of their hash, mixed anew, for least
   hashes are small ones.
2. Starts with one anchor are neighbours and need one stretch of text, their context. Contexts that are equal as a whole (by 64 bits
   beside the 64 of the anchor) are collapsed: their earliest place stands for them, and all starts at the others are duplicates. So a
   text with many copies is sorted once, and a hot passage never meets in one task.
3. Where an anchor has several different contexts, these go to the range of the anchor's hash. Equal windows meet there, whatever
   documents they come from. The contexts of a few anchors form one text, and the difference-cover algorithm sorts its
   suffixes: triples at two thirds of the positions are sorted and named, the string of names is sorted by recursion, the
   remaining suffixes are sorted by their first symbol and the rank after it, and both lists are merged. Adjacent suffixes whose
   first ``length`` bytes agree form a class; all its places but the earliest are duplicates.

4. An anchor with very many different contexts would be one sort in one task. Anchors that have at least HOT of them in one
   document of every SAMPLE are known to all tasks beforehand; their starts are entries of their own, by 128 bits of the window's hash, and
   those that a task holds twice are settled there. The sample decides about the way alone: either way finds the same duplicates.

No match is lost: equal windows have equal anchors. Different contexts are compared byte by byte.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import input_bytes, ship, written
from .columns import documents, slices, utf8
from .exchange import SCHEMA, FirstPlaces, Outbox, bits_for, dealt, later_places, mix, opened, pack, passed, prefix_sums, ranges, sent, unpack
from .spans import by_document, identified, ids, joined, merged, removal, squeezed, to_documents

LENGTH, GRAM = 100, 32
BLOCK, SORT_BYTES, PART = 1 << 22, 1 << 20, 1 << 20
SAMPLE, HOT, MOST_HOT = 64, 64, 4_000_000
SECOND = np.uint64(0xD1342543DE82EF95)  # base of the second hash of a window


def dense(x: np.ndarray) -> np.ndarray:
    """Ranks of equal and ordered values, from 0."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]])
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (non-negative integers) in order, by a difference cover modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = dense(s) + 1
    k = int(s.max()) + 1
    p = np.concatenate([s, [0, 0, 0]])
    i = np.arange(n + (n % 3 == 1))  # a last triple of nothing closes the first half of the names
    one, two = i[i % 3 == 1], i[i % 3 == 2]
    sample = np.concatenate([one, two])
    pair = p[sample] * k + p[sample + 1]
    if k >= 1 << 20:
        pair = dense(pair)
    names = dense(pair * k + p[sample + 2]) + 1
    if int(names.max()) == len(sample):
        order = np.argsort(names)
    else:
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    key = p[rest] * (len(rank) + 1) + rank[rest + 1]
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    # where each of the rest goes among sampled suffixes of either class, compared by what both have ranks for
    in_one, in_two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    less = np.searchsorted(p[in_one] * (len(rank) + 1) + rank[in_one + 1], key)
    both = np.concatenate([p[in_two] * k + p[in_two + 1], p[rest] * k + p[rest + 1]])
    if k >= 1 << 20:
        both = dense(both)
    wide = len(rank) + 1
    if int(both.max(initial=0)) >= (1 << 62) // wide:
        both = dense(both)
    less += np.searchsorted(both[: len(in_two)] * wide + rank[in_two + 2], both[len(in_two) :] * wide + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = less + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = sample
    return out


class Runs(NamedTuple):
    """Runs of starts with one anchor: key of the anchor's string, text, first start in the data, number of starts, hash of the context."""

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    context: np.ndarray


def anchored(data: np.ndarray, at: np.ndarray, length: int, gram: int, hot: np.ndarray | None = None) -> Runs:
    """The runs of all texts; those of a ``hot`` anchor (sorted keys) start by start, with two hashes of the window for key and context."""
    none = Runs(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3, np.empty(0, np.uint64))
    if len(data) < length:
        return none
    sums, inverse = prefix_sums(data)
    n = len(data) - gram + 1
    h = mix((sums[gram:] - sums[:n]) * inverse[:n])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    fits = np.arange(len(data)) + length <= at[1:][doc]
    window = length - gram + 1
    bits = (BLOCK + window).bit_length()
    places = np.arange((1 << bits) - 1, (1 << bits) - 1 - min(BLOCK + window, len(data)), -1).astype(np.uint64)
    anchors = []
    for lo in range(0, len(data) - length + 1, BLOCK):
        part = h[lo : lo + BLOCK + window]
        v = part >> np.uint64(bits) << np.uint64(bits) | places[: len(part)]
        size = 1
        while 2 * size <= window:
            v = np.minimum(v[:-size], v[size:]) if len(v) > size else v
            size *= 2
        if size < window:
            v = np.minimum(v[: len(v) - (window - size)], v[window - size :])
        v = v[: min(BLOCK, len(data) - length + 1 - lo)]
        anchors.append(lo + ((1 << bits) - 1) - (v & np.uint64((1 << bits) - 1)).astype(np.int64))
    anchor = np.concatenate(anchors)
    start = np.flatnonzero(fits[: len(anchor)])
    if not len(start):
        return none
    a, d = anchor[start], doc[start]
    new = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    lo, n = start[first], np.diff(np.r_[first, len(start)])
    context = mix((sums[lo + n + (length - 1)] - sums[lo]) * inverse[lo] + n.astype(np.uint64))
    out = Runs(mix(h[a[first]]), d[first], lo, n, context)
    if hot is None or not len(hot):
        return out
    at_hot = hot[np.minimum(np.searchsorted(hot, out.key), len(hot) - 1)] == out.key
    if not at_hot.any():
        return out
    cold, warm = Runs(*(c[~at_hot] for c in out)), Runs(*(c[at_hot] for c in out))
    each = np.repeat(np.arange(len(warm.n)), warm.n)
    s = warm.start[each] + np.arange(len(each)) - np.repeat(np.cumsum(warm.n) - warm.n, warm.n)
    sums2, inverse2 = prefix_sums(data, SECOND)
    one, two = (mix((x[s + length] - x[s]) * y[s] + np.uint64(length)) for x, y in ((sums, inverse), (sums2, inverse2)))
    parts = Runs(one, warm.doc[each], s, np.ones(len(s), np.int64), two)
    return Runs(*(np.concatenate(c) for c in zip(cold, parts, strict=True)))


def hot_anchors(docs: DataFrame, text: str, length: int, gram: int) -> np.ndarray:
    """Keys of the anchors that have many different contexts in a sample of the documents, MOST_HOT at most."""

    def run(batches):
        for b in slices(batches, text, PART):
            r = anchored(*utf8(b.column(b.schema.get_field_index(text))), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(r.key.view(np.int64)), pa.array(r.context.view(np.int64))], names=["key", "context"])

    some = docs.filter(F.pmod(F.xxhash64("k", "h"), F.lit(SAMPLE)) == 0).select(text).mapInArrow(run, "key long, context long").distinct()
    counts = written(some.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "anchor-sample")
    least = max(HOT, (counts.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    return np.sort(np.array([r["key"] for r in counts.filter(F.col("n") >= least).select("key").toLocalIterator()], np.int64).view(np.uint64))


def repeated_anchors(docs: DataFrame, text: str, bits: int, length: int, gram: int) -> DataFrame:
    """Entries (start, starts, anchor's key, duplicate) by document, of runs whose anchor's string occurs again.

    Of equal contexts the earliest isn't a duplicate; it is left out if its anchor has no other context.
    """
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, text, length, gram))

    def send(batches):
        box = FirstPlaces(bits, 64, lambda key, start, n: (start, n, key, np.ones(len(key), np.uint8)))

        def rows():
            for b in slices(batches, text, PART):
                data, at = utf8(b.column(b.schema.get_field_index(text)))
                r = anchored(data, at, length, gram, hot.value)
                yield from box.add(ids(b), r.key, r.doc, (r.start - at[r.doc]).astype(np.uint32), r.n.astype(np.uint16), r.context)
            yield from box.flush()

        yield from sent(rows())

    def count(batches):
        box = Outbox(bits, 64)

        def rows():
            known = []
            for blobs in passed(ranges(batches), 1 << bits, known):
                yield from known
                known.clear()
                key, start, n, context, k, h = (np.concatenate(c) for c in zip(*(opened(x, 3) for x in blobs), strict=True))
                order = np.argsort(key, kind="stable")
                s = key[order]
                same = s[1:] == s[:-1]
                again = order[np.r_[False, same] | np.r_[same, False]]
                if not len(again):
                    continue
                key, start, n, context, k, h = (c[again] for c in (key, start, n, context, k, h))
                order = np.lexsort((start, h, k, context, key))
                key, start, n, context, k, h = (c[order] for c in (key, start, n, context, k, h))
                anchor = np.r_[True, key[1:] != key[:-1]]
                top = anchor | np.r_[True, context[1:] != context[:-1]]
                gone = later_places(key, context, k, h, start)
                kinds = np.add.reduceat(top.astype(np.int64), np.flatnonzero(anchor))[np.cumsum(anchor) - 1]
                use = gone | top & (kinds > 1)
                key, start, n, k, h, gone = (c[use] for c in (key, start, n, k, h, gone))
                yield from box.add([k, h], to_documents(k), np.arange(len(k)), start, n, key, gone.astype(np.uint8))
            yield from known
            yield from box.flush()

        yield from sent(rows())

    return dealt(docs.select("k", "h", text).mapInArrow(send, SCHEMA)).mapInArrow(count, SCHEMA)


class Contexts:
    """Contexts of a task by range of their anchor."""

    def __init__(self, bits: int, flush: int = 24 << 20):
        self.shift, self.at, self.flush_at = 64 - bits, {}, flush
        self.size = 0

    def add(self, key: int, text: bytes, k: int, h: int, start: int):
        self.at.setdefault(key >> self.shift, []).append((text, key, k, h, start))
        self.size += len(text) + 200
        if self.size >= self.flush_at:
            yield from self.flush()

    def flush(self):
        at, self.at, self.size = self.at, {}, 0
        for r, rows in at.items():
            text, *cols = zip(*rows, strict=True)
            yield r, pack([np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text], np.uint16), np.array(cols[0], np.uint64), *(np.array(c, np.int64) for c in cols[1:])])


def duplicates(texts: list[bytes], k: np.ndarray, h: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, offset, starts): runs of duplicate starts in ``texts``, which stand at the places (k, h, start).

    The suffixes of all texts are sorted together; where adjacent ones agree in ``length`` bytes, the earliest place is kept.
    """
    size = np.array([len(t) for t in texts], np.int64)
    n_texts = len(texts)
    # a symbol of its own ends each text, so no suffix runs on into the next
    ends = np.cumsum(size + 1)
    begin = ends - size - 1
    s = np.empty(int(ends[-1]), np.int64)
    inside = np.ones(len(s), bool)
    inside[ends - 1] = False
    s[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + n_texts
    s[~inside] = np.arange(n_texts)
    sa = suffix_array(s)
    text_of = np.repeat(np.arange(n_texts), size + 1)
    sa = sa[sa + length < ends[text_of[sa]]]  # suffixes with enough bytes; those between two of a class are in it
    if not len(sa):
        return (np.empty(0, np.int64),) * 3
    flat = np.r_[(s - n_texts).astype(np.uint8), np.zeros(8, np.uint8)]
    words = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1))
    same = np.ones(len(sa) - 1, bool)
    for off in [*range(0, length - 7, 8), length - 8]:
        i = np.flatnonzero(same)
        w = np.ascontiguousarray(words[np.concatenate([sa[i] + off, sa[i + 1] + off])]).view(np.uint64).reshape(2, -1)
        same[i] = w[0] == w[1]
    cls = np.cumsum(np.r_[False, ~same])
    t = text_of[sa]
    off = sa - begin[t]
    best = np.lexsort((start[t] + off, h[t], k[t], cls))
    top = best[np.r_[True, cls[best][1:] != cls[best][:-1]]][cls]  # the earliest of each suffix's class
    gone = np.flatnonzero((k[t] != k[t[top]]) | (h[t] != h[t[top]]) | (start[t] + off != start[t[top]] + off[top]))
    gone = gone[np.lexsort((off[gone], t[gone]))]
    gt, go = t[gone], off[gone]
    f = np.flatnonzero(np.r_[True, (gt[1:] != gt[:-1]) | (go[1:] != go[:-1] + 1)]) if len(gone) else gone
    return gt[f], go[f], np.diff(np.r_[f, len(gone)])


def different_contexts(docs: DataFrame, runs: DataFrame, text: str, bits: int, length: int) -> DataFrame:
    """Entries (start, starts) by document, of duplicate starts found by sorting contexts. ``runs``: by document."""
    r = runs.select(F.col("k").alias("rk"), F.col("h").alias("rh"), "starts", "counts", "anchors")
    own = squeezed(docs.select("k", "h", text), text)
    both = own.join(r, (own["k"] == r["rk"]) & (own["h"] == r["rh"])).drop("rk", "rh")

    def send(batches):
        box, unpacker = Contexts(bits), zstandard.ZstdDecompressor()

        def rows():
            for b in batches:
                cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (text, "k", "h", "starts", "counts", "anchors")]
                for z, k, h, starts, counts, keys in zip(*cols, strict=True):
                    raw = unpacker.decompress(z)
                    for s, n, key in zip(starts, counts, keys, strict=True):
                        yield from box.add(key & 0xFFFFFFFFFFFFFFFF, raw[s : s + n + length - 1], k, h, s)
            yield from box.flush()

        yield from sent(rows())

    def sort(batches):
        box = Outbox(bits, 64)

        def rows():
            for _, blobs in ranges(batches):
                texts, cols = [], []
                for blob in blobs:
                    data, size, *rest = unpack(blob)
                    raw, end = data.tobytes(), np.cumsum(size.astype(np.int64)).tolist()
                    texts += [raw[e - z : e] for e, z in zip(end, size.tolist(), strict=True)]
                    cols.append(rest)
                key, k, h, start = (np.concatenate(c) for c in zip(*cols, strict=True))
                order = np.argsort(key, kind="stable")
                key, k, h, start = key[order], k[order], h[order], start[order]
                texts = [texts[i] for i in order.tolist()]
                total = np.cumsum([len(t) for t in texts])
                # anchors share no windows: each sort takes those that fill it, one at least
                edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
                lo = 0
                while lo < len(key):
                    base = int(total[lo - 1]) if lo else 0
                    fit = int(np.searchsorted(total, base + SORT_BYTES, side="right"))
                    e = int(np.searchsorted(edges, fit, side="right")) - 1
                    hi = int(edges[e]) if edges[e] > lo else int(edges[np.searchsorted(edges, lo, side="right")])
                    t, off, n = duplicates(texts[lo:hi], k[lo:hi], h[lo:hi], start[lo:hi], length)
                    t += lo
                    yield from box.add([k[t], h[t]], to_documents(k[t]), np.arange(len(t)), (start[t] + off).astype(np.uint32), n.astype(np.uint32))
                    lo = hi
            yield from box.flush()

        yield from sent(rows())

    return dealt(both.mapInArrow(send, SCHEMA)).mapInArrow(sort, SCHEMA)


def equal_contexts(entries: DataFrame, bits: int) -> DataFrame:
    """Entries (start, starts) by document of the runs that ``repeated_anchors`` found to be duplicates as a whole."""

    def run(batches):
        box = Outbox(bits, 64)

        def rows():
            for b in batches:
                for blob in b.column(1).to_pylist():
                    _, start, n, _, gone, k, h = opened(blob, 4)
                    g = gone == 1
                    yield from box.add([k[g], h[g]], to_documents(k[g]), np.arange(int(g.sum())), start[g], n[g].astype(np.uint32))
            yield from box.flush()

        yield from sent(rows())

    return entries.mapInArrow(run, SCHEMA)


def duplicate_spans(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """(k, h, span_starts, span_ends) of the bytes to remove; ``docs`` are identified."""
    bits = bits_for(input_bytes(docs))
    entries = written(repeated_anchors(docs, text, bits, length, gram), "anchors")

    def fetch(start, n, key, gone):
        use = gone == 0
        return [start[use], n[use], key[use].view(np.int64)] if use.any() else None

    runs = by_document(entries, 4, fetch, ["starts", "counts", "anchors"])
    found = different_contexts(docs, runs, text, bits, length).union(equal_contexts(entries, bits))

    def make(start, n):
        start = start.astype(np.int64)
        return list(merged(start, start + n + (length - 1)))

    return by_document(found, 2, make, ["span_starts", "span_ends"])


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = LENGTH, gram: int = GRAM, digest: bool = True, keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with counts and the digest of what is left, or (``digest=False``) with its text replaced by that.

    ``keep_text=False`` leaves the text out of a result with digests.

    Null and empty texts lose nothing. Rows that repeat key and text are one document, and each gets its result; rows of one
    key with different texts are in order of the text's hash. A null key comes before all others. Columns named as a result are
    replaced. With ``digest=False`` spans are narrowed to whole characters. An empty table gives an empty result.
    """
    if not 0 < gram < length <= 1 << 15:
        raise ValueError("0 < gram < length <= 32768")
    ship(docs.sparkSession)
    d, t = identified(docs, key, text)
    return removal(joined(d, duplicate_spans(d, t, length, gram), t), t, docs.schema.fields, digest, keep_text)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same spans from all strings of 100 bytes; for small tables.
ORACLE = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM h WHERE n >= 100)),
f AS (SELECT s, min((doc_id, i)) AS o FROM w GROUP BY s HAVING count(*) > 1),
d AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE (doc_id, i) <> o),
g AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS gap FROM d),
b AS (SELECT doc_id, i, sum((gap > 100)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM b GROUP BY doc_id, run),
k AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS gone, count(*) AS runs FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN runs IS NULL THEN x ELSE array_to_string(list_transform(range(0, runs + 1), lambda j: substr(x, CASE WHEN j = 0 THEN 0 ELSE his[j] END * 2 + 1, 2 * (CASE WHEN j = runs THEN n ELSE los[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE his[j] END))), '') END)) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""
