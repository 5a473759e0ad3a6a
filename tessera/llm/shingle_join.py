"""Similarity join of documents on sets of word shingles, with token-combination prefixes.

1. Every document becomes its set of distinct shingles, known by 64-bit hashes: two sets of 10**7 shingles hold a false match with a
   chance of 5e-6. Documents with one set (by 128 more bits) are one class, of which the smallest doc_id goes on.
2. A shingle of one document can't be shared. Shingles are counted by ranges of a shorter hash, and each document's
   shingles that occur elsewhere are counted: only documents with enough of them to link go on, few as a rule. Document
   frequencies are then taken among these. Sorted by frequency, then hash, shingles of one document come first.
3. Two sets of Jaccard similarity t share at least a = ceil(t * n) of n shingles, so the first one they share is among the first
   n - a + 1 of each. A shingle of a rare class in that prefix is a key by itself. If the first shared shingle is of the frequent class
   (in more than a share ``frequent`` of the documents that go on), all m shared ones are. Combinations are then keys: pairs of
   neighbours in the order of frequent shingles. Of the first u + v + 1 pairs of shared neighbours, one at least has none of the u and
   v frequent shingles that only one side has between its two, and it lies among the first 2u + v + 2 frequent shingles of that side.
   With v <= m / t - n that prefix is known to each side alone, and its keys grow with its length, not with its square.
4. Documents with a key in common are candidates. Keys with one and the same set of documents are one key. Each document is verified
   against one document of the key (a star); connected components of the links follow. Keys whose documents are still in several
   components are taken up again by the differences of the documents from the star's middle (see ``apart``), so a group of many near
   copies costs stars and not its square, and yet no link between components is lost.
5. Verification intersects the shared shingles (step 2 dropped those of one document, which meet nothing) and uses the
   sizes of the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import SALTS, components
from ..session import input_bytes, ship, written
from .columns import documents, slices, utf8
from .exchange import NULL_KEY, SCHEMA, Outbox, bits_for, dealt, mix, opened, passed, prefix_sums, ranges, sent
from .spans import to_documents

WORDS, PERCENT, FREQUENT, HASH_BITS = 5, 80, 0.001, 40
PAIRED = 67  # least percentage at which sets that link are sure to share neighbours
NOBODY = NULL_KEY + 1
PART = 1 << 20  # bytes of text worked on at a time
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WEIGHTS = mix(np.arange(101, 201, dtype=np.uint64)) | np.uint64(1)
_PAIR = np.uint64(1 << 63)


def shingles(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of the distinct shingles of all texts, in order of both."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if not len(data):
        return none
    data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(ink & (edge[:-1] | np.r_[True, ~ink[:-1]]))
    end = np.flatnonzero(ink & (edge[1:] | np.r_[~ink[1:], True])) + 1
    if not len(start):
        return none
    sums, inverse = prefix_sums(data)
    w = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _WEIGHTS[-1])
    doc = np.searchsorted(at, start, side="right") - 1
    n = np.bincount(doc, minlength=len(at) - 1)
    full = np.flatnonzero(doc[: len(doc) - words + 1] == doc[words - 1 :]) if len(doc) >= words else np.empty(0, np.int64)
    h = np.full(len(full), words, np.uint64) * _WEIGHTS[-2]
    for j in range(words):
        h += w[full + j] * _WEIGHTS[j]
    owner = doc[full]
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        first = np.searchsorted(doc, few)
        g = n[few].astype(np.uint64) * _WEIGHTS[-2]
        for j in range(words - 1):
            has = n[few] > j
            g[has] += w[first[has] + j] * _WEIGHTS[j]
        h, owner = np.concatenate([h, g]), np.concatenate([owner, few])
    h = mix(h)
    order = np.argsort(h)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]  # slices have fewer rows than that
    owner, h = owner[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    return owner[new], h[new]


def described(owner: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set, and two sums of hashes that only equal sets share."""
    n = np.bincount(owner, minlength=n_docs)
    one, two = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    if len(h):
        some = np.flatnonzero(n)
        first = np.r_[0, np.cumsum(n[some])[:-1]]
        one[some] = np.add.reduceat(mix(h), first)
        two[some] = np.add.reduceat(mix(h ^ _WEIGHTS[50]), first)
    return n, one.view(np.int64), two.view(np.int64)


def shingle_sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(k, n, d1, d2) of every document; ``docs`` has k and the text."""

    def run(batches):
        for b in slices(batches, text, PART):
            data, at = utf8(b.column(b.schema.get_field_index(text)))
            n, one, two = described(*shingles(data, at, words), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("k")), pa.array(n.astype(np.int64)), pa.array(one), pa.array(two)], names=["k", "n", "d1", "d2"])

    return docs.select("k", text).mapInArrow(run, "k long, n long, d1 long, d2 long")


class Counting(Outbox):
    """Shingles (key) of documents (k). Those that a task holds more than once are counted for their documents at once, and one entry
    of nobody's tells the range of the shingle: so a hot shingle's documents never meet there."""

    def __init__(self, bits: int, key_bits: int):
        super().__init__(bits, key_bits)
        self.direct = Outbox(bits, 64)

    def settled(self, cols, docs):
        key, doc = cols
        same = key[1:] == key[:-1]
        again = np.r_[False, same] | np.r_[same, False]
        if not again.any():
            return cols, docs
        m = np.bincount(doc[again], minlength=len(docs[0]))
        k, m = docs[0][m > 0], m[m > 0].astype(np.uint32)
        yield from self.direct.add([k], to_documents(k), np.arange(len(k)), m)
        for r, blob in self.direct.flush():
            yield r + self.n_ranges, blob
        first = again & np.r_[True, ~same]
        doc = np.where(first, len(docs[0]), doc)
        keep = first | ~again
        return [key[keep], doc[keep]], [np.append(docs[0], NOBODY)]


def repeat_counts(docs: DataFrame, text: str, words: int, bits: int, hash_bits: int = HASH_BITS) -> DataFrame:
    """(k, m): at least as many shingles as the documents of key k share with others.

    Hashes of ``hash_bits`` are enough here: a collision can only raise a count.
    """
    cut = np.uint64(64 - hash_bits)

    def send(batches):
        box = Counting(bits, hash_bits)

        def rows():
            for b in slices(batches, text, PART):
                owner, h = shingles(*utf8(b.column(b.schema.get_field_index(text))), words)
                yield from box.add([b.column(b.schema.get_field_index("k")).to_numpy()], h >> cut, owner)
            yield from box.flush()

        yield from sent(rows())

    def count(batches):
        held, size = [], 0

        def rows(parts):
            k, m = (np.concatenate(c) for c in zip(*parts, strict=True))
            keys, place = np.unique(k, return_inverse=True)
            return keys, np.bincount(place, weights=m).astype(np.uint32)

        box = Outbox(bits, 64)

        def out():
            nonlocal held, size
            known = []
            for blobs in passed(ranges(batches), 1 << bits, known):
                yield from known
                known.clear()
                h, k = (np.concatenate(c) for c in zip(*(opened(x, 0) for x in blobs), strict=True))
                order = np.argsort(h, kind="stable")
                s, k = h[order], k[order]
                same = s[1:] == s[:-1]
                k = k[np.r_[False, same] | np.r_[same, False]]
                keys, m = np.unique(k, return_counts=True)
                held.append((keys, m))
                size += len(keys)
                if size > 4_000_000:
                    keys, m = rows(held)
                    held, size = [], 0
                    yield from box.add([keys], to_documents(keys), np.arange(len(keys)), m)
            if held:
                keys, m = rows(held)
                yield from box.add([keys], to_documents(keys), np.arange(len(keys)), m)
            yield from known
            yield from box.flush()

        yield from sent(out())

    def total(batches):
        for _, blobs in ranges(batches):
            m, k = (np.concatenate(c) for c in zip(*(opened(x, 1)[1:] for x in blobs), strict=True))
            keys, place = np.unique(k, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(place, weights=m).astype(np.int64))], names=["k", "m"])

    return dealt(dealt(docs.select("k", text).mapInArrow(send, SCHEMA)).mapInArrow(count, SCHEMA)).mapInArrow(total, "k long, m long")


def shared_shingles(docs: DataFrame, text: str, words: int, bits: int) -> DataFrame:
    """Entries (shingle, document frequency) by document, of shingles of more than one document."""

    def send(batches):
        box = Outbox(bits, 64)

        def rows():
            for b in slices(batches, text, PART):
                data, at = utf8(b.column(b.schema.get_field_index(text)))
                owner, h = shingles(data, at, words)
                n, one, _ = described(owner, h, b.num_rows)
                yield from box.add([b.column(b.schema.get_field_index("k")).to_numpy(), one, n.astype(np.uint32)], h, owner)
            yield from box.flush()

        yield from sent(rows())

    def count(batches):
        box = Outbox(bits, 64)

        def rows():
            for _, blobs in ranges(batches):
                h, k, one, n = (np.concatenate(c) for c in zip(*(opened(x, 0) for x in blobs), strict=True))
                order = np.argsort(h, kind="stable")
                s = h[order]
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                df = np.repeat(np.diff(np.r_[first, len(s)]), np.diff(np.r_[first, len(s)]))
                again = order[df > 1]
                h, k, one, n, df = h[again], k[again], one[again], n[again], df[df > 1]
                yield from box.add([k, one, n], to_documents(k), np.arange(len(k)), h, df.astype(np.uint32))
            yield from box.flush()

        yield from sent(rows())

    return dealt(docs.select("k", text).mapInArrow(send, SCHEMA)).mapInArrow(count, SCHEMA)


def needed(n, percent: int):
    """Least number of shingles that a set of n shares with a set it links with."""
    return (percent * n + 99) // 100


def prefix_keys(h: np.ndarray, df: np.ndarray, n: int, percent: int, frequent: int) -> np.ndarray:
    """Keys of a set of ``n`` shingles, of which ``h`` are shared with other documents; those in more than ``frequent`` are combined."""
    least, own = needed(n, percent), n - len(h)
    room = n - least + 1 - own  # of the prefix, after the shingles that only this document has
    if room <= 0 or n < 2:
        return np.empty(0, np.uint64)
    order = np.lexsort((h, df))
    h = h[order]
    rare = int(np.count_nonzero(df <= frequent))
    often = len(h) - rare
    if percent < PAIRED or often < least:
        return h[: room if percent < PAIRED else min(room, rare)] >> np.uint64(1)
    long = max(2 * (often - m) + 100 * m // percent - n for m in (least, often)) + 2
    f = h[rare : rare + long]
    return np.concatenate([h[: min(room, rare)] >> np.uint64(1), mix(f[:-1] * _WEIGHTS[60] + f[1:]) | _PAIR])


def prefixed(entries: DataFrame, percent: int, frequent: int) -> DataFrame:
    """(k, d1, n, m, shingles, keys) of the documents that share enough shingles to link with any."""

    def run(batches):
        for _, blobs in ranges(batches):
            h, df, k, one, n = (np.concatenate(c) for c in zip(*(opened(x, 2)[1:] for x in blobs), strict=True))
            order = np.lexsort((h, one, k))
            h, df, k, one, n = (c[order] for c in (h, df, k, one, n))
            new = np.r_[True, (h[1:] != h[:-1]) | (one[1:] != one[:-1]) | (k[1:] != k[:-1])]  # a repeated row brings nothing new
            h, df, k, one, n = (c[new] for c in (h, df, k, one, n))
            cut = np.r_[0, np.flatnonzero((k[1:] != k[:-1]) | (one[1:] != one[:-1])) + 1, len(k)]
            enough = np.flatnonzero(np.diff(cut) >= needed(n[cut[:-1]].astype(np.int64), percent))
            held = []
            for lo, hi in zip(cut[enough].tolist(), cut[enough + 1].tolist(), strict=True):
                keys = prefix_keys(h[lo:hi], df[lo:hi], int(n[lo]), percent, frequent)
                held.append((int(k[lo]), int(one[lo]), int(n[lo]), hi - lo, h[lo:hi].tobytes(), keys.view(np.int64).tolist()))
                if len(held) >= 500:
                    yield out(held)
                    held = []
            if held:
                yield out(held)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k", "d1", "n", "m", "shingles", "keys"])

    return dealt(entries).mapInArrow(run, "k long, d1 long, n long, m long, shingles binary, keys array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    x = sets.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))

    def run(batches):
        for t in batches:
            na, nb = (t.column(i).to_numpy() for i in (2, 3))
            keep = np.zeros(t.num_rows, bool)
            for i, (p, q) in enumerate(zip(t.column(4).to_pylist(), t.column(5).to_pylist(), strict=True)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = 100 * both >= percent * (int(na[i]) + int(nb[i]) - both)
            yield t.select([0, 1]).filter(pa.array(keep))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def fits(na, ma, nb, mb, percent: int):
    """Whether sets of ``na`` and ``nb`` shingles, of which ``ma`` and ``mb`` occur elsewhere, can link: the shared part is at most
    the lesser of these."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * F.least(ma, mb) >= percent * (na + nb))


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the documents that link with any, smallest k first; ``sets``: see ``prefixed``.

    The star's middle is the document of the key with the least share of shingles of its own: of many edited copies that is
    one that was hardly edited, which most others are near to.
    """
    key = sets.select("k", "d1", "n", "m", F.explode("keys").alias("key"), F.pmod(F.xxhash64("k"), F.lit(SALTS)).alias("s"))
    middle = F.min(F.struct((-F.col("m") / F.col("n")).alias("own"), "k", "n", "m"))
    members = [F.bit_xor(F.xxhash64("k", "d1", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    parts = key.groupBy("key", "s").agg(middle.alias("p"), F.count("*").alias("size"), *members)  # a hot key's documents meet in no one task
    some = parts.groupBy("key").agg(F.min("p").alias("p"), F.sum("size").alias("size"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1")).filter("size > 1")
    kept = some.groupBy("size", "x0", "x1").agg(F.min(F.struct("key", "p")).alias("z")).select("z.key", "z.p")  # one of the keys of the same documents
    at = parts.select("key", "s").join(kept, "key")
    mine = written(key.join(at, ["key", "s"]).select("key", "k", "n", "m", "p"), "members")
    star = mine.filter((F.col("k") != F.col("p.k")) & fits(F.col("n"), F.col("m"), F.col("p.n"), F.col("p.m"), percent))
    star = star.select(F.least("k", "p.k").alias("a"), F.greatest("k", "p.k").alias("b")).distinct()
    found = components(linked(star, sets, percent))
    c = {"lo": F.min("c"), "hi": F.max("c")}
    apart_ = with_groups(labelled(mine, found), ["key"], c, {"lo": F.min("lo"), "hi": F.max("hi")}, "lo < hi")
    rest = written(apart_.select("k", F.col("p.k").alias("p")).distinct(), "split-keys")
    if rest.isEmpty():
        return found
    return apart(rest, sets, found, percent)


def with_groups(rows: DataFrame, keys: list[str], parts: dict[str, Column], whole: dict[str, Column], which: str = "true") -> DataFrame:
    """``rows`` with the aggregates ``whole`` over their group's ``parts``, of groups ``which`` holds for.

    A group's rows are dealt over many tasks by ``k``, each with a part of the aggregate, so that a hot group meets in no one task.
    """
    x = rows.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(SALTS)))
    some = x.groupBy(*keys, "s").agg(*[v.alias(n) for n, v in parts.items()])
    every = some.groupBy(*keys).agg(*[v.alias(n) for n, v in whole.items()]).filter(which)
    return x.join(some.select(*keys, "s").join(every, keys), [*keys, "s"]).drop("s")


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the component ``c`` of their document ``k``."""
    return rows.join(found.withColumnsRenamed({"node": "k"}), "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component")


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, k, n, size, tokens): by how many shingles, and which that occur elsewhere, a document differs from the shared ones of p."""
    x = sets.select("k", "n", F.col("shingles").alias("sx"))
    y = sets.select(F.col("k").alias("p"), F.col("shingles").alias("sp"))

    def run(batches):
        for t in batches:
            rows = []
            for p, k, n, a, b in zip(*(t.column(i).to_pylist() for i in range(5)), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                d = np.setxor1d(a, b, assume_unique=True)
                rows.append((p, k, n, len(d) + n - len(a), d.astype(np.int64).tolist()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, q) for c, q in zip(cols, kinds, strict=True)], names=["p", "k", "n", "size", "tokens"])

    return members.join(x, "k").join(y, "p").select("p", "k", "n", "sx", "sp").mapInArrow(run, "p long, k long, n long, size long, tokens array<long>")


def apart(rest: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(node, component), with the links that ``found``, the components of the stars, leaves out, of documents ``k`` whose key's documents are still apart; ``p`` is
    the middle of that key.

    With D(x) the difference of x from the middle of its key, two documents differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)|, and link
    if that is at most (100 - percent) / (100 + percent) of n(x) + n(y). Either the sizes alone are small enough: then
    both also link, by that rule, with the document whose size is least, one star. Or D(x) and D(y) share a shingle: an index of
    differences finds them, first as stars on its shingles and then, between components, as pairs. Differences of near copies
    are small, and most of their shingles are a document's own, so few pairs are left however large the group.
    """
    more, less = 100 + percent, 100 - percent
    members = rest.filter("k != p")
    d = written(differences(members, sets), "differences")
    over = more * F.col("size") - less * F.col("n")
    least = {"z": F.min(F.struct(over.alias("f"), "k"))}
    near = with_groups(d, ["p"], least, {"z": F.min("z")}).filter((F.col("k") != F.col("z.k")) & (over + F.col("z.f") <= 0)).select(F.least("k", "z.k").alias("a"), F.greatest("k", "z.k").alias("b"))
    found = components(found.union(near), "node", "component")
    t = d.select("p", "k", "n", "size", F.explode("tokens").alias("t"))
    t = with_groups(t, ["p", "t"], {"df": F.count("*")}, {"df": F.sum("df")}, "df > 1")
    w = Window.partitionBy("p", "k")
    t = t.withColumns({"able": F.count("*").over(w), "at": F.row_number().over(w.orderBy("df", "t"))})
    need = F.greatest(F.lit(1), F.col("size") - F.floor(less * F.col("n") / percent))  # at least so many are shared with any partner
    index = written(t.filter((F.col("able") >= need) & (F.col("at") <= F.col("able") - need + 1)).select("p", "t", "k", "n", "size", "able"), "difference-index")

    def may(n1, d1, a1, n2, d2, a2):
        size = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
        return size & (2 * more * F.least(a1, a2) >= more * (d1 + d2) - less * (n1 + n2))

    low = with_groups(index, ["p", "t"], {"z": F.min(F.struct("size", "k", "n", "able"))}, {"z": F.min("z")})
    z = low.filter((F.col("k") != F.col("z.k")) & may(F.col("n"), F.col("size"), F.col("able"), F.col("z.n"), F.col("z.size"), F.col("z.able")))
    z = labelled(z.select("k", F.col("z.k").alias("o")).distinct(), found).withColumnsRenamed({"k": "a", "c": "ca"})
    z = labelled(z.withColumnRenamed("o", "k"), found).filter("ca != c").select(F.least("a", "k").alias("a"), F.greatest("a", "k").alias("b")).distinct()
    found = components(found.union(linked(z, sets, percent)), "node", "component")
    x = written(labelled(index, found), "labelled-index")
    y = x.withColumnsRenamed({c: f"{c}2" for c in x.columns})
    hit = (F.col("p") == F.col("p2")) & (F.col("t") == F.col("t2")) & (F.col("c") < F.col("c2"))
    pairs = x.join(y, hit & may(F.col("n"), F.col("size"), F.col("able"), F.col("n2"), F.col("size2"), F.col("able2")))
    pairs = pairs.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()
    return components(found.union(linked(pairs, sets, percent)), "node", "component")


def shingle_components(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = WORDS, percent: int = PERCENT, frequent: float = FREQUENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row. ``frequent``: see step 3 above.

    Null, empty and wordless texts have empty sets and link with nothing. Rows that share a key are one document of the graph;
    those with a null key are one that precedes all others, and their component is null. Columns besides key and text are not
    carried. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"), F.col(text).alias("text"))
    bits = bits_for(input_bytes(docs))
    sets = written(shingle_sets(d, "text", words), "shingle-sets")
    classes = sets.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("k").alias("rep"))
    reps = classes.select(F.col("rep").alias("k"), "d1", "n")
    able = repeat_counts(d, "text", words, bits).join(reps, "k").filter(F.col("m") >= F.floor((percent * F.col("n") + 99) / 100)).select("k").distinct()
    able = written(able, "able")
    some = d.join(able, "k", "left_semi")
    shared = prefixed(shared_shingles(some, "text", words, bits), percent, int(frequent * able.count()))
    found = links(written(shared.join(reps.select("k", "d1"), ["k", "d1"], "left_semi"), "prefixes"), percent)
    own = classes.join(found.withColumnsRenamed({"node": "rep", "component": "to"}), "rep", "left").select("d1", "d2", "n", F.coalesce("to", "rep").alias("component"))
    own = written(own, "classes")
    out = sets.join(own, ["d1", "d2", "n"], "left")
    plain = F.coalesce("component", "k")
    return out.select(F.when(F.col("k") != NULL_KEY, F.col("k")).cast(kind).alias(key), F.col("n").alias("n_shingles"), F.when(plain != NULL_KEY, plain).cast(kind).alias("component_id"))


def op6_shingle_join(spark, sf_dir: str) -> DataFrame:
    return shingle_components(documents(spark, sf_dir))


#: The same components from all pairs with a shingle in common; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), q AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1), r AS (SELECT s.* FROM s JOIN q USING (g)),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
c AS (SELECT doc_id AS k, doc_id AS o FROM documents UNION SELECT c.k, e.b FROM c JOIN e ON e.a = c.o)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT k, min(o) AS m FROM c GROUP BY k) ON k = doc_id
"""
