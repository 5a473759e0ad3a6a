"""I-Match fingerprints over randomised lexicon subsets.

A lexicon holds the terms whose inverse document frequency, ln(documents / document frequency), lies in a band: common words
say little and rare ones are often errors. A text's distinct lexicon terms are sorted and hashed, once for each of ``subsets``
randomised subsets of the lexicon; a term's own hash decides its subsets, so no state is shared. Two texts are as alike as the
share of subsets whose hashes agree.

The band's upper limit bounds the lexicon: a document has d distinct terms on average, and terms in at least a share exp(-high) of the
documents number at most d * exp(high). A lexicon of at most MOST_TERMS terms goes to every task; a larger one, as of very long documents,
stays a table that the texts' terms are joined with. Both ways give the same fingerprints.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import input_bytes, ship, written
from .columns import blobs, documents, slices

LOW_IDF, HIGH_IDF, SUBSETS, LARGEST, SMALLEST = 1.0, 6.5, 48, 0.2, 0.001
MOST_TERMS = 2_000_000
_NONE = "0" * 8


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(term, df) over all documents; each slice is counted before anything is shuffled."""

    def run(batches):
        held = Counter()
        for b in slices(batches, text):
            for t in blobs(b.column(b.schema.get_field_index(text))):
                held.update(set(t.lower().split()))
            if len(held) > 300_000:
                yield rows(held)
                held = Counter()
        if held:
            yield rows(held)

    def rows(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["term", "df"])

    return docs.select(text).mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str, low: float, high: float) -> DataFrame:
    """The terms of the band, stored."""
    n = docs.count()
    df = F.col("df")
    inside = (df >= n * float(np.exp(-high))) & (df <= n * float(np.exp(-low))) & (df >= 2)
    return written(document_frequencies(docs, text).filter(inside).select("term"), "lexicon")


def shares(subsets: int, largest: float, smallest: float) -> list[float]:
    """The share of the lexicon in each subset: the whole, then geometric steps, so that short and long texts have telling ones."""
    return [1.0] + [largest * (smallest / largest) ** (k / max(subsets - 2, 1)) for k in range(subsets - 1)]


class Fingerprinter:
    """The hashes of a text's lexicon terms, one for each randomised subset (64 at most)."""

    def __init__(self, terms: set[bytes], limits: list[float]):
        self.limits = np.array([int(x * 65536) for x in limits], np.int64)
        self.index = {t: i for i, t in enumerate(sorted(terms))}
        self.hashes, self.bits = self._terms(list(self.index))

    def _terms(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each term's hash, and whether it is in each subset."""
        n = len(self.limits)
        draws = np.frombuffer(b"".join(hashlib.shake_128(b"subset:" + t).digest(2 * n) for t in terms), "<u2").reshape(-1, n)
        return np.array([xxhash.xxh3_64_intdigest(t) for t in terms], np.uint64), draws < self.limits

    def __call__(self, text: bytes) -> tuple[str, ...]:
        """Without lexicon terms, all distinct terms are used: unrelated short texts don't look alike."""
        words = set(text.lower().split())
        own = sorted([i for i in map(self.index.get, words) if i is not None])
        return self._hashed(self.hashes[own], self.bits[own]) if own else self.of(words)

    def of(self, terms: Iterable[bytes]) -> tuple[str, ...]:
        """The hashes of these terms, whatever the lexicon."""
        return self._hashed(*self._terms(sorted(terms)))

    def _hashed(self, hashes: np.ndarray, bits: np.ndarray) -> tuple[str, ...]:
        subset, term = np.nonzero(bits.T)
        ends = np.searchsorted(subset, np.arange(len(self.limits) + 1)) * 8
        raw, ends = hashes[term].tobytes(), ends.tolist()
        return tuple([f"{xxhash.xxh3_64_intdigest(raw[x:y]) >> 32:08x}" if y > x else _NONE for x, y in zip(ends, ends[1:], strict=False)])


def likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of subsets, of those that hold a term of either text, whose hashes agree; 1 if neither text has any."""
    used = [(x, y) for x, y in zip(a, b, strict=True) if x != _NONE or y != _NONE]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def joined_terms(rows: DataFrame, band: DataFrame) -> DataFrame:
    """``rows`` with ``own``: of each list of terms in ``words`` those of the lexicon, by a join on the term."""
    rows = written(rows, "words").withColumn("id", F.monotonically_increasing_id())
    rows = written(rows, "numbered-words")
    t = rows.select("id", F.posexplode("words").alias("which", "terms")).select("id", "which", F.explode("terms").alias("term"))
    lists = t.join(band, "term").groupBy("id", "which").agg(F.collect_list("term").alias("terms"))
    found = lists.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("which", "terms"))).alias("found"))
    own = F.transform("words", lambda _, i: F.coalesce(F.try_element_at("found", i), F.array().cast("array<binary>")))
    return rows.join(found, "id", "left").withColumn("found", F.coalesce("found", F.create_map().cast("map<int,array<binary>>"))).withColumn("own", own).drop("found", "id")


def in_memory(band: DataFrame, limits: list[float]) -> Fingerprinter | None:
    """The fingerprinter of a lexicon that is small enough to be sent to every task."""
    if band.count() > MOST_TERMS:
        return None
    return Fingerprinter({bytes(r["term"]) for r in band.toLocalIterator()}, limits)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", *, low: float = LOW_IDF, high: float = HIGH_IDF, subsets: int = SUBSETS, largest: float = LARGEST, smallest: float = SMALLEST) -> DataFrame:
    """Every row's key and fingerprint.

    Null texts are empty; texts without words share one fingerprint; repeated rows get equal ones; null keys stay null; a text of any length
    is taken whole; columns besides these, whatever their names, aren't carried; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    band, limits, kind = lexicon(docs, text, low, high), shares(subsets, largest, smallest), dict(docs.dtypes)[key]
    rows, known = docs.select(F.col(key).alias("own_key"), F.col(text).alias("text")), in_memory(band, limits)
    if known is None:

        def terms(batches):
            for b in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[list(set(t.lower().split()))] for t in blobs(b.column(1))], pa.list_(pa.list_(pa.binary())))], names=["own_key", "words"])

        def hashed(batches):
            fp = Fingerprinter(set(), limits)
            for b in batches:
                made = ["-".join(fp.of(o[0] or w[0])) for w, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=[key, "fingerprint"])

        rows = joined_terms(rows.mapInArrow(terms, f"own_key {kind}, words array<array<binary>>"), band)
        return rows.select("own_key", "words", "own").mapInArrow(hashed, f"`{key}` {kind}, fingerprint string")
    shared = spark.sparkContext.broadcast(known)

    def run(batches):
        fp = shared.value
        for b in slices(batches, "text"):
            made = ["-".join(fp(t)) for t in blobs(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=[key, "fingerprint"])

    return rows.mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt into ranges of ``key``; the first row of each range is also given to the range before it (``look``).

    The limits of the ranges are keys that occur, so the first row of a range is known without a look at the others. The first
    row of all follows the last one. Rows with a null key come first; ties are in order of the text's hash. Texts travel
    compressed, each on its own.
    """
    spark = docs.sparkSession
    n = max(1, min(20_000, input_bytes(docs) // (4 << 20)))
    k = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    rows = docs.select(k.alias("k"), F.col(key).alias("own"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    found = rows.agg(F.min("k").alias("low"), F.percentile_approx("k", [i / n for i in range(n)], max(10_000, 5 * n)).alias("at")).first()
    limits = sorted({found["low"], *found["at"]}) if found["low"] is not None else []
    edges = spark.sparkContext.broadcast(np.array(limits, np.int64))
    last = max(len(limits) - 1, 0)

    def deal(batches):
        at = edges.value
        for b in batches:
            if not b.num_rows:
                continue
            ks = b.column(0).to_numpy()
            r = np.searchsorted(at, ks, side="right") - 1
            first = np.flatnonzero(at[r] == ks)
            to = np.where(r[first] > 0, r[first] - 1, last)
            packer = zstandard.ZstdCompressor(level=1)
            texts = pa.array([packer.compress(t) for t in blobs(b.column(2))], pa.binary())
            cols = [pa.concat_arrays([c, c.take(pa.array(first))]) for c in (*b.columns[:2], texts, b.column(3))]
            look = np.r_[np.zeros(len(ks), bool), np.ones(len(first), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[r, to].astype(np.int32)), pa.array(look), *cols], names=["range", "look", "k", "own", "text", "h"])

    dealt = rows.mapInArrow(deal, f"range int, look boolean, k long, own {dict(docs.dtypes)[key]}, text binary, h long")
    return dealt.repartitionByRange(len(limits) or 1, "range").sortWithinPartitions("range", "look", "k", "h")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", *, low: float = LOW_IDF, high: float = HIGH_IDF, subsets: int = SUBSETS, largest: float = LARGEST, smallest: float = SMALLEST) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half gives way to the start of the next document.

    A single document is its own next. Null texts are empty, null keys come first, repeated rows follow one another, a text of any length is
    taken whole, other columns, whatever their names, are not carried; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    band, limits = lexicon(docs, text, low, high), shares(subsets, largest, smallest)
    known = in_memory(band, limits)
    shared = spark.sparkContext.broadcast(known)
    kind = dict(docs.dtypes)[key]
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def edited(batches, of, row):
        """``row`` of each document: its key, length and digest, and what ``of`` makes of its text, the edited one and the next."""
        held = None  # range, key, text, what is made of it, whether it is the next range's
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for r, look, own, t in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("range", "look", "own", "text")), strict=True):
                t = unpacker.decompress(t).decode()
                made = of(t.encode())
                if held and held[0] == r and not (look and held[4]):
                    me = held[2]
                    half = len(me) // 2
                    changed = (me[: len(me) - half] + t[:half]).encode()
                    rows.append(row(held[1], len(me), hashlib.sha256(changed).hexdigest(), held[3], of(changed), made))
                held = (r, own, t, made, look)
            if rows:
                yield b.schema.field("own").type, list(zip(*rows, strict=True))

    def with_likeness(own, n, digest, f, e, g):
        return own, n, digest, "-".join(f), "-".join(e), likeness(f, e), likeness(f, g)

    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    near = with_next(docs, key, text)
    if known is not None:

        def run(batches):
            for t, cols in edited(batches, shared.value, with_likeness):
                yield pa.RecordBatch.from_arrays([pa.array(c, t if i == 0 else None) for i, c in enumerate(cols)], names=names)

        return near.mapInArrow(run, schema)

    def terms(batches):
        lists = pa.list_(pa.list_(pa.binary()))
        for t, cols in edited(batches, lambda x: list(set(x.lower().split())), lambda own, n, digest, *w: (own, n, digest, w)):
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (t, pa.int64(), pa.string(), lists), strict=True)], names=["own_key", "n_chars", "edited_sha256", "words"])

    def hashed(batches):
        fp = Fingerprinter(set(), limits)
        for b in batches:
            if b.num_rows:
                rows = [with_likeness(k, n, d, *(fp.of(o or w) for w, o in zip(ws, os, strict=True))) for k, n, d, ws, os in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, b.column(0).type if i == 0 else None) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    rows = joined_terms(near.mapInArrow(terms, f"own_key {kind}, n_chars long, edited_sha256 string, words array<array<binary>>"), band)
    return rows.select("own_key", "n_chars", "edited_sha256", "words", "own").mapInArrow(hashed, schema)


def op5_i_match(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


