"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Every document (ids and a closing id) longer than a sequence is cut into full pieces; pieces are packed longest first, each
into the open sequence with the least room that still holds it. All pieces of one length are alike to the algorithm, so the
plan is made from the histogram of lengths (at most ``seq_len`` numbers, whatever the corpus): a segment tree over remaining
capacities finds the tightest open capacity in logarithmic time, and a run of equally filled sequences takes a run of equal
pieces at once. This gives the sequences that piece-by-piece best-fit decreasing gives. The plan is a list of runs, a few for
each pair of length and capacity that meet, so its size is bounded by ``seq_len`` and not by the corpus; the pieces find their run by their number among pieces of
their length, which needs only counts per partition and length.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from collections import deque
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written
from .columns import documents, kept, slices, trim, utf8

SEQ_LEN, END_ID = 4096, 1
CACHE_WORDS = 450_000  # twice as many are held


class SegmentTree:
    """Counts of open sequences by remaining capacity; ``tightest(need)`` is the least capacity >= need that has any."""

    def __init__(self, capacity: int):
        self.base = 1
        while self.base <= capacity:
            self.base *= 2
        self.sums = [0] * (2 * self.base)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.base
        while i:
            self.sums[i] += n
            i //= 2

    def tightest(self, need: int) -> int | None:
        """Climb from the leaf ``need`` until a right subtree (or the leaf) is occupied, then go down to its least leaf."""
        i = need + self.base
        if not self.sums[i]:
            while i > 1 and (i % 2 or not self.sums[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.sums[2 * i] else 2 * i + 1
        return i - self.base


def plan_runs(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Runs (length, first piece, pieces per sequence, first sequence, offset): pieces of that length from ``first piece`` on go,
    ``per`` at a time, into consecutive sequences, at ``offset``, ``offset + length`` and so on.
    """
    tree, open_ = SegmentTree(seq_len), {}
    runs, n_seq = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, deque()).append((first, n))
            tree.add(room, n)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, at = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = seq_len, n_seq
                n = -(-left // (seq_len // length))
                n_seq += n
            else:
                first, n = open_[room].popleft()
                tree.add(room, -n)
                if not open_[room]:
                    del open_[room]
            per = room // length  # after one piece the sequence is the tightest that holds another
            full = min(n, left // per)
            if full:
                runs.append((length, at, per, first, seq_len - room))
                at, left = at + full * per, left - full * per
                put(room - per * length, first, full)
            if left and full < n:  # fewer pieces remain than the next sequence could take
                runs.append((length, at, left, first + full, seq_len - room))
                put(room - left * length, first + full, 1)
                at, left, full = at + left, 0, full + 1
            put(room, first + full, n - full)
    return runs


_TAIL, _GAP, _PLAIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_TAIL[list(b",.")] = True
_GAP[list(b" \n")] = True
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def separable(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether, in each text, each closing punctuation mark before a space or line end follows a letter or a number.

    Then a space may be put before the mark without joining or parting any of the tokenizer's own words. Other texts, and those
    that may hold the name of a special token, are left as they are.
    """
    ok = np.ones(len(at) - 1, bool)
    i = np.flatnonzero(_TAIL[data[:-1]] & _GAP[data[1:]])
    i = i[i > 0] if len(i) else i
    before = data[i - 1]
    bad = i[~_PLAIN[before] & (before < 0x80)]
    wide = i[before >= 0x80]
    two = wide[(wide > 1) & (data[wide - 2] >= 0xC2) & (data[wide - 2] < 0xE0)]
    code = data[two - 2].astype(np.int64) << 8 | data[two - 1]
    strange = [c for c in np.unique(code).tolist() if c == 0xC4B0 or not c.to_bytes(2, "big").decode().isalnum()]  # U+0130 is lowered to two
    bad = np.concatenate([bad, two[np.isin(code, strange)], np.setdiff1d(wide, two)])
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    ok[np.searchsorted(at, np.concatenate([bad, special]), side="right") - 1] = False
    return ok


# The parts of a tokenizer file that the word cache relies on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# End of fixed values.


def word_by_word(spec: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space and never merges across it, so that words can be encoded apart."""
    pre, model = (spec.get("pre_tokenizer") or {}).get("pretokenizers", []), spec.get("model") or {}
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    plain = len(pre) == 2 and pre[0] == split and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex", True)
    bpe = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
    return bool(spec.get("normalizer") == NORMALIZER and plain and bpe and all("<|" in t["content"] for t in spec.get("added_tokens", [])))


class WordEncoder:
    """UTF-8 texts to ids, as little-endian unsigned 32-bit numbers.

    A tokenizer that isn't ``word_by_word`` encodes each text as it is. One that is drops white space, never merges across it, and lower-cases; so the words between ASCII white space are encoded
    once each and looked up afterwards. Where ``separable`` allows, ASCII letters are lowered and closing marks parted from
    words first, which leaves fewer words. Words of letters are encoded many to a call, and told apart again by the mark that
    the last token of a word bears. The cache is bounded: once it is full it becomes the one before, from which words still in use
    are taken over.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.words = Tokenizer.from_file(tokenizer), {}
        self.before: dict[bytes, bytes] = {}
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(tokenizer, encoding="utf-8") as f:
            self.apart = word_by_word(json.load(f))
        if not self.apart:
            return
        vocab = self.tok.get_vocab()
        suffix = self.tok.model.end_of_word_suffix
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def _one(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 5000):
            part = words[k : k + 5000]
            for w, e in zip(part, self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.words[w] = np.array(e.ids, "<u4").tobytes()

    def _many(self, words: list[bytes]) -> None:
        """Words of letters alone: one word of the tokenizer's each, unless lower-casing makes something else of one."""
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self.tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != len(part):
                self._one(part)
                continue
            raw, lo = ids.tobytes(), 0
            for w, hi in zip(part, ends.tolist(), strict=True):
                self.words[w] = raw[lo:hi]
                lo = hi

    def __call__(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        if not self.apart:
            raw = data.tobytes()
            texts = [raw[lo:hi].decode() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        gc.disable()  # millions of short-lived words, and no cycles
        try:
            return self._encode(data, at)
        finally:
            gc.enable()

    def _encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        raw, texts = data.tobytes(), []
        for lo, hi, plain in zip(at[:-1].tolist(), at[1:].tolist(), separable(data, at).tolist(), strict=True):
            t = raw[lo:hi]
            if plain:
                t = t.lower()
                for c in (b",", b"."):
                    if c in t:
                        t = t.replace(c + b" ", b" " + c + b" ").replace(c + b"\n", b" " + c + b" ")
            texts.append(t.split())
        new = set(filterfalse(self.words.__contains__, chain.from_iterable(texts)))
        if len(self.words) + len(new) > CACHE_WORDS:
            self.before, self.words = self.words, {}
            new = set().union(*texts)
        again = list(filter(self.before.__contains__, new))
        self.words.update(zip(again, map(self.before.__getitem__, again), strict=True))
        new.difference_update(again)
        letters, other = [], []
        for w in new:
            (letters if w.isalpha() or w.decode().isalpha() else other).append(w)
        self._many(letters)
        self._one(other)
        return [b"".join(map(self.words.__getitem__, t)) for t in texts]


def encoder(tokenizer: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file; its words last over the operator's tasks."""
    return kept(("words", tokenizer), lambda: WordEncoder(tokenizer))


def pieces(docs: DataFrame, tokenizer: str, seq_len: int, end_id: int, key: str, text: str) -> DataFrame:
    """One row per piece, with its number (``at``) among pieces of its length in its task (``part``)."""
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for b in slices(batches, text):
            data, at = utf8(b.column(b.schema.get_field_index(text)))
            rows = [[] for _ in range(7)]
            for k, e in enumerate(ids(data, at)):
                e += end
                for p, lo in enumerate(range(0, len(e) // 4, seq_len)):
                    cut = e[4 * lo : 4 * (lo + seq_len)]
                    n = len(cut) // 4
                    seen[n] = seen.get(n, -1) + 1
                    for col, v in zip(rows, (k, p, lo, n, zlib.crc32(cut), part, seen[n]), strict=True):
                        col.append(v)
            own = b.column(b.schema.get_field_index(key)).take(pa.array(rows[0], pa.int64()))
            cols = [pa.array(r, t) for r, t in zip(rows[1:], (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([own, *cols], names=[key, "piece", "start", "length", "ids_crc32", "part", "at"])
        trim()

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part int, at long"
    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, *, seq_len: int = SEQ_LEN, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its sequence and its offset there.

    A null text is an empty one: a single closing id. Repeated rows are packed each on its own; pieces of equal length
    are interchangeable and placed in order of their task. Other columns of ``docs`` are not carried. No rows give no sequences.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = written(pieces(docs, tokenizer, seq_len, end_id, key, text), "pieces")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most seq_len rows
    runs = sorted(plan_runs({r["length"]: r["n"] for r in histogram}, seq_len))
    starts = np.array([(r[0] << 44) + r[1] for r in runs], np.int64)
    plan = np.array(runs, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((starts, plan))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = f"`{key}` {dict(rows.dtypes)[key]}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches):
        starts, plan = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            run = plan[np.searchsorted(starts, (length << 44) + number, side="right") - 1]
            rel = number - run[:, 1]
            seq, off = run[:, 3] + rel // run[:, 2], run[:, 4] + rel % run[:, 2] * length
            old = [b.column(b.schema.get_field_index(c)) for c in (key, "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*old, pa.array(seq), pa.array(off)], names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = rows.join(base, ["length", "part"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("number"))
    return numbered.mapInArrow(place, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
