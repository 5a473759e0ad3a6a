import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessera.llm import chunk_dedup as C
from tessera.llm import suffix_dedup as S


def digest(raw, mark):
    runs = np.diff(np.r_[0, mark.astype(int)])
    return len(raw), int(mark.sum()), int((runs == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~mark])).hexdigest()


def brute_suffix(docs, n):
    seen, out = set(), {}
    for k, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        mark = np.zeros(len(raw), bool)
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                mark[i : i + n] = True
            seen.add(raw[i : i + n])
        out[k] = digest(raw, mark)
    return out


def brute_chunks(docs):
    """The same rule, written byte by byte."""
    seen, out = set(), {}
    for k, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        padded, cuts, lo = bytes(32) + raw, [0], 0
        for i in range(1, len(raw) + 1):
            h = sum(int(C.GEAR[padded[32 + i - 1 - j]]) << j for j in range(32)) & 0xFFFFFFFF
            if i - lo >= C.MIN_CHUNK and h >> (32 - C.MASK_BITS) == 0 and i < len(raw) or i - lo == C.MAX_CHUNK and i < len(raw):
                lo = i
                cuts.append(i)
        mark = np.zeros(len(raw), bool)
        for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True):
            d = xxhash.xxh3_128_digest(raw[a:b])
            if b > a and d in seen:
                mark[a:b] = True
            seen.add(d)
        edge = np.diff(np.r_[0, mark.astype(int), 0])
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a < C.MIN_SPAN:
                mark[a:b] = False
        out[k] = digest(raw, mark)
    return out


def corpus(n=150, seed=5):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé ") for _ in range(r.randint(60, 500))) for _ in range(25)]
    docs = []
    for i in range(n):
        t = "".join(r.choice(base)[r.randint(0, 40) :] for _ in range(r.randint(0, 5)))
        t = "x" * r.randint(0, 500) if i % 17 == 0 else "ab" * r.randint(0, 300) + t if i % 19 == 0 else t
        docs.append((i * 3, None if i % 23 == 0 else t))
    return docs


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, n_bytes string").repartition(5)


def test_suffix_array():
    r = random.Random(0)
    for _ in range(400):
        s = np.array([r.randint(0, r.choice([0, 1, 2, 5])) for _ in range(r.randint(0, 60))], np.int64)
        assert S.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_dedup(spark):
    docs = corpus()
    assert result(S.suffix_dedup(frame(spark, docs))) == brute_suffix(docs, 100)


def test_small_sorts_and_other_lengths(spark, monkeypatch):
    docs = corpus(60, 8)
    monkeypatch.setattr(S, "SORT_BYTES", 500)
    assert result(S.suffix_dedup(frame(spark, docs), length=40, gram=12)) == brute_suffix(docs, 40)


def test_long_windows(spark):
    """Anchors with more than 255 starts."""
    r = random.Random(9)
    a = "".join(r.choice("abcdefgh é") for _ in range(3000))
    docs = [(1, a), (2, "x" + a[:2500] + "y" + a[1000:]), (3, a[200:700]), (4, a[300:690] * 3)]
    assert result(S.suffix_dedup(frame(spark, docs), length=400)) == brute_suffix(docs, 400)
    for bad in ({"length": 32}, {"length": 40_000}, {"gram": 0}):
        with pytest.raises(ValueError):
            S.suffix_dedup(frame(spark, docs), **bad)


def test_hot_anchors_go_by_windows(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "HOT", 2)
    docs = corpus(120, 6)
    r = random.Random(3)
    line = "".join(r.choice("abcdef gh") for _ in range(160))
    docs += [(1000 + i, "".join(r.choice("klmnop") for _ in range(r.randint(0, 90))) + line[r.randint(0, 40) :] + str(i)) for i in range(80)]
    df = frame(spark, docs)
    d, t = S.identified(df, "doc_id", "text")
    assert len(S.hot_anchors(d, t, 100, 32)) > 0
    assert result(S.suffix_dedup(df)) == brute_suffix(docs, 100)


def test_blocks_join_without_a_seam(monkeypatch):
    r = np.random.default_rng(4)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    at = np.array([0, 1700, 1750, 5000])
    whole = S.anchored(data, at, 100, 32)
    monkeypatch.setattr(S, "BLOCK", 256)
    assert all((a == b).all() for a, b in zip(whole, S.anchored(data, at, 100, 32), strict=True))


def test_very_long_text(spark):
    """A passage across the seam of two blocks, given again at the end of the same text and in another."""
    r = np.random.default_rng(8)
    body = bytearray(r.integers(97, 123, S.BLOCK + 400_000).astype(np.uint8).tobytes())
    passage = bytes(body[S.BLOCK - 300 : S.BLOCK + 300])
    docs = [(1, (bytes(body) + b"0" + passage + b"1").decode()), (2, (b"2" + passage).decode())]
    got = result(S.suffix_dedup(frame(spark, docs)))
    assert got[1] == digest(docs[0][1].encode(), np.r_[np.zeros(len(body) + 1, bool), np.ones(600, bool), [False]])
    assert got[2] == digest(docs[1][1].encode(), np.r_[[False], np.ones(600, bool)])


def test_repeated_rows_and_rewriting(spark):
    r = random.Random(1)
    a, b = "".join(r.choice("abcdefgh é") for _ in range(400)), "tail"
    docs = [(1, a), (1, a), (2, b + a), (3, "")]
    got = S.suffix_dedup(frame(spark, docs), digest=False).collect()
    texts = sorted((r.doc_id, r.text) for r in got)
    assert texts == [(1, a), (1, a), (2, "tail"), (3, "")]
    assert S.suffix_dedup(frame(spark, docs).limit(0)).count() == 0


def test_chunk_dedup(spark):
    docs = corpus(80, 3)
    assert result(C.chunk_dedup(frame(spark, docs))) == brute_chunks(docs)
    assert C.chunk_dedup(frame(spark, docs).limit(0)).count() == 0


def test_clashing_names(spark):
    docs = [(i, t) for i, t in corpus(20, 4)]
    df = spark.createDataFrame([(k, t, f"k{k}", "h", [1], "s") for k, t in docs], "doc_id long, text string, k string, h string, span_starts array<int>, c0 string")
    for run in (S.suffix_dedup, C.chunk_dedup):
        got = run(df, digest=False)
        assert got.columns == df.columns
        assert all((r.k, r.h, r.span_starts, r.c0) == (f"k{r.doc_id}", "h", [1], "s") for r in got.collect())


def test_null_key(spark):
    t = "".join(random.Random(6).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(None, t), (4, t), (4, t)], "doc_id long, text string")
    for run, most in ((S.suffix_dedup, 300), (C.chunk_dedup, 300)):
        got = sorted(((r.doc_id, r.n_removed) for r in run(df).collect()), key=str)
        assert got == [(4, most), (4, most), (None, 0)]


def test_insertions_leave_other_chunks(spark):
    r = random.Random(2)
    t = "".join(r.choice("abcdefghij klmnop") for _ in range(4000))
    docs = [(1, t), (2, "inserted at the front " + t[:2000] + " and in the middle " + t[2000:])]
    assert result(C.chunk_dedup(frame(spark, docs)))[2][1] > 3300
