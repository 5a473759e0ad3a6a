import hashlib
import math
import random

import pytest
import xxhash

from tessera.llm import fingerprints as I


def corpus():
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(i * 7 % 101, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(101)]
    rows[5] = (rows[5][0], None)
    rows[6] = (rows[6][0], "")
    return [*rows, (500, rows[10][1]), (500, rows[10][1])]


def test_edited_texts(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for size in (1, 64 << 20):
        monkeypatch.setattr(I, "input_bytes", lambda _, s=size: s)
        got = I.edited_fingerprints(df).collect()
        assert len(got) == len(rows)
        order = sorted(((k, t or "") for k, t in rows))
        for i, (k, t) in enumerate(order):
            nxt = order[(i + 1) % len(order)][1]
            half = len(t) // 2
            e = hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
            assert any(g.doc_id == k and g.n_chars == len(t) and g.edited_sha256 == e for g in got)
        by = {}
        for g in got:
            assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
            by.setdefault(dict(rows)[g.doc_id] or "", set()).add(g.fingerprint)
        assert all(len(v) == 1 for v in by.values())
        assert sum(g.near_edited for g in got) > sum(g.near_next for g in got)


def test_likeness():
    f = I.Fingerprinter({b"a", b"b", b"c"}, I.shares(48, 0.5, 0.1))
    x, y = f(b"a b c zz"), f(b"C b A b")
    assert x == y and I.likeness(x, y) == 1.0
    assert I.likeness(f(b""), f(b"")) == 1.0
    assert I.likeness(f(b"a"), f(b"b")) == 0.0
    assert f(b"unknown") != f(b"other")


def test_large_ids(spark, monkeypatch):
    monkeypatch.setattr(I, "input_bytes", lambda _: 64 << 20)
    big = 1 << 62
    rows = [(big + i, f"text number {i} of many") for i in range(40)]
    got = {r.doc_id: r.edited_sha256 for r in I.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, (k, t) in enumerate(rows):
        half = len(t) // 2
        assert got[k] == hashlib.sha256((t[: len(t) - half] + rows[(i + 1) % 40][1][:half]).encode()).hexdigest()


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert I.edited_fingerprints(df).count() == 0
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    r = I.edited_fingerprints(one).first()
    assert (r.edited_sha256, r.n_chars) == (hashlib.sha256(b"a b a b").hexdigest(), 7)
    assert I.fingerprints(one).first().fingerprint == r.fingerprint


def brute(docs, low, high, limits):
    """Fingerprints by the rule: band of idf, sorted distinct terms, one hash for each subset that a term's own draw puts it in."""
    texts = [(t or "").encode().lower().split() for _, t in docs]
    df = {}
    for ws in texts:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    n = len(docs)
    band = {w for w, c in df.items() if c >= 2 and low <= math.log(n / c) <= high}

    def one(text):
        words = sorted(set(text.encode().lower().split()))
        own = [w for w in words if w in band] or words
        out = []
        for j, share in enumerate(limits):
            chosen = [w for w in own if int.from_bytes(hashlib.shake_128(b"subset:" + w).digest(2 * len(limits))[2 * j : 2 * j + 2], "little") < int(share * 65536)]
            raw = b"".join(xxhash.xxh3_64_intdigest(w).to_bytes(8, "little") for w in chosen)
            out.append(f"{xxhash.xxh3_64_intdigest(raw) >> 32:08x}" if chosen else "0" * 8)
        return out

    return one


def alike(x, y):
    used = [(a, b) for a, b in zip(x, y, strict=True) if (a, b) != ("0" * 8, "0" * 8)]
    return sum(a == b for a, b in used) / len(used) if used else 1.0


@pytest.mark.parametrize("most", [I.MOST_TERMS, 3])
def test_against_brute_force(spark, monkeypatch, most):
    """Fingerprints, those of edited texts, and likeness, by plain Python; with a lexicon in memory and one beyond the limit."""
    monkeypatch.setattr(I, "MOST_TERMS", most)
    rows = sorted({k: t for k, t in corpus()}.items())
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fingerprint string, k int").repartition(4)
    one = brute(rows, I.LOW_IDF, I.HIGH_IDF, I.shares(I.SUBSETS, I.LARGEST, I.SMALLEST))
    got = {r.doc_id: r for r in I.edited_fingerprints(df).collect()}
    plain = {r.doc_id: r.fingerprint for r in I.fingerprints(df).collect()}
    assert len(got) == len(plain) == len(rows)
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        f, e, g = one(t), one(t[: len(t) - half] + nxt[:half]), one(nxt)
        assert got[k].fingerprint == plain[k] == "-".join(f) and got[k].edited_fingerprint == "-".join(e)
        assert (got[k].near_edited, got[k].near_next) == (pytest.approx(alike(f, e)), pytest.approx(alike(f, g)))


def test_null_keys_and_long_text(spark):
    long = "word other " * 500_000
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, long), (2, None)], "doc_id long, text string")
    got = I.edited_fingerprints(df).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 5), (0, 5), (2, 0), (3, len(long))]
