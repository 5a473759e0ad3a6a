import itertools
import random
import re

import pytest

from tessera.llm import shingle_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(docs):
    sets, up = {k: shingles(t) for k, t in docs}, {k: k for k, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations([k for k in sorted(sets) if sets[k]], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def scattered():
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(r.randint(3, 80))] for _ in range(12)]
    common, docs = [r.choice(vocab) for _ in range(12)], []
    for i in range(300):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            b[r.randrange(len(b))] = r.choice(vocab)
        b = common + b if r.random() < 0.3 else b
        t = " ".join(b[: r.randint(0, 6)] if i % 31 == 0 else b)
        docs.append((i * 2 + 1, None if i % 41 == 0 else t.upper() if i % 37 == 0 else t))
    return docs


def near_copies(n, groups):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    base, docs = [[r.choice(vocab) for _ in range(60)] for _ in range(groups)], []
    for i in range(n):
        b = list(base[i % groups])
        for _ in range(r.randint(0, 5)):
            b[r.randrange(60)] = r.choice([*vocab, f"q{r.randrange(10**6)}"])
        docs.append((i + 1, " ".join(b)))
    return docs


CASES = {"scattered": scattered(), "near copies": near_copies(360, 3), "one large group": near_copies(1300, 1)}


@pytest.mark.parametrize(("docs", "frequent"), [("scattered", J.FREQUENT), ("scattered", 0.02), ("near copies", J.FREQUENT), ("near copies", 1.0), ("one large group", J.FREQUENT)])
def test_against_brute_force(spark, docs, frequent):
    docs = CASES[docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = J.shingle_components(df, frequent=frequent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


@pytest.mark.parametrize("percent", [50, 67, 80, 95])
def test_prefix_keys_lose_no_pair(percent):
    import numpy as np

    r = random.Random(3)
    for _ in range(600):
        n = r.randint(2, 60)
        x = set(r.sample(range(200), n))
        y = set(x)
        for _ in range(r.randint(0, n * (100 - percent) // 100)):
            y.discard(r.choice(sorted(y)))
            y.add(r.randrange(200, 260))
        both = len(x & y)
        if 100 * both < percent * len(x | y) or x == y:
            continue
        df = {t: r.randint(2, 30) for t in x | y}
        for frequent in (1000, 20, 10, 0):
            keys = [J.prefix_keys(np.array(sorted(s), np.uint64) << np.uint64(1), np.array([df[t] for t in sorted(s)]), len(s), percent, frequent).tolist() for s in (x, y)]
            assert set(keys[0]) & set(keys[1])
            assert all(len(k) <= len(s) for k, s in zip(keys, (x, y), strict=True))


def test_edge_rows(spark):
    rows = [(5, "a b c", 1), (5, "a b c", 1), (2, "A B c", 2), (None, "x y z", 3), (9, None, 4), (8, " \t", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in J.shingle_components(df).collect()), key=str)
    assert got == sorted([(5, 1, 2), (5, 1, 2), (2, 1, 2), (0, 1, None), (9, 0, 9), (8, 0, 8)], key=str)
    assert J.shingle_components(df.limit(0)).count() == 0


def test_long_text(spark):
    """A text of several slices' size, a near copy of it, and one that ends with it."""
    r = random.Random(5)
    words = [f"{r.randrange(10**6):060d}" for _ in range(40_000)]
    near = list(words)
    for i in range(0, 40_000, 400):
        near[i] = "x"
    docs = [(3, " ".join(words)), (2, " ".join(near)), (1, " ".join([f"y{i}" for i in range(12_000)] + words))]
    assert len(docs[0][1]) > 2 * J.PART
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.shingle_components(df).collect()}
    assert got == {k: (len(shingles(t)), 1 if k == 1 else 2) for k, t in docs}


def test_keys_grow_with_the_prefix():
    import numpy as np

    h, df = np.arange(1, 301, dtype=np.uint64) << np.uint64(20), np.full(300, 2000)
    assert len(J.prefix_keys(h, df, 300, 80, 1000)) == 121
    assert len(J.prefix_keys(h, df, 300, 80, 3000)) == 61
