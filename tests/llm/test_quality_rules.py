import random
import re

import pytest

from tessera.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, min_repeat, max_covered, max_longest):
    t = text or ""
    w = WORD.findall(t)
    n = len(w)
    windows = [tuple(w[i : i + 3]) for i in range(n - 2)]
    again = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    covered, longest = set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= min_repeat:
                longest = max(longest, k)
                covered |= set(range(i, i + k)) | set(range(j, j + k))
    failed = n < 50 or 100 * len(again) > 50 * n
    kept = not failed and len(covered) <= max_covered * n and longest <= max_longest
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed, kept, len(covered), longest


def texts():
    r = random.Random(4)
    out = [None, "", "   \n\t", "one", "é" * 10, "\x0b\x0cx\x1cy\x85z", "a b c\na b c\n\na b c", "# $ | <x>\n" * 3]
    for _ in range(40):
        base = [r.choice(["red", "Ox", "né", "d|", "e" * 9]) + str(r.randrange(12)) for _ in range(r.randint(0, 70))]
        cut = r.randint(0, len(base))
        out.append(" ".join(base + base[cut : cut + r.randint(0, 25)]) + r.choice(["", "\n", "\nlast line\nlast line"]))
    return out + ["word " * 400]


def test_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = Q.quality_rules(df, min_repeat=4, max_covered=0.3, max_longest=12)
    names = [f.name for f in Q.FIELDS]
    assert got.columns.count("kept") == 1
    found = [(r.doc_id, tuple(r[n] for n in names)) for r in got.collect()]
    assert len(found) == len(rows)
    for i, x in found:
        assert x == brute(rows[i][1], 4, 0.3, 12), repr(rows[i][1])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality_rules(df).count() == 0


@pytest.mark.parametrize("n", [3, 5, 40])
def test_long_repeat_is_found(n):
    w = [f"w{i}" for i in range(200)]
    m = Q.measure([" ".join(w + w[:n]).encode()], 3)
    assert (m["longest_repeat"][0], m["covered_words"][0]) == (n, 2 * n)


def test_production_limits(spark):
    """A text that gives a passage of over 50 words twice goes, as does one mostly of short repeats; prose and a repeated phrase stay."""
    r = random.Random(6)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, phrases = prose(60), [prose(12) for _ in range(8)]
    planted = [prose(240) + passage + prose(240) + passage, [w for p in phrases * 2 for w in p] + prose(300)]
    clean = [prose(600), prose(290) + passage[:20] + prose(290) + passage[:20], prose(60)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(planted + clean)], "doc_id long, text string")
    got = {x.doc_id: (x.base_failed, x.kept) for x in Q.quality_rules(df).collect()}
    assert got == {i: (False, i >= len(planted)) for i in range(len(planted + clean))}
