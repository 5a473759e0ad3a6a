"""``pair_metrics`` against its SQL where values end in a 5 or names have no words; Jaro-Winkler against its definition."""

import random

import pytest

from tessera.functions import metrics as M

duckdb = pytest.importorskip("duckdb")


def test_values_between_two_roundings(spark, tmp_path):
    import __spark_entry__ as e

    words = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("a" * n for n in range(1, 60))]
    long = "o" * 15
    names = [
        ("src0", words[:41]), ("src5", words[:640]),  # 41 of 640 words
        ("src1", [long]), ("src6", [long, "x" * 112]),  # 15 of 128 letters
        ("src2", ["12", "34"]), ("src7", ["12", "56"]),  # no words at all
        ("src3", ["12", "acme"]), ("src8", ["12"]),
    ]
    rows = [(i, " ".join(w), "en", s, 1) for i, (s, w) in enumerate(names)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(e.oracle_sql()["pair_metrics"]).fetchall()
    assert len(want) == 4
    assert sorted(map(tuple, e.queries()["pair_metrics"](spark, str(tmp_path)).collect())) == sorted(want)


def _jaro(a, b):
    """Each letter of ``a`` with the first free equal one of ``b`` within reach."""
    reach, used, left = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == ch), None)
        if j is not None:
            used.add(j)
            left.append(ch)
    m = len(left)
    swaps = sum(x != b[j] for x, j in zip(left, sorted(used), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3 if m else 0.0


def test_jaro_by_places_of_letters():
    r = random.Random(5)
    for _ in range(3000):
        letters = "abcdefgh"[: r.randint(1, 8)]
        a, b = ("".join(r.choices(letters, k=r.randint(1, r.choice([4, 12, 80])))) for _ in range(2))
        assert M.jaro_winkler(a, b, 0) == _jaro(a, b)
        assert M.jaro_winkler(a, b) >= M.jaro_winkler(a, b, 0)


def test_long_texts_take_time_of_their_length():
    assert M.jaro_winkler("ab" * 200_000, "ba" * 200_000) == pytest.approx(5 / 6)  # every letter is swapped
