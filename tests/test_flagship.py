"""The flagship on copies: each record gets the smallest id, and a name is compared once."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking
from tessera.plans import flagship


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, "blue ring of steel", "en", "src1" if i % 2 else "src9", 18) for i in range(40)] + [(90, "steel of ring blue", "en", "src12", 18), (91, "", "en", "src12", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture
def compared(monkeypatch):
    sizes, real = [], blocking.similar_words
    monkeypatch.setattr(blocking, "similar_words", lambda a, b, *x, **y: sizes.append((a.count(), b.count())) or real(a, b, *x, **y))
    return sizes


def test_resolve_of_copies(spark, folder, compared):
    got = {(r.rid, r.sid, r.p) for r in flagship.flagship_resolve(spark, folder).collect()}
    assert got == {(i, 1, 1.0) for i in [*range(0, 40, 2), 90]}
    assert compared == [(1, 1)]


def test_f05_of_copies(spark, folder, compared):
    r = flagship.flagship_f05(spark, folder).first()
    # of 20 entities the first has 21 links, 20 of them true; the others have none and want none
    p, t = 20 / 21, 1.0
    assert (r.n, r.macro_f) == (20, pytest.approx((19 + 1.25 * p * t / (0.25 * p + t)) / 20, abs=2e-6))
    assert compared == [(1, 1)]


def test_f05_reads_the_texts_once(spark, folder):
    text = flagship.flagship_f05(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "tessera-flagship" in text and "documents.parquet" not in text


def test_signatures_drop_only_pairs_that_differ_too_much(spark):
    r = random.Random(2)
    often, rare = [f"o{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    sets = [r.sample(often, 12) + r.sample(rare, 14) for _ in range(60)]
    sets += [x[: -r.randrange(1, 9)] + r.sample(rare[:20], 2) for x in sets[:20]]
    sets = [[*dict.fromkeys(x)] for x in sets]
    df = blocking.signed(spark.createDataFrame([*enumerate(sets)], "id long, w array<string>"), "w", "bits").select("id", "bits")
    x = df.crossJoin(df.toDF("other", "its")).select("id", "other", blocking.at_least_apart(F.col("bits"), F.col("its")).alias("n"))
    kept, like = 0, 0
    for t in x.filter("id < other").collect():
        u, v = {*sets[t.id]}, {*sets[t.other]}
        assert t.n <= len(u ^ v)
        kept += t.n <= (len(u) + len(v)) / 3
        like += len(u & v) >= len(u | v) / 2
    assert 20 <= like <= kept <= 2 * like  # of 3160 pairs, most of which share words
