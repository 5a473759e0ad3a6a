"""The nearest texts by trigrams: brute force agrees, and no plan node makes a row of each pair."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import ngrams
from tessera.plans import texts


def brute(rows, k):
    """{(query, rank): score}"""
    docs = {}
    for block, id_, base, text in rows:
        if block is not None and len(text) >= 3:
            docs.setdefault((block, id_, base), Counter()).update(text[i : i + 3] for i in range(len(text) - 2))
    out = {}
    for block in {b for b, _, _ in docs}:
        mine = {x: t for x, t in docs.items() if x[0] == block}
        df, n = Counter(g for t in mine.values() for g in t), len({x[1] for x in mine})
        v = {}
        for x, t in mine.items():
            w = {g: c * math.log(1 + n / df[g]) for g, c in t.items()}
            size = math.sqrt(sum(y * y for y in w.values()))
            v[x] = {g: y / size for g, y in w.items()}
        for x in (x for x in v if not x[2]):
            scores = sorted((sum(w * v[y].get(g, 0.0) for g, w in v[x].items()) for y in v if y[2] and v[x].keys() & v[y].keys()), reverse=True)
            out |= {(x[1], i + 1): s for i, s in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("share", [0.035, 1e-9, 2.0], ids=["both ways", "columns only", "lists only"])
def test_nearest(spark, share, monkeypatch):
    r = np.random.default_rng(3)
    words = ["blau", "grün", "the", "ring", "stahl", "😀x", "ö", "zz"]
    text = lambda: " ".join(r.choice(words, r.integers(1, 5)))
    rows = [(str(i % 2), i, i % 3 == 0, text()) for i in range(150)] + [(str(i % 2), 200 + i, i % 2 == 0, "copied text") for i in range(30)]
    rows += [("0", 300, False, "qqq"), ("0", 301, False, "q"), (None, 302, False, "ring"), (None, 303, True, "ring"), ("1", 304, True, "stahl ring"), ("1", 304, True, "und mehr")]
    want = brute(rows, 3)
    out = ngrams.nearest(spark.createDataFrame(rows, "block string, id long, base boolean, text string"), 3)
    assert {(x.rid, x["rank"]): x.score for x in out.collect()} == pytest.approx(want)
    # the tasks' own code, with other shares
    monkeypatch.setattr(ngrams, "SHARE", share)
    monkeypatch.setattr(ngrams, "AT_ONCE", 7)
    own = [x for x in rows if x[0] == "0" and len(x[3]) >= 3]
    lists = lambda some: pa.array([[x[3]] for x in some], pa.list_(pa.string()))
    row, term = ngrams.trigrams(lists(own))
    once = np.unique(np.stack([term, row]), axis=1)[0]
    terms, df = np.unique(once, return_counts=True)
    queries, base = [x for x in own if not x[2]], [x for x in own if x[2]]
    state = ngrams._Nearest(terms, np.log(1 + len(own) / df), pa.table({"key": [str(x[1]) for x in queries], "texts": lists(queries)}), 3)
    state.add(pa.table({"texts": lists(base), "n": np.ones(len(base), np.int64)}))
    got = {(int(i), r): s for x in state.rows() for i, r, s in zip(*x.to_pydict().values(), strict=True)}
    assert got == pytest.approx({x: s for x, s in want.items() if x[0] in {y[1] for y in queries}})


def test_tfidf_knn_of_copies_makes_no_pairs(spark, tmp_path):
    rows = [(i, "blue ring of steel", "en", "src1" if i % 2 else "src9", 18) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = texts.tfidf_knn(spark, str(tmp_path))
    assert {tuple(x) for x in out.collect()} == {(i, k, 1.0) for i in range(0, 400, 2) for k in (1, 2, 3)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "w2" not in plan
