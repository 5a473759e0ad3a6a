"""The scan's kernels look at scores in single precision, and settle by sums in order what that could change."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import knn


def side(r, n, first, size=64, near=None):
    v = r.standard_normal((n, size))
    if near is not None:
        v = near + 1e-9 * v  # single precision can't tell these apart
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return pa.table({"id": np.arange(first, first + n), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})


def totals(q, b):
    x, y = (np.array(t["v"].to_pylist()) for t in (q, b))
    s = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        s += x[:, d, None] * y[None, :, d]
    s[q["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = -np.inf
    return s


@pytest.fixture(scope="module")
def sides():
    r = np.random.default_rng(9)
    one = r.standard_normal(64)
    return pa.concat_tables([side(r, 60, 0), side(r, 20, 60, near=one)]), pa.concat_tables([side(r, 900, 40), side(r, 300, 2000, near=one)])


def test_scores_are_single_and_as_near_as_said(sides):
    q, b = sides
    want = totals(q, b)
    for lo, _, s, near, exact in knn._Held(q).scores(b):
        assert s.dtype == np.float32 and 0 < near < 1e-5
        own = want[lo : lo + len(s)]
        some = own > -np.inf
        assert (np.abs(s[some] - own[some]) <= near).all() and (s[~some] == -np.inf).all()
        assert (exact(np.array([0, 1]), np.array([5, 6])) == own[[0, 1], [5, 6]]).all()


def best_of(q, b, k):
    x = knn._Best(q, k)
    for lo in range(0, b.num_rows, 500):
        x.add(b.slice(lo, 500))
    ids, s = b["id"].to_numpy(), totals(q, b)
    for i in range(q.num_rows):
        order = np.lexsort((ids, -s[i]))[:k]
        assert x.sid[x.row == i].tolist() == ids[order].tolist() and (x.score[x.row == i] == s[i][order]).all()


def looked_at(monkeypatch, q, b, k):
    """Scores summed in order, of all."""
    n, real = [], knn._at_least_best
    monkeypatch.setattr(knn, "_at_least_best", lambda *a: n.append(len((out := real(*a))[0])) or out)
    knn._Best(q, k).add(b)
    return sum(n) / (q.num_rows * b.num_rows)


def test_best_five_for_knn_exact(sides, monkeypatch):
    best_of(*sides, 5)
    q, b = (t.slice(0, n) for t, n in zip(sides, (60, 900), strict=True))
    assert looked_at(monkeypatch, q, b, 5) < 0.02


def test_vectors_that_single_precision_cannot_hold():
    q, b = (pa.table({"id": [lo, lo + 1], "v": pa.array([[1e200, 1.0], [-1e200, 2.0]], pa.list_(pa.float64()))}) for lo in (0, 10))
    x = knn._Best(q, 1)
    x.add(pa.table({"id": b["id"], "v": pa.array([[1e100, 1.0], [-1e100, 2.0]], pa.list_(pa.float64()))}))
    assert x.sid.tolist() == [10, 11]


def test_unit_sums_a_norm_once(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<float>").select("id", knn.unit("v").alias("u"))
    assert [r.u for r in df.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_counts_for_shift_table(sides):
    q, b = sides
    want = totals(q, b)
    levels = [0.1, 0.3, float(want[70, 1000]), float(want[71, 1001])]  # the last two are reached by no more than a rounding
    x = knn._AtLeast(q, levels)
    x.add(b)
    assert (x.n == np.stack([(want >= t).sum(axis=1) for t in levels], axis=1)).all()
    assert [s.dtype for _, _, s, _, _ in x.held.scores(b)] == [np.float32]


def test_best_of_both_sides_for_mutual_best(sides, monkeypatch):
    best_of(*sides, 2)
    best_of(*sides[::-1], 1)
    assert looked_at(monkeypatch, *(t.slice(0, n) for t, n in zip(sides, (60, 900), strict=True)), 2) < 0.01


def test_best_twenty_for_recall_at_k(sides, monkeypatch):
    best_of(*sides, 20)
    assert looked_at(monkeypatch, *(t.slice(0, n) for t, n in zip(sides, (60, 900), strict=True)), 20) < 0.06


def test_best_ten_for_vector_shortlist(sides, monkeypatch):
    best_of(*sides, 10)
    assert looked_at(monkeypatch, *(t.slice(0, n) for t, n in zip(sides, (60, 900), strict=True)), 10) < 0.03


def test_best_two_of_many_batches_for_true_vs_best_other(sides):
    q, b = sides
    x, ids, s = knn._Best(q, 2), b["id"].to_numpy(), totals(q, b)
    for lo in range(0, b.num_rows, 7):
        x.add(b.slice(lo, 7))
    assert x.held.single.dtype == np.float32
    for i in range(q.num_rows):
        assert x.sid[x.row == i].tolist() == ids[np.lexsort((ids, -s[i]))[:2]].tolist()


def test_best_score_for_score_quantiles(sides):
    q, b = sides
    x = knn._Best(q, 1)
    x.add(b)
    assert x.score.dtype == np.float64 and x.held.single.dtype == np.float32
    assert (x.score == totals(q, b).max(axis=1)).all()


def test_best_row_for_imitated_entity(sides, monkeypatch):
    best_of(*sides, 1)
    assert looked_at(monkeypatch, *(t.slice(0, n) for t, n in zip(sides, (60, 900), strict=True)), 1) < 0.005
