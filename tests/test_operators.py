import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, blocking, components, decide, evaluation, features, joins, knn, lexicon, pairs, rules, windows
from tessera.plans import vectors
from tessera.plans.resolve import Config, resolve


def macro(spark, entities, claims):
    e = spark.createDataFrame([(x,) for x in entities], "sid string")
    c = spark.createDataFrame(claims, "sid string, acc boolean, tru boolean")
    return evaluation.macro_f(evaluation.entity_counts(e, c)).first()["macro_f"]


def test_macro_f(spark):
    assert macro(spark, ["a"], [("a", True, True), ("a", True, True), ("a", True, False)]) == pytest.approx(0.714285, abs=1e-4)
    assert macro(spark, ["b"], [("z", True, True)]) == 1.0
    assert macro(spark, ["b"], [("b", True, False)]) == 0.0
    assert macro(spark, ["a", "b", "c"], [("a", False, True), ("a", False, True), ("c", False, True)]) == pytest.approx(1 / 3)


def test_auc_with_ties(spark):
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.8, True)]
    assert evaluation.auc(spark.createDataFrame(rows, "p double, y boolean"), "p", "y").first()["auc"] == pytest.approx(0.875)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 3), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert got == {2: 1, 3: 1, 20: 1, 8: 7, 9: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components.components(chain).collect()} == {0}
    assert components.components(e.limit(0)).count() == 0


def test_expected_f():
    assert decide.best_k([0.99, 0.5]) == 1
    assert decide.best_k([0.6]) == 1
    assert decide.best_k([0.2]) == 0
    assert decide.best_k([0.99, 0.98, 0.97, 0.7]) in (3, 4)
    assert decide.expected_f([1.0, 0.0], 1) == pytest.approx(1.0)
    r = random.Random(2)
    for n in (0, 1, 3, 9, 26, 40):
        q, missed = sorted((r.random() ** 2 for _ in range(n)), reverse=True), r.choice([0.0, 0.7])
        values = [round(decide.expected_f(q, k, missed), 12) for k in range(n + 1)]
        assert decide.best_k(q, missed) == values.index(max(values))
    assert decide.best_k([0.95] * 300 + [0.01] * 700) == 300


def test_expected_f_takes_every_candidate(spark):
    rows = [(1, i, 0.97) for i in range(60)] + [(2, 100, 0.3), (2, 101, 0.2)]
    got = decide.select_expected_f(spark.createDataFrame(rows, "sid int, rid int, p double")).groupBy("sid").count().collect()
    assert {r.sid: r["count"] for r in got} == {1: 60}


def test_assign_breaks_ties_by_entity(spark):
    p = spark.createDataFrame([(1, 7, 0.9), (1, 3, 0.9), (2, 5, 0.4), (3, 1, 0.8)], "rid long, sid long, p double")
    want = {(1, 3, 0.9), (3, 1, 0.8)}
    assert {tuple(r) for r in decide.assign(p, 0.5).select("rid", "sid", "p").collect()} == want
    assert {tuple(r) for r in decide.assign_by_rank(p, 0.5).select("rid", "sid", "p").collect()} == want


def test_veto_treats_missing_as_disagreement(spark):
    a = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.9), (3, 3, 0.9)], "rid long, sid long, q double")
    b = spark.createDataFrame([(1, 1, 0.5), (2, 9, 0.9)], "rid long, sid long, q double")
    assert {r.rid: r.q for r in decide.veto(a, b).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def test_restore_empty_keeps_unjudged(spark):
    rows = [("a", "r1", 0.5, None, True), ("b", "r2", 0.5, -1.0, True), ("c", "r3", 0.5, -1.0, False), ("d", "r4", 0.9, None, False), ("d", "r5", 0.5, None, False)]
    d = spark.createDataFrame(rows, "sid string, rid string, q double, llm double, u boolean")
    assert {r.rid for r in rules.restore_empty(d, 0.7, 0.4, F.col("u")).collect()} == {"r1", "r3"}


def test_positions(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 5, 1), ("a", 5, 1), ("a", 6, 1), ("a", -1, 1)], "sid string, kr long, ks long")
    assert sorted(r.pos for r in rules.positions(d).collect()) == ["D", "D", "NONE", "OTHER", "SAME"]


def test_structural_and_exact_place(spark):
    base = ("12", "12", -1, -1, ["grand", "place"], ["grande", "place"], ["acme", "tools"], ["acme", "tools"], "acme", ["acme", "tools"], ["acme", "tools", "x"])
    names = "house1 string, house2 string, second1 int, second2 int, street1 array<string>, words2 array<string>, name1 array<string>, name2 array<string>, rare1 string, full1 array<string>, full2 array<string>"
    d = spark.createDataFrame([base, ("", "", *base[2:]), ("12", "13", *base[2:])], names).withColumn("z", F.create_map(F.lit("y"), F.lit(0.0)))
    assert rules.structural(d).count() == 1
    cols = "n1 long, n2 long, here long, street1 array<string>, street2 array<string>, name1 array<string>, name2 array<string>, raw2 string, base boolean"
    st = ["rue", "longue"]
    rows = [(4, 4, 1, st, st, ["acme", "big", "tools"], ["abt"], "abt", False), (4, 4, 1, st, st, ["acme", "tools"], ["tools"], "tools", True), (4, 4, 1, st, st, ["acme", "tools"], ["other"], "acmetools.com", True), (4, 4, 2, st, st, ["acme"], ["a"], "a", True), (4, 4, 1, [], st, ["acme"], ["acme"], "acme", True)]
    assert rules.exact_place(spark.createDataFrame(rows, cols)).count() == 3


def test_near_number(spark):
    d = spark.createDataFrame([(1, 10, 20), (2, 11, 20)], "rid long, sid long, n1 long")
    c = spark.createDataFrame([(1, 9, 15), (2, 9, 1)], "rid long, sid long, n1 long")
    assert [r.rid for r in rules.near_number(d, c).collect()] == [1]


def test_range_semi(spark):
    a = spark.createDataFrame([(1, 1, 10), (2, 1, 23), (3, 2, 24), (4, 1, 40)], "id long, b long, k long")
    got = {r.id for r in joins.range_semi(a, a, "b", "k", 1, 13).collect()}
    assert got == {2}


def test_softmax_shortlist_keeps_best(spark):
    c = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(5)], "rid long, sid long, score double")
    assert 0 in {r.sid for r in windows.shortlist(c, "softmax:0.05:0.5").collect()}
    assert windows.shortlist(c, "gap:0.2").count() == 3


def test_knn_forms_agree(spark):
    import random

    r = random.Random(1)
    rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, block long, v array<double>").withColumn("v", knn.unit(F.col("v")))
    q, b = v.withColumnRenamed("id", "rid"), v.withColumnRenamed("id", "sid")
    x = {(t.rid, t.rank): t.sid for t in knn.exact(q, b, 3).collect()}
    y = {(t.rid, t.rank): t.sid for t in knn.blocked(q, b, 3, chunk=5).collect()}
    assert x == y and len(x) == 180


@pytest.mark.parametrize("name", ["knn_inverted_lists", "knn_hashed"])
def test_knn_recall(spark, name):
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    want = {(t.rid, t.sid) for t in knn.exact(*vectors.sides(spark, d), 5).collect()}
    got = vectors.__dict__[name](spark, d).collect()
    assert len({(t.rid, t.sid) for t in got}) == len(got) == len(want)
    assert {(t.rid, t.rank) for t in got} == {(rid, i) for rid in {r for r, _ in want} for i in range(5)}
    assert len({(t.rid, t.sid) for t in got} & want) >= 0.9 * len(want)


@pytest.mark.parametrize("near", [lambda *a: knn.inverted_lists(*a, probes=1, cells=4), knn.hashed])
def test_knn_of_few_and_null(spark, near):
    r = random.Random(3)
    rows = [(f"r{i}", i % 7 if i < 33 else None, [r.gauss(0, 1) for _ in range(8)] if i % 6 else None) for i in range(35)]
    v = spark.createDataFrame(rows, "id string, block long, v array<double>").withColumn("v", knn.unit(F.col("v")))
    q, b = v.withColumnRenamed("id", "rid"), v.withColumnRenamed("id", "sid")
    got, want = ({(t.rid, t.rank): t.sid for t in x.collect()} for x in (near(q, b, 6), knn.exact(q, b, 6)))
    assert got == want and len(got) > 33


def test_blocking_pairs(spark):
    a = spark.createDataFrame([(1, "x", ["red", "ox"]), (2, "x", ["blue"])], "sid long, block string, w array<string>")
    b = spark.createDataFrame([(7, "x", ["red"]), (8, "y", ["red"])], "rid long, block string, w array<string>")
    assert [tuple(r) for r in blocking.pairs(a, b, F.col("w"), "block").collect()] == [(1, 7)]
    assert blocking.pairs(a, b, F.col("w"), "block", most=0).count() == 0


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([("S1-1",), ("é",)], "e string")
    assert [r[0] for r in df.select(pairs.fold(F.col("e"))).collect()] == [zlib.crc32(x.encode()) % 10 for x in ("S1-1", "é")]


def test_lexicon(spark):
    p = [("US", ["acme", "private", "limited"], ["acme", "pvt", "ltd"])] * 40 + [("US", ["tamil", "nadu", "mill", "limited"], ["tn", "mill"])] * 40
    pairs_ = spark.createDataFrame(p, "country string, a array<string>, b array<string>")
    abbr = {(r.token, r.expansion) for r in lexicon.abbreviations(pairs_, "a", "b").collect()}
    assert ("pvt", "private") in abbr and ("tn", "tamil nadu") in abbr
    c = {r.w: (r.has, r.dropped) for r in lexicon.drop_counters(pairs_, "a", "b").collect()}
    assert c["limited"] == (80, 80)


def test_rate_table_total(spark):
    d = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "g string, f boolean")
    got = {r.g: (r.n, r.share) for r in aggregates.rate_table(d, ["g"], {"share": "f"}).collect()}
    assert got["ALL"][0] == 3 and got["a"] == (2, 0.5)


def test_resolve(spark):
    cols = "entity_id string, business_name string, business_address string, country string"
    e = spark.createDataFrame([("S1-1", "Acme Tools Ltd", "12 Main Street, TX 12345", "US"), ("S1-2", "Blue Ocean Foods", "7 Sea Road", "US"), ("S1-3", "Acme Tools Ltd", "1 Rue X", "FR")], cols)
    r = spark.createDataFrame([("S2-1", "ACME tools", "12 Main St TX 12345", "US"), ("S3-1", "blue ocean foods inc", "", "US"), ("S3-2", "Unrelated Name", "9 Hill", "US")], cols)
    links, pairs_ = resolve(e, r, Config())
    assert {(x.rid, x.sid) for x in links.collect()} == {("S2-1", "S1-1"), ("S3-1", "S1-2")}
    assert links.join(pairs_, ["rid", "sid"], "left_anti").count() == 0


def test_restoring_rules(spark):
    st = ["rue", "longue"]
    cols = "rid string, sid string, name1 array<string>, name2 array<string>, raw2 string, n1 long, n2 long, here long, street1 array<string>, street2 array<string>, mq double"
    at = (4, 4, 1, st, st)
    rows = [("a", "s", ["acme", "tools"], ["zorblatt"], "zorblatt", *at, 0.9), ("b", "s", ["acme", "tools"], ["acmetools"], "acmetools", *at, 0.9), ("c", "s", ["acme"], ["known", "of"], "known of", *at, 0.9), ("d", "t", ["acme"], ["quuxly", "group"], "quuxly group", *at, 0.05), ("e", "u", ["acme"], ["quuxly", "group"], "quuxly group", *at, 0.2), ("f", "u", ["acme"], ["quuxly"], "quuxly.com", *at, 0.9)]
    known = spark.createDataFrame([("known", 3), ("group", 500), ("acme", 2)], "w string, n long")
    assert {r.rid for r in rules.restore_alias(spark.createDataFrame(rows, cols), known).collect()} == {"a", "e"}
    c = spark.createDataFrame([("", "acme", "acme", 1, 0.5, 0.9), ("", "acme", "acme", 2, 0.5, 0.9), ("x", "acme", "acme", 1, 0.5, 0.9), ("", "acme", "acme", 1, None, 0.9)], "address2 string, cn1 string, cn2 string, n_core long, llm double, mq double")
    assert rules.restore_core_name(c).count() == 1
    v = c.withColumns({"name1": F.array(F.lit("acme")), "name2": F.array(F.lit("acmee"))})
    assert rules.restore_vetoed(v).count() == 3
    r = spark.createDataFrame([(["bad"], True), (["bad"], False), (["ok"], True)], "added array<string>, u boolean")
    assert rules.reject_decoy_words(r, ["bad"], F.col("u")).count() == 1
    k = spark.createDataFrame([("w", 100, 50, 0.05), ("x", 100, 50, 0.3), ("y", 100, 50, 0.15)], "w string, n long, n_other long, tv double")
    assert {x.w: x.kind for x in rules.word_classes(k).collect()} == {"w": "true", "x": "decoy", "y": "unclear"}


def test_negatives(spark):
    p = spark.createDataFrame([(i, "b", ["common", f"w{i // 2}"]) for i in range(10)], "id long, block string, w array<string>")
    got = {(r.id, r.other) for r in pairs.rarest_word_negatives(p, "w", 3).collect()}
    assert got == {(i, i ^ 1) for i in range(10)}
    assert all(r.id != r.other for r in pairs.random_negatives(p, 2, buckets=2).collect())
    assert pairs.owned_excluded(pairs.rarest_word_negatives(p, "w", 3), spark.createDataFrame([(0, 1)], "id long, other long")).count() == 9


def test_external_scores(spark):
    from tessera.operators import models

    d = spark.createDataFrame([(1, 1, 0.5), (2, 2, 0.99)], "rid long, sid long, q double")
    s = spark.createDataFrame([(1, 1, 2.0), (2, 2, 3.0)], "rid long, sid long, llm double")
    assert {r.rid: r.llm for r in models.with_external_score(d, s, ["rid", "sid"], "llm", 0.1, 0.9).collect()} == {1: 2.0, 2: None}


def test_edit_features(spark):
    p = spark.createDataFrame([(1, "US", ["acme", "tools"], ["acmee", "shop"]), (2, "US", ["a"], ["a"]), (3, "US", [], ["new"])], "id int, block string, a array<string>, b array<string>")
    stats = spark.createDataFrame([("US", "shop", 2.5, -3.0), ("US", "tools", 0.1, -4.0), ("UK", "new", 9.0, -1.0)], "block string, token string, susp double, df double")
    got = {r.id: r for r in features.edit_features(p, "id", "a", "b", stats, "block").collect()}
    assert (got[1].ed_add, got[1].ed_del, got[1].ed_add_susp, got[1].ed_add_df, got[1].ed_del_df) == (1, 1, 2.5, -3.0, -4.0)
    assert got[1].ed_swap_sim == pytest.approx(200 * 1 / 9)  # one letter in order is common to tools and shop
    assert (got[2].ed_add, got[2].ed_del, got[2].ed_swap_sim, got[2].ed_add_susp) == (0, 0, None, None)
    assert (got[3].ed_add, got[3].ed_add_susp, got[3].ed_add_df, got[3].ed_del_df) == (1, 0.0, pytest.approx(math.log(1e-6)), None)


def test_text_features(spark):
    c = spark.createDataFrame([(1, "a b", "a b", "x", "x", "q", "q"), (1, "a c", "a b", "x", "y", "q", "r")], "rid int, nn1 string, nn2 string, cn1 string, cn2 string, na1 string, na2 string")
    gaps = sorted(r.t_cn_gap for r in features.text_features(c).collect())
    assert gaps == [0.0, 100.0]


def test_small_rules(spark):
    d = spark.createDataFrame([(1, "", "acme", "acme", 1, 0.5), (2, "", "acme", "acme", 2, 0.5), (3, "x", "acme", "acme", 1, 0.5), (4, "", "acme", "other", 1, 0.5), (5, "", "acme", "acme", 1, None)], "rid int, address2 string, n1 string, n2 string, n int, llm double")
    assert [r.rid for r in rules.restore_unique_name(d, "n1", "n2", "n").collect()] == [1]
    one = spark.range(1).select(rules.distinctive_street(F.array(F.lit("rue"), F.lit("moulin")), F.array(F.lit("rue"))).alias("w")).first()
    assert one.w == ["moulin"]
    x = spark.createDataFrame([(True, True), (True, False), (False, True)], "a boolean, t boolean")
    r = evaluation.pooled(x, F.col("a"), F.col("t"), F.lit(4)).first()
    assert (r.precision, r.recall) == (0.5, 0.25)
    s = pairs.stratified(spark.range(100), F.col("id") < 30, 20, 0.8, "id")
    assert s.count() == 20 and s.filter("id < 30").count() == 16


def test_near_number(spark):
    d = spark.createDataFrame([(1, 10, 25), (2, 11, 40)], "rid int, sid int, n1 int")
    c = spark.createDataFrame([(1, 10, 25), (1, 12, 20), (2, 13, 10)], "rid int, sid int, n1 int")
    assert [r.rid for r in rules.near_number(d, c).collect()] == [1]


def test_heads_of_digests():
    import hashlib

    from tessera.functions.digests import Endings

    r = random.Random(3)
    texts = [str(r.randrange(10 ** r.randrange(1, 12))).encode() + b"|3" for _ in range(50)] + [b"", b"x" * 47, b"y" * 60]
    for starts in ([b""], [b"1|", b"2|"], [b"333|"], [b"4444|", b"5555|"], [b"6" * 16 + b"|"], [b"7" * 50]):
        want = [[int.from_bytes(hashlib.md5(s + t).digest()[:4], "big") for t in texts] for s in starts]
        assert Endings(texts).heads(starts).tolist() == want


def least(ids, k, ending=""):
    import hashlib

    digest = lambda i, o: hashlib.md5(f"{i}|{o}{ending}".encode()).hexdigest()
    return {(i, o) for i in ids for o in sorted((o for o in ids if o != i), key=lambda o: digest(i, o))[:k]}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rarest_word_negatives_of_a_frequent_word(spark):
    ids = [*range(300), *range(10**6, 10**6 + 300)]
    p = spark.createDataFrame([(i, "x", ["word"]) for i in ids] + [(None, "x", ["word"]), (5, None, ["word"])], "id long, block string, w array<string>")
    out = pairs.rarest_word_negatives(p, "w", 2)
    assert {(r.id, r.other) for r in out.collect()} == least(ids, 2)
    assert "MapInArrow" in plan(out)  # pairs stay where they are made


def test_random_negatives_of_a_large_block(spark):
    ids = [*range(300), *range(10**6, 10**6 + 300)]
    p = spark.createDataFrame([(i, "x") for i in ids] + [(None, "x")], "id long, block string")
    out = pairs.random_negatives(p, 2, buckets=1)
    assert {(r.id, r.other) for r in out.collect()} == least(ids, 2, "|3")
    assert "MapInArrow" in plan(out)


def test_negatives_in_order_of_residues(spark):
    r = random.Random(1)
    ids = [*r.sample(range(200), 60), *r.sample(range(10**9), 60)]
    rows = [(i, "x" if i % 2 else "y", r.choice("aaab")) for i in ids] + [(-5, "z", "a"), (7 * 10**12 + 1, "z", "b"), (-9, "z", "b"), (5, "z", None)]
    key = lambda a, c: int(math.fmod(a * 7919 + c * 104729, 10007))
    want = {(a, o[1]) for a, b, n in rows for o in sorted((key(a, c), c) for c, b2, m in rows if b2 == b and n and m and m != n)[:2]}
    out = pairs.negatives(spark.createDataFrame(rows, "id long, block string, name string"), 2)
    assert {tuple(t) for t in out.collect()} == want
    assert "FlatMapGroupsInPandas" in plan(out)


def test_similar_words_at_the_limit(spark):
    words = [f"w{i:02d}" for i in range(20)]
    a = spark.createDataFrame([(1, "x", words)], "sid long, block string, w array<string>")
    rows = [(2, "x", words[9:])] + [(10 + i, "x", words[9:]) for i in range(3)]
    got = blocking.similar_words(a, spark.createDataFrame(rows, "rid long, block string, w array<string>"), "w", "block", 0.55)
    assert {r.rid for r in got.collect()} == {2, 10, 11, 12}
    r = random.Random(4)
    sets = [(i, "x", r.sample(words, r.randrange(1, 12))) for i in range(80)]
    left, right = sets[:40], sets[40:]
    for least_ in (0.3, 0.5, 0.8):
        want = {(i, j) for i, _, u in left for j, _, v in right if len({*u} & {*v}) / len({*u} | {*v}) >= least_}
        x = blocking.similar_words(spark.createDataFrame(left, "sid long, block string, w array<string>"), spark.createDataFrame(right, "rid long, block string, w array<string>"), "w", "block", least_)
        assert {(t.sid, t.rid) for t in x.collect()} == want


def test_resolve_compares_alike_names_once(spark, monkeypatch):
    from tessera.plans import resolve as plan_

    sizes, real = [], blocking.shared_words
    monkeypatch.setattr(plan_.blocking, "shared_words", lambda a, b, *x, **y: sizes.append((a.count(), b.count())) or real(a, b, *x, **y))
    s1 = spark.createDataFrame([(i, "x", ["blue", "ring"] if i % 2 else ["ring"]) for i in range(30)], "sid long, block string, w array<string>")
    rec = spark.createDataFrame([(100 + i, "x", ["ring", "blue"]) for i in range(20)], "rid long, block string, w array<string>")
    got = {(r.rid, r["rank"]): (r.sid, r.score) for r in plan_.candidates(s1, rec, "w", Config(block="block", top=18)).collect()}
    want = [*[(i, 1.0) for i in range(1, 30, 2)], (0, 0.5), (2, 0.5), (4, 0.5)]
    assert got == {(100 + i, n): x for i in range(20) for n, x in enumerate(want)}
    assert sizes == [(2, 1)]
