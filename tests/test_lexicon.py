"""The lexicon's counters on long names: expansions of a pair in one pass, words of both sides met by hashing."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import lexicon


def test_expansions():
    x, y = ["acme", "pvt", "tn", "mill"], ["acme", "private", "tamil", "nadu", "mill", "tunnel"]
    assert Counter(lexicon.expansions(x, y)) == Counter([("pvt", None), ("pvt", "private"), ("tn", None), ("tn", "tamil nadu"), ("tn", "tunnel")])
    assert Counter(lexicon.expansions(["tn"] * 3, ["tamil", "nadu"] * 500)) == Counter([("tn", None), ("tn", "tamil nadu")])
    assert not list(lexicon.expansions(y, y)) and not list(lexicon.expansions([], y))


def test_drop_counters_look_words_up_by_hash(spark):
    df = spark.createDataFrame([("a", ["x", "y", "y"], ["y", "z"]), ("a", ["x"], ["x"]), ("a", [], ["z"])], "country string, a array<string>, b array<string>")
    out = lexicon.drop_counters(df, "a", "b")
    assert {r.w: (r.has, r.dropped, r.has_b, r.added) for r in out.collect()} == {"x": (2, 1, 1, 0), "y": (1, 0, 1, 0), "z": (0, 0, 2, 2)}
    assert "array_contains" not in out._jdf.queryExecution().executedPlan().toString()


def test_abbreviations_explode_no_words(spark):
    df = spark.createDataFrame([("US", ["tamil", "nadu"], ["tn"]), ("US", ["tn"], ["tamil", "nadu"]), (None, ["tn"], ["tamil", "nadu"])], "country string, a array<string>, b array<string>")
    out = lexicon.abbreviations(df, "a", "b", least=1).filter(F.col("country").isNotNull())
    assert [tuple(r) for r in out.collect()] == [("US", "tn", "tamil nadu")]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_replacements():
    found = Counter()
    for u, t, v in lexicon.replacements(["private", "limited", "gmbh"], ["pvt", "inc"]):
        found[u, t] += v
    # pvt replaces private only; inc has no related word, so it replaces all three
    assert found == {("pvt", "private"): 1, ("private", "pvt"): 1, ("pvt", None): 1, ("inc", None): 3, ("private", None): 2, ("limited", None): 1, ("gmbh", None): 1}
    assert not list(lexicon.replacements(["a"], [])) and not list(lexicon.replacements([], ["a"]))


def test_related_as_columns(spark):
    from tessera.functions import text as X

    words = ["pvt", "private", "praivet", "ltd", "limited", "lmtd", "la", "lab", "labo", "a", "abc", "a", "o", "oei", "hh", "hah", "inc", "incorporated", "co", "company", "corp"]
    df = spark.createDataFrame([(u, t) for u in words for t in words if u != t and u[0] == t[0]], "u string, t string")
    for r in df.select("u", "t", X.related(F.col("u"), F.col("t")).alias("r")).collect():
        assert lexicon.related(r.u, r.t) == r.r == lexicon.related(r.t, r.u), r


def test_swaps_make_no_row_of_unrelated_words(spark):
    x, y = ([f"{a}{b}{c}" for b in "bcdfg" for c in "klmnp"] for a in "xz")
    p = spark.createDataFrame([("US", ["acme", *x, "limited"], ["acme", *y, "ltd"]), ("US", ["limited", "acme"], ["ltd", "acme", "other"]), ("US", None, ["ltd"]), (None, ["limited"], ["ltd"])], "country string, a array<string>, b array<string>")
    legal = spark.createDataFrame([("US", w) for w in [*x, *y, "limited", "ltd", "acme"]], "country string, w string")
    got = {(r.u, r.t): r.v for r in lexicon.swaps(p, legal, "a", "b").collect()}
    assert {k: v for k, v in got.items() if k[1]} == {("ltd", "limited"): 2, ("limited", "ltd"): 2}
    # limited is also what each of the other 25 words replaces
    assert got["ltd", None] == 2 and got["limited", None] == 27 and got[y[0], None] == 26 and got[x[0], None] == 25 and len(got) == 54
