import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.functions import numeric as N
from tessera.functions import text as X


def one(spark, *columns, rows=((0,),), schema="x int"):
    return spark.createDataFrame(list(rows), schema).select(*columns).first()


@pytest.mark.parametrize(("raw", "want"), [
    ("J.P. Morgan L.L.C., P O Box 12 B", "jp morgan llc po box 12 b"),
    ("A & B Traders", "a b traders"),
    ("N°29 R. du Port, 12B, 1st Ave", "ndeg 29 r du port 12b 1st ave"),
])
def test_tokens(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string").withColumn("t", X.transliterate("a"))
    assert " ".join(df.select(X.tokens(F.col("t"))).first()[0]) == want


def test_house_and_street(spark):
    df = spark.createDataFrame([("20 bis rue x",), ("25 r du moulin",), ("0165 rue a",), ("rue",)], "a string")
    assert [r[0] for r in df.select(X.house(F.col("a"))).collect()] == ["20bis", "25", "165", ""]
    s = spark.createDataFrame([("Nantes, 18 Rue Capitaine Corhumel, Pays de la Loire",)], "a string")
    assert s.select(X.street_segment(F.col("a"))).first()[0] == " 18 Rue Capitaine Corhumel"


def test_noise_and_scripts(spark):
    rows = [(">> Shop (x) Shop Shop",), ("WWW.Foo-Bar.co.in",), ("काख abc",), ("h3llo  W0rld",)]
    c = F.col("a")
    df = spark.createDataFrame(rows, "a string")
    got = df.select(c.rlike(X.JUNK_PREFIX), c.rlike(X.BRACKET), X.domain_body(c), X.script_of(c), X.mixed_script(c), c.rlike(X.LEET), X.repeats_word(X.words(X.norm_basic(c)))).collect()
    assert tuple(got[0]) == (True, True, "", "Latin", False, False, True)
    assert got[1][2].lower() == "foobar"
    assert got[2][3] == "Devanagari" and got[2][4]
    assert got[3][5]


def test_states(spark):
    df = spark.createDataFrame([("1 Main St, TX", "US"), ("x, Tamil Nadu", "India"), ("x", "US"), ("x, TX", "FR")], "a string, c string")
    got = [tuple(r[0]) for r in df.select(X.address_state(F.col("a"), F.col("c"))).collect()]
    assert got == [("texas", "code"), ("tamil nadu", "name"), (None, None), (None, None)]


def test_skeletons_and_initials(spark):
    a = F.array(*[F.lit(w) for w in ("maharashtra", "tamil", "nadu", "nadu")])
    r = one(spark, X.skeleton_tokens(a)[0], X.initials(a), X.without_repeats(a), X.spans_with_initials(a, F.lit("tn")), X.longest_token(a), X.is_subsequence(F.lit("mht"), F.lit("maharashtra")))
    assert tuple(r) == ("mrstr", "mtnn", ["maharashtra", "tamil", "nadu"], ["tamil nadu"], "maharashtra", True)


def test_edits(spark):
    df = spark.createDataFrame([("mc groupement sa", "mc soins"), ("lille comite sas", "lille comte sas")], "a string, b string")
    df = df.select(F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    got = [(r[0], r[1]) for r in df.select(*M.edits(F.col("a"), F.col("b"))).collect()]
    assert got == [(["groupement", "sa"], ["soins"]), ([], [])]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


words = st.text(alphabet="abc d", max_size=14)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_metric_laws(a, b):
    assert M.lcs(a, b) == lcs(a, b)
    for f in (M.ratio, M.token_sort_ratio, M.token_set_ratio, M.partial_ratio, M.partial_token_set_ratio):
        assert 0 <= f(a, b) <= 100
        assert abs(f(a, b) - f(b, a)) < 1e-9
    assert M.ratio(a, a) == 100
    assert 0 <= M.jaro_winkler(a, b) <= 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=string.ascii_lowercase[:4], min_size=1, max_size=8), st.text(alphabet=string.ascii_lowercase[:4], min_size=1, max_size=12))
def test_partial_ratio_is_best_window(a, b):
    ways = [(s, t) for s, t in ((a, b), (b, a)) if len(s) <= len(t)]
    best = max(M.ratio(s, t[max(0, e - len(s)) : e]) for s, t in ways for e in range(1, len(t) + len(s)))
    assert abs(M.partial_ratio(a, b) - best) < 1e-9


def test_metric_fixtures():
    assert M.ratio("", "") == 100 and M.token_set_ratio("", "") == 0
    assert M.token_set_ratio("a b c", "a b") == 100
    assert round(M.jaro_winkler("martha", "marhta"), 4) == 0.9611


def test_numbers(spark):
    q = F.array(F.lit(0.9), F.lit(0.5), F.lit(0.2))
    pmf = one(spark, N.poisson_binomial(q))[0]
    assert [round(x, 6) for x in pmf] == [0.04, 0.41, 0.46, 0.09]
    a, b, e = (F.array(*[F.lit(x) for x in v]).cast("array<bigint>") for v in ((5, 7), (7, 8), ()))
    f = N.number_features(a, b)
    assert one(spark, *f.values())[0:4] == (0.0, 0.0, pytest.approx(1.0986122886681098), pytest.approx(1 / 3))
    assert one(spark, *N.number_features(a, e).values())[0] == -1.0
    assert one(spark, X.first_int(F.lit("x 12345678901234567890")), X.first_int(F.lit("none")))[:] == (123456789012345, -1)


@pytest.mark.parametrize(("text", "plain"), [
    ("Ελλάδα", "ellada"), ("Θεός ψυχή", "theos psychi"), ("Москва щи", "moskva shchi"), ("東京 株式会社", "u6771 u4eac u682a u5f0f u4f1a u793e"),
    ("서울", "seoul"), ("カナ かな", "kana kana"), ("ﬁ Straße", "fi strasse"), ("महाराष्ट्र", "mahaaraassttra"), ("شركة", "shrkt"), ("שלום", "shlvm"),
])
def test_transliteration(text, plain):
    assert X.romanized(text).lower().split() == plain.split()


def test_long_words_keep_their_skeleton(spark):
    word = "x" + "ab" * 8000
    got = one(spark, X.skeleton_word(F.lit(word)), F.element_at(X.skeleton_tokens(F.array(F.lit(word))), 1))
    assert got[0] == got[1] == "x" + "b" * 8000


def test_word_helpers(spark):
    t = F.lit("12 Rue du Moulin, Opp Acme Ltd, 75001 Paris")
    got = one(spark, X.name_tokens(F.lit("The Acme Acme Tools Ltd")), X.address_tokens(F.lit("n/a None Rue")), X.street_words(t), X.int_list(t), X.embed_text(F.lit("a"), F.lit("b")), X.prompt(*[F.lit(x) for x in "abcd"]))
    assert got[0] == ["acme", "tools"] and "rue" in got[1] and "none" not in got[1]
    assert got[2] == ["rue", "moulin"] and got[3] == [12, 75001] and got[4] == "a, b" and got[5].endswith("Same? ")
    assert one(spark, M.token_levenshtein_ok(F.lit("acme"), F.array(F.lit("acne"), F.lit("x"))))[0]
    house = one(spark, X.domain_body(F.lit("www.my-shop.co.in")), X.norm_indic(F.lit("Café, दिल्ली!")))
    assert house == ("myshop", "cafe दिल्ली")


def test_pair_metrics_counts_edits_in_bytes(spark, tmp_path):
    from tessera.plans import texts

    rows = [(1, "alpha beta", "en", "src0", 0), (2, "alpha бета", "en", "src12", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    [r] = texts.pair_metrics(spark, str(tmp_path)).collect()
    assert (r.rid, r.sid, r.lev) == (2, 1, 8)  # four letters of one byte against four of two
