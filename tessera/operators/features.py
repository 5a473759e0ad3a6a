"""Pair features: weighted overlaps, string metrics and flags, in the fixed order of the pair matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.text import numbers
from . import aggregates, windows


def weighted_jaccard(p: DataFrame, key: str, a: str, b: str, idf: DataFrame, block: str) -> DataFrame:
    """(key, wj, shared_idf, a_unshared_max, b_unshared_max): overlap of two word lists weighted by idf (block, token, idf)."""
    x = p.select(key, block, F.explode(F.array_union(a, b)).alias("token"), a, b).withColumns({"in_a": F.array_contains(a, F.col("token")), "in_b": F.array_contains(b, F.col("token"))})
    x = x.select(key, block, "token", "in_a", "in_b").join(idf.select(block, "token", "idf"), [block, "token"])
    both = F.col("in_a") & F.col("in_b")
    g = x.groupBy(key).agg(
        F.coalesce(F.sum(F.when(both, F.col("idf"))), F.lit(0.0)).alias("shared_idf"),
        F.sum("idf").alias("total"),
        F.coalesce(F.max(F.when(~F.col("in_b"), F.col("idf"))), F.lit(0.0)).alias("a_unshared_max"),
        F.coalesce(F.max(F.when(~F.col("in_a"), F.col("idf"))), F.lit(0.0)).alias("b_unshared_max"),
    )
    return g.select(key, (F.col("shared_idf") / F.greatest("total", F.lit(1e-9))).alias("wj"), "shared_idf", "a_unshared_max", "b_unshared_max")


# Fixed value: the log share of a word that no statistics know.
UNKNOWN_DF = -13.815510557964274
# End of fixed values.


def edit_features(p: DataFrame, key: str, a: str, b: str, stats: DataFrame, block: str) -> DataFrame:
    """(key, ed_add, ed_del, ed_swap_sim, ed_add_susp, ed_add_df, ed_del_df): words that the list ``b`` adds to ``a`` and lacks of it.

    Words alike at a ratio of 80 or more are no edits. How many are added and lacking, the best likeness of an added and a lacking one, the
    most suspicious and the most frequent added one, the most frequent lacking one; null where there is none. ``stats``: (block,
    token, susp, df), joined by word, so that it may be of any size.
    """
    x = p.select(key, block, M.unmatched_udf(F.col(b), F.col(a)).alias("add"), M.unmatched_udf(F.col(a), F.col(b)).alias("del"))
    x = x.withColumn("swap", M.best_ratio_udf(F.col("add"), F.col("del")))
    rows = F.concat(F.transform("add", lambda t: F.struct(t.alias("token"), F.lit(True).alias("added"))), F.transform("del", lambda t: F.struct(t.alias("token"), F.lit(False).alias("added"))))
    w = x.select(key, block, F.explode(rows).alias("r")).select(key, block, "r.token", "r.added").join(stats.select(block, "token", "susp", "df"), [block, "token"], "left")
    susp, df = F.coalesce("susp", F.lit(0.0)), F.coalesce("df", F.lit(UNKNOWN_DF))
    g = w.groupBy(key).agg(F.max(F.when(F.col("added"), susp)).alias("ed_add_susp"), F.max(F.when(F.col("added"), df)).alias("ed_add_df"), F.max(F.when(~F.col("added"), df)).alias("ed_del_df"))
    x = x.select(key, F.size("add").cast("double").alias("ed_add"), F.size("del").cast("double").alias("ed_del"), F.col("swap").alias("ed_swap_sim"))
    return x.join(g, key, "left")


def text_features(c: DataFrame, rid: str = "rid") -> DataFrame:
    """Cheap text scores of candidates (nn, cn, na of both sides), and their gaps to the record's best."""
    from pyspark.sql import Window

    c = c.withColumns({"t_nn": M.token_set_udf("nn1", "nn2"), "t_cn": M.ratio_udf("cn1", "cn2"), "t_na": M.token_set_udf("na1", "na2")})
    w = Window.partitionBy(rid)
    return c.withColumns({f"{t}_gap": F.max(t).over(w) - F.col(t) for t in ("t_nn", "t_cn", "t_na")})


def string_block(x: str, a: str, b: str) -> dict[str, Column]:
    return {f"{x}_ratio": M.ratio_udf(a, b), f"{x}_tset": M.token_set_udf(a, b), f"{x}_tsort": M.token_sort_udf(a, b), f"{x}_partial": M.partial_udf(a, b), f"{x}_jw": M.jaro_winkler_udf(a, b)}


def pair_features(c: DataFrame, s1: DataFrame, records: DataFrame, block: str = "country") -> DataFrame:
    """The wide pair table, keyed (rid, sid): retrieval, name, address, number, weighted-overlap and namesake features.

    ``s1`` and ``records``: normalised once each, with columns nn, cn, sk, na, num, zip (text), nonascii and the block; ``c``: rid,
    sid, score. Windows by rid and sid take two exchanges, both sides' texts two joins; string metrics share one Arrow stage.
    """
    cols = ["nn", "cn", "sk", "na", "num", "zip"]
    x = windows.entity_ranks(windows.retrieval_features(c))
    a = s1.select(F.col("entity_id").alias("sid"), block, *[F.col(k).alias(f"{k}1") for k in cols])
    b = records.select(F.col("entity_id").alias("rid"), *[F.col(k).alias(f"{k}2") for k in cols], F.col("nonascii").alias("b_nonascii"))
    x = x.join(a, "sid").join(b, "rid")
    flat = {**string_block("nn", "nn1", "nn2"), **string_block("cn", "cn1", "cn2")}
    flat |= {"na_ratio": M.ratio_udf("na1", "na2"), "na_tset": M.token_set_udf("na1", "na2"), "na_partial": M.partial_token_set_udf("na1", "na2"), "num_tset": M.token_set_udf("num1", "num2"), "num_partial": M.partial_udf("num1", "num2"), "sk_ratio": M.ratio_udf("sk1", "sk2"), "sk_tset": M.token_set_udf("sk1", "sk2")}
    first1, first2 = F.substring_index("num1", " ", 1), F.substring_index("num2", " ", 1)
    flat |= {
        "cn_nospace": F.replace("cn1", F.lit(" "), F.lit("")) == F.replace("cn2", F.lit(" "), F.lit("")),
        "cn_eq": F.col("cn1") == F.col("cn2"),
        "num_first_eq": (first1 == first2) & (F.col("num2") != ""),
        "zip_eq": F.when((F.col("zip1") == "") | (F.col("zip2") == ""), -1).otherwise((F.col("zip1") == F.col("zip2")).cast("int")),
        "b_addr_empty": F.col("na2") == "", "b_num_empty": F.col("num2") == "", "src3": F.startswith("rid", F.lit("S3")),
        "len_a": F.length("nn1"), "len_b": F.length("nn2"),
    }
    x = x.withColumns(flat).withColumn("pair", F.struct("rid", "sid"))
    for f in ("cn", "na"):
        words = F.filter(F.split(f, " "), lambda t: t != "")
        idf = aggregates.idf(s1.select(block, f).union(records.select(block, f)), words, [block])
        p = x.select("pair", block, F.filter(F.split(f"{f}1", " "), lambda t: t != "").alias("a"), F.filter(F.split(f"{f}2", " "), lambda t: t != "").alias("b"))
        wj = weighted_jaccard(p, "pair", "a", "b", idf, block)
        x = x.join(wj.select("pair", *[F.col(n).alias(f"{f}_{n}") for n in ("wj", "shared_idf", "a_unshared_max", "b_unshared_max")]), "pair", "left")
    for side, name in (("a", "cn1"), ("b", "cn2")):
        n1 = s1.groupBy(F.col("cn").alias(name), block).agg(F.count("*").alias(f"{side}_cn_s1_count"))
        x = x.join(n1, [name, block], "left")
    n2 = records.groupBy(F.col("cn").alias("cn1"), block).agg(F.count("*").alias("a_cn_rec_count"))
    return x.join(n2, ["cn1", block], "left").drop("pair").na.fill(0)


def normalised(df: DataFrame, name: str = "business_name", address: str = "business_address", legal: list[str] | None = None) -> DataFrame:
    """Each row's texts, normalised once and not per pair: nn, cn, sk, na, num, zip, nonascii."""
    from ..functions import text as X

    df = df.withColumns({"tn": X.transliterate(name), "ta": X.transliterate(address)})  # before any lambda: it is an Arrow stage
    df = df.withColumns({"tn": X.tokens(F.col("tn")), "ta": X.tokens(F.col("ta"))})
    junk = X.JUNK_WORDS
    df = df.withColumns({"tn": F.filter("tn", lambda t: ~t.isin(junk)), "ta": F.filter("ta", lambda t: ~t.isin(junk))})
    core = X.core_tokens(F.col("tn"), legal or X.LEGAL_WORDS)
    na = F.array_join("ta", " ")
    return df.withColumns({"nn": F.array_join("tn", " "), "cn": F.array_join(core, " "), "sk": F.array_join(X.skeleton_tokens(core), " "), "na": na, "num": F.array_join(numbers(na), " "), "zip": X.zip_code(na), "nonascii": X.non_ascii(F.col(name))}).drop("tn", "ta")
