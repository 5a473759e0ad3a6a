"""Queries on texts: ``documents`` as records of three sources.

The source column gives the role: src0..src4 are the reference list S1, src5..src9 are S2, the others S3. The block is lang, the name
is the first line and the address the rest of the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X
from ..operators import aggregates, blocking, lexicon, ngrams
from ..registry import query
from ..session import table, width, written

DOCS = """d AS (SELECT doc_id, lang AS block, text, coalesce(split_part(text, chr(10), 1), '') AS name, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS address,
 CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'S1' WHEN source IN ('src5', 'src6', 'src7', 'src8', 'src9') THEN 'S2' ELSE 'S3' END AS src FROM documents)"""
WORDS = DOCS + """, t AS (SELECT doc_id, block, src, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM d)"""


def records(spark, d):
    t = F.col("text")
    src = F.when(F.col("source").isin("src0", "src1", "src2", "src3", "src4"), "S1").when(F.col("source").isin("src5", "src6", "src7", "src8", "src9"), "S2").otherwise("S3")
    at = F.instr(t, "\n")
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("block"), "text", F.coalesce(F.substring_index(t, "\n", 1), F.lit("")).alias("name"), F.when(at > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("address"), src.alias("src"))


def named(spark, d):
    return records(spark, d).withColumn("w", X.words(X.norm_basic(F.col("name")))).select("doc_id", "block", "src", "w")


@query("normalised_text", f"WITH {DOCS} SELECT doc_id, src, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS h FROM d")
def normalised_text(spark, d):
    return records(spark, d).select("doc_id", "src", F.md5(X.norm_basic(F.col("text"))).alias("h"))


@query("noise_rates", f"""WITH {DOCS} SELECT src, block, count(*) AS n, round(avg(regexp_matches(name, '  ')::INT), 6) AS double_space, round(avg(regexp_matches(name, '(?i)[a-z][0-9][a-z]')::INT), 6) AS leet, round(avg(regexp_matches(name, '[\\[\\(][^\\]\\)]*[\\]\\)]\\s*$')::INT), 6) AS bracket,
 round(avg(regexp_matches(text, '[0-9]{{5}}')::INT), 6) AS five_digits, round(avg((strlen(text) <> length(text))::INT), 6) AS non_ascii, round(avg((upper(name) = name AND lower(name) <> name)::INT), 6) AS all_caps FROM d GROUP BY src, block""")
def noise_rates(spark, d):
    n, t = F.col("name"), F.col("text")
    flags = {"double_space": n.rlike(X.NAME_PATTERNS["double_space"]), "leet": n.rlike(X.NAME_PATTERNS["leet_digit_in_word"]), "bracket": n.rlike(X.NAME_PATTERNS["bracket_suffix"]), "five_digits": t.rlike("[0-9]{5}"), "non_ascii": X.non_ascii(t), "all_caps": X.all_caps(n)}
    return records(spark, d).groupBy("src", "block").agg(F.count("*").alias("n"), *[F.round(F.avg(c.cast("double")), 6).alias(k) for k, c in flags.items()])


@query("source_profile", f"""WITH {DOCS} SELECT src, count(*) AS n, round(avg((address = '')::INT), 6) AS empty_address, round(avg(length(text)), 4) AS mean_len, quantile_cont(length(text), .5) AS p50, round(quantile_cont(length(text), .99), 4) AS p99, max(length(text)) AS longest, count(name) - count(DISTINCT name) AS dup_names FROM d GROUP BY src""")
def source_profile(spark, d):
    n = F.length("text")
    return records(spark, d).groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg((F.col("address") == "").cast("double")), 6).alias("empty_address"), F.round(F.avg(n), 4).alias("mean_len"), F.percentile(n, F.lit(0.5)).alias("p50"), F.round(F.percentile(n, F.lit(0.99)), 4).alias("p99"), F.max(n).cast("long").alias("longest"), (F.count("name") - F.countDistinct("name")).alias("dup_names"))


@query("length_quantiles", f"""WITH {DOCS}, l AS (SELECT block, length(name) AS name_len, length(text) AS text_len FROM d), q AS (SELECT block, quantile_cont(name_len, [.05, .5, .95]) AS a, quantile_cont(text_len, [.05, .5, .95]) AS b FROM l GROUP BY block)
SELECT block, 'name_len' AS "column", unnest([.05, .5, .95])::DOUBLE AS q, round(unnest(a), 4) AS value FROM q UNION ALL SELECT block, 'text_len', unnest([.05, .5, .95])::DOUBLE, round(unnest(b), 4) FROM q""")
def length_quantiles(spark, d):
    r = records(spark, d).select("block", F.length("name").alias("name_len"), F.length("text").alias("text_len"))
    return aggregates.quantiles(r, ["block"], ["name_len", "text_len"], [0.05, 0.5, 0.95]).select("block", "column", "q", F.round("value", 4).alias("value"))


@query("document_frequency", """WITH w AS (SELECT lang AS block, doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) AS token FROM documents), n AS (SELECT lang AS block, count(*) AS n FROM documents GROUP BY 1)
SELECT block, token, count(*) AS df, round(ln(any_value(n) / count(*)), 6) AS idf FROM w JOIN n USING (block) GROUP BY block, token""")
def document_frequency(spark, d):
    r = records(spark, d)
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    return aggregates.idf(r, words, ["block"]).select("block", "token", "df", F.round("idf", 6).alias("idf"))


@query("top_words", f"""WITH {WORDS}, x AS (SELECT block, unnest(w) AS token FROM t), n AS (SELECT block, count(*) AS total FROM x GROUP BY block), c AS (SELECT block, token, count(*) AS n FROM x GROUP BY ALL)
SELECT block, token, n, round(n / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, token) AS rn FROM c) JOIN n USING (block) WHERE rn <= 20""")
def top_words(spark, d):
    x = named(spark, d).select("block", F.explode("w").alias("token"))
    return aggregates.top_values(x, "token", 20, ["block"]).select("block", "token", "n", F.round("share", 6).alias("share"))


@query("last_words", f"""WITH {WORDS}, l AS (SELECT block, w[-1] AS last1, w[-2] || ' ' || w[-1] AS last2 FROM t WHERE len(w) >= 2) SELECT block, count(DISTINCT last1) AS words, count(DISTINCT last2) AS pairs, mode(last1) IS NOT NULL AS has FROM l GROUP BY block""")
def last_words(spark, d):
    x = named(spark, d).filter(F.size("w") >= 2)
    last, second = F.element_at("w", -1), F.element_at("w", -2)
    return x.groupBy("block").agg(F.countDistinct(last).alias("words"), F.countDistinct(F.concat_ws(" ", second, last)).alias("pairs"), F.mode(last).isNotNull().alias("has"))


@query("vocabulary_coverage", f"""WITH {WORDS}, x AS (SELECT block, unnest(w) AS token FROM t), c AS (SELECT block, token, count(*) AS n FROM x GROUP BY ALL), top AS (SELECT block, list(token) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, token) AS rn FROM c) WHERE rn <= 200 GROUP BY block)
SELECT block, count(*) AS n, round(avg(list_has_all(ts, w)::INT), 6) AS covered FROM t JOIN top USING (block) GROUP BY block""")
def vocabulary_coverage(spark, d):
    n = named(spark, d)
    top = aggregates.top_values(n.select("block", F.explode("w").alias("token")), "token", 200, ["block"]).groupBy("block").agg(F.collect_list("token").alias("ts"))  # 200 a block
    x = n.join(top, "block")
    return x.groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg((F.size(F.array_except("w", "ts")) == 0).cast("double")), 6).alias("covered"))


@query("concentration", f"""WITH {WORDS}, c AS (SELECT block, w[1] AS v, count(*) AS n FROM t WHERE len(w) > 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, v) AS rn FROM c)
SELECT block, count(*) AS "distinct", round(sum(n) FILTER (rn <= 10) / sum(n), 6) AS top10, round(sum(n) FILTER (rn <= 100) / sum(n), 6) AS top100 FROM r GROUP BY block""")
def concentration(spark, d):
    x = named(spark, d).filter(F.size("w") > 0).select("block", F.element_at("w", 1).alias("v"))
    return aggregates.concentration(x, "v", "block", [10, 100]).select("block", "distinct", F.round("top10", 6).alias("top10"), F.round("top100", 6).alias("top100"))


KEYS = {
    "longest": "list_sort(list_transform(w, lambda x: {'n': -length(x), 'x': x}))[1].x",
    "any": "unnest(list_distinct(w))",
    "prefix": "substr(w[1], 1, 3)",
}


def _blocking(kind: str):
    @query(f"blocking_{kind}", f"""WITH {WORDS}, k AS (SELECT doc_id, block, src, {KEYS[kind]} AS k FROM t WHERE len(w) > 0), s AS (SELECT block, k, count(*) AS n1 FROM k WHERE src = 'S1' GROUP BY ALL), r AS (SELECT block, k, count(*) AS n2 FROM k WHERE src <> 'S1' GROUP BY ALL)
SELECT count(*) AS blocks, max(n1 * n2)::BIGINT AS largest, sum(n1 * n2)::BIGINT AS volume FROM s JOIN r USING (block, k)""")
    def run(spark, d):
        n = named(spark, d).filter(F.size("w") > 0)
        return blocking.volume(n.filter("src = 'S1'"), n.filter("src != 'S1'"), blocking.keys(F.col("w"), kind), "block")

    return run


blocking_longest, blocking_any, blocking_prefix = (_blocking(k) for k in KEYS)


@query("blocking_recall", f"""WITH {WORDS}, tr AS (SELECT a.doc_id AS sid, b.doc_id AS rid FROM d a JOIN d b ON a.text = b.text AND a.src = 'S1' AND b.src <> 'S1'), k AS (SELECT doc_id, block, substr(w[1], 1, 3) AS k FROM t WHERE len(w) > 0)
SELECT count(*) AS pairs, round(avg((x.k = y.k AND x.block = y.block)::INT), 6) AS recall FROM tr JOIN k x ON x.doc_id = sid JOIN k y ON y.doc_id = rid""")
def blocking_recall(spark, d):
    r, n = records(spark, d), named(spark, d).filter(F.size("w") > 0)
    key = n.select("doc_id", "block", F.substring(F.element_at("w", 1), 1, 3).alias("k"))
    h = r.withColumn("h", F.md5("text"))
    truth = h.filter("src = 'S1'").select(F.col("doc_id").alias("sid"), "h").join(h.filter("src != 'S1'").select(F.col("doc_id").alias("rid"), "h"), "h")
    a, b = key.select(F.col("doc_id").alias("sid"), F.struct("block", "k").alias("ka")), key.select(F.col("doc_id").alias("rid"), F.struct("block", "k").alias("kb"))
    return truth.join(a, "sid").join(b, "rid").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("ka") == F.col("kb")).cast("double")), 6).alias("recall"))


def name_pairs(spark, d):
    """Records with the S1 document of the same block and first word that has the smallest id."""
    n = records(spark, d).withColumn("w", X.words(X.norm_basic(F.col("name")))).filter(F.size("w") > 0).withColumn("f", F.element_at("w", 1))
    s1 = n.filter("src = 'S1'").groupBy("block", "f").agg(F.min_by(F.struct("doc_id", "name", "w"), "doc_id").alias("a"))
    return n.filter("src != 'S1'").join(s1, ["block", "f"]).select("block", "src", F.col("doc_id").alias("rid"), F.col("a.doc_id").alias("sid"), F.col("a.name").alias("name1"), F.col("name").alias("name2"), F.col("a.w").alias("w1"), F.col("w").alias("w2"))


PAIRS = WORDS + """, m AS (SELECT doc_id, block, src, name, w, w[1] AS f FROM t JOIN d USING (doc_id, block, src) WHERE len(w) > 0), s1 AS (SELECT block, f, min(doc_id) AS sid FROM m WHERE src = 'S1' GROUP BY ALL),
p AS (SELECT m.block, m.src, m.doc_id AS rid, sid, a.name AS name1, m.name AS name2, a.w AS w1, m.w AS w2 FROM m JOIN s1 USING (block, f) JOIN m a ON a.doc_id = sid WHERE m.src <> 'S1')"""


@query("pair_metrics", f"""WITH {PAIRS} SELECT rid, sid, coalesce(levenshtein(w1[1] || ' ' || w1[2], w2[1] || ' ' || w2[2]), -1) AS lev, round(jaro_winkler_similarity(array_to_string(list_filter(w1, lambda x: regexp_full_match(x, '[a-z]+')), ' '), array_to_string(list_filter(w2, lambda x: regexp_full_match(x, '[a-z]+')), ' ')), 6) AS jw, round(len(list_intersect(w1, w2)) / len(list_distinct(list_concat(w1, w2))), 6) AS jacc FROM p""")
def pair_metrics(spark, d):
    p = name_pairs(spark, d)
    both = F.size(F.array_intersect("w1", "w2")) / F.size(F.array_union("w1", "w2"))
    a, b = (F.array_join(F.filter(c, lambda x: x.rlike("^[a-z]+$")), " ") for c in ("w1", "w2"))
    # edits are counted in bytes of UTF-8, as DuckDB does: each byte stands as one character
    u, v = (F.decode(F.encode(F.concat(F.try_element_at(c, F.lit(1)), F.lit(" "), F.try_element_at(c, F.lit(2))), "UTF-8"), "ISO-8859-1") for c in ("w1", "w2"))
    jw = F.when((a == "") & (b == ""), 0.0).otherwise(M.jaro_winkler_udf(a, b))  # texts without words are unlike in DuckDB
    # as DuckDB rounds: 41 / 640 is 0.0640625, but a millionth of 64062.49999999999 in doubles
    millionths = lambda x: F.round(x * 1e6) / 1e6
    return p.select("rid", "sid", F.coalesce(F.levenshtein(u, v).cast("long"), F.lit(-1)).alias("lev"), millionths(jw).alias("jw"), millionths(both).alias("jacc"))


@query("fuzzy_metrics")
def fuzzy_metrics(spark, d):
    p = name_pairs(spark, d).select("rid", "sid", F.array_join("w1", " ").alias("a"), F.array_join("w2", " ").alias("b"))
    p = p.repartition(width(spark), "a", "b")  # the work is in the metrics, not in the bytes; equal pairs meet
    a, b = F.col("a"), F.col("b")
    return p.select("rid", "sid", M.ratio_udf(a, b).alias("ratio"), M.token_sort_udf(a, b).alias("token_sort"), M.token_set_udf(a, b).alias("token_set"), M.partial_udf(a, b).alias("partial"), M.partial_token_set_udf(a, b).alias("partial_token_set"))


@query("pair_flags", f"""WITH {PAIRS} SELECT rid, name1 = name2 AS raw_eq, w1 = w2 AS norm_eq, list_sort(list_distinct(w1)) = list_sort(list_distinct(w2)) AS set_eq, list_sort(w1) = list_sort(w2) AND w1 <> w2 AS reorder,
 list_has_all(w2, w1) AND len(list_distinct(w1)) < len(list_distinct(w2)) AS word_added, list_has_all(w1, w2) AND len(list_distinct(w2)) < len(list_distinct(w1)) AS word_dropped,
 CASE WHEN name1 = name2 THEN 'exact' WHEN list_sort(w1) = list_sort(w2) THEN 'reordered' WHEN list_has_all(w2, w1) OR list_has_all(w1, w2) THEN 'subset' ELSE 'other' END AS category FROM p""")
def pair_flags(spark, d):
    p = name_pairs(spark, d)
    a, b = F.col("w1"), F.col("w2")
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    a_in_b, b_in_a = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    same = F.array_sort(a) == F.array_sort(b)
    category = F.when(F.col("name1") == F.col("name2"), "exact").when(same, "reordered").when(a_in_b | b_in_a, "subset").otherwise("other")
    return p.select("rid", (F.col("name1") == F.col("name2")).alias("raw_eq"), (a == b).alias("norm_eq"), (F.array_sort(sa) == F.array_sort(sb)).alias("set_eq"), (same & (a != b)).alias("reorder"), (a_in_b & (F.size(sa) < F.size(sb))).alias("word_added"), (b_in_a & (F.size(sb) < F.size(sa))).alias("word_dropped"), category.alias("category"))


@query("weighted_jaccard", f"""WITH {PAIRS}, n AS (SELECT block, count(*) AS n FROM t GROUP BY block), i AS (SELECT block, token, ln(any_value(n) / count(*)) AS idf FROM (SELECT block, unnest(list_distinct(w)) AS token FROM t) JOIN n USING (block) GROUP BY ALL),
x AS (SELECT rid, block, unnest(list_distinct(list_concat(w1, w2))) AS token, w1, w2 FROM p)
SELECT rid, round(coalesce(sum(idf) FILTER (list_contains(w1, token) AND list_contains(w2, token)), 0), 6) AS shared_idf, round(coalesce(sum(idf) FILTER (list_contains(w1, token) AND list_contains(w2, token)), 0) / greatest(sum(idf), 1e-9), 6) AS wj,
 round(coalesce(max(idf) FILTER (NOT list_contains(w2, token)), 0), 6) AS a_unshared_max, round(coalesce(max(idf) FILTER (NOT list_contains(w1, token)), 0), 6) AS b_unshared_max FROM x JOIN i USING (block, token) GROUP BY rid""")
def weighted_jaccard(spark, d):
    from ..operators import features

    idf = aggregates.idf(named(spark, d), F.col("w"), ["block"])
    x = features.weighted_jaccard(name_pairs(spark, d), "rid", "w1", "w2", idf, "block")
    return x.select("rid", *[F.round(c, 6).alias(c) for c in ("shared_idf", "wj", "a_unshared_max", "b_unshared_max")])


@query("word_suspicion", f"""WITH {PAIRS}, pm AS (SELECT block, count(*) AS n_pm FROM p GROUP BY block), s AS (SELECT block, count(*) AS n_s1 FROM t WHERE src = 'S1' GROUP BY block),
i AS (SELECT block, w, count(*) AS ins FROM (SELECT block, rid, unnest(list_distinct(list_filter(w2, lambda x: NOT list_contains(w1, x)))) AS w FROM p) GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT block, w, count(*) AS df FROM (SELECT block, doc_id, unnest(list_distinct(w)) AS w FROM t WHERE src = 'S1') GROUP BY ALL),
r AS (SELECT block, w, ln((ins / n_pm + 1e-5) / (coalesce(df, 0) / n_s1 + 1e-5)) AS raw, ln(coalesce(df, 0) / n_s1 + 1e-6) AS log_df FROM i LEFT JOIN f USING (block, w) JOIN pm USING (block) JOIN s USING (block))
SELECT block, w, round(raw - median(raw) OVER (PARTITION BY block), 6) AS susp, round(log_df, 6) AS log_df FROM r""")
def word_suspicion(spark, d):
    from ..operators import rules

    x = rules.word_suspicion(name_pairs(spark, d), named(spark, d).filter("src = 'S1'").withColumnRenamed("w", "w1"), "w1", "w2", "block", least=2)
    return x.select("block", "w", F.round("susp", 6).alias("susp"), F.round("log_df", 6).alias("log_df"))


@query("drop_add_counters", f"""WITH {PAIRS}, a AS (SELECT block, unnest(list_distinct(w1)) AS w, rid, w2 FROM p), b AS (SELECT block, unnest(list_distinct(w2)) AS w, rid, w1 FROM p),
x AS (SELECT block, w, count(*) AS has, count(*) FILTER (NOT list_contains(w2, w)) AS dropped FROM a GROUP BY ALL), y AS (SELECT block, w, count(*) AS has_b, count(*) FILTER (NOT list_contains(w1, w)) AS added FROM b GROUP BY ALL)
SELECT coalesce(x.block, y.block) AS block, coalesce(x.w, y.w) AS w, coalesce(has, 0) AS has, coalesce(dropped, 0) AS dropped, coalesce(has_b, 0) AS has_b, coalesce(added, 0) AS added FROM x FULL JOIN y ON x.block = y.block AND x.w = y.w""")
def drop_add_counters(spark, d):
    return lexicon.drop_counters(name_pairs(spark, d).withColumnRenamed("block", "country"), "w1", "w2").withColumnRenamed("country", "block")


@query("lexicon")
def learned_lexicon(spark, d):
    p = written(name_pairs(spark, d).select(F.col("block").alias("country"), "w1", "w2").repartition(2 * width(spark)), "pairs")  # read by each part of the lexicon
    s1 = written(named(spark, d).filter("src = 'S1'").withColumnRenamed("block", "country"), "names")
    return lexicon.learn(p, s1, "w1", "w2", "w", least=2)


@query("tokens")
def token_counts(spark, d):
    t = X.tokens(F.col("plain"))
    return records(spark, d).withColumn("plain", X.transliterate("text")).select("doc_id", F.size(t).alias("n_tokens"), F.size(X.core_tokens(t)).alias("n_core"), X.longest_token(t).alias("longest"), X.script_of(F.col("text")).alias("script"), F.size(X.numbers(F.col("text"))).alias("n_numbers"))


@query("number_features", """WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS ns FROM documents) SELECT doc_id, len(ns) AS n, coalesce(substr(ns[1], 1, 15)::BIGINT, -1) AS first_int, coalesce(substr(ns[2], 1, 12)::BIGINT, -1) AS second_int, coalesce(list_filter(ns, lambda x: length(x) IN (5, 6))[-1], '') AS zip FROM n""")
def number_features(spark, d):
    t = F.col("text")
    return records(spark, d).select("doc_id", F.size(X.numbers(t)).cast("long").alias("n"), X.first_int(t).alias("first_int"), X.second_int(t).alias("second_int"), X.zip_code(t).alias("zip"))


@query("skeletons", f"WITH {WORDS} SELECT doc_id, array_to_string(list_transform(w, lambda x: substr(x, 1, 1) || regexp_replace(substr(x, 2), '[aeiouh]', '', 'g')), ' ') AS sk, array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '') AS ini FROM t")
def skeletons(spark, d):
    return named(spark, d).select("doc_id", F.array_join(X.skeleton_tokens(F.col("w")), " ").alias("sk"), X.initials(F.col("w")).alias("ini"))


@query("tfidf_knn", f"""WITH {DOCS}, g AS (SELECT doc_id, block, src, unnest(list_transform(range(1, greatest(length(name) - 1, 1)), lambda i: substr(name, i, 3))) AS term FROM (SELECT doc_id, block, src, lower(name) AS name FROM d WHERE length(name) >= 3)),
n AS (SELECT block, count(DISTINCT doc_id) AS n FROM g GROUP BY block), i AS (SELECT block, term, ln(1 + any_value(n) / count(DISTINCT doc_id)) AS idf FROM g JOIN n USING (block) GROUP BY ALL),
w AS (SELECT block, doc_id, src, term, count(*) * any_value(idf) AS w FROM g JOIN i USING (block, term) GROUP BY ALL), v AS (SELECT block, doc_id, src, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
s AS (SELECT a.doc_id AS rid, b.doc_id AS sid, sum(a.w * b.w) AS score FROM v a JOIN v b ON a.block = b.block AND a.term = b.term AND a.src <> 'S1' AND b.src = 'S1' GROUP BY ALL)
SELECT rid, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, sid) AS rank FROM s) WHERE rank <= 3""")
def tfidf_knn(spark, d):
    """The three best entities of every record, by character trigrams of the name."""
    r = records(spark, d).select("block", F.col("doc_id").alias("id"), (F.col("src") == "S1").alias("base"), F.lower("name").alias("text"))
    return ngrams.nearest(r, 3).select("rid", "rank", F.round("score", 4).alias("score"))


@query("similarity_table", f"""WITH {PAIRS}, x AS (SELECT (name1 = name2)::VARCHAR AS pos, len(list_intersect(w1, w2)) / len(list_distinct(list_concat(w1, w2))) AS jacc, abs(length(name1) - length(name2)) AS gap FROM p)
SELECT pos, count(*) AS n, round(avg(jacc), 6) AS jacc, round(quantile_cont(jacc, .1), 6) AS jacc10, round(avg(gap), 6) AS gap FROM x GROUP BY pos""")
def similarity_table(spark, d):
    j = F.size(F.array_intersect("w1", "w2")) / F.size(F.array_union("w1", "w2"))
    x = name_pairs(spark, d).select((F.col("name1") == F.col("name2")).cast("string").alias("pos"), j.alias("j"), F.abs(F.length("name1") - F.length("name2")).alias("g"))
    return x.groupBy("pos").agg(F.count("*").alias("n"), F.round(F.avg("j"), 6).alias("jacc"), F.round(F.percentile("j", F.lit(0.1)), 6).alias("jacc10"), F.round(F.avg("g"), 6).alias("gap"))


@query("sibling_similarity", f"""WITH {PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY sid, src ORDER BY rid) AS rn FROM p), x AS (SELECT a.src, a.name2 = b.name2 AS same, len(list_intersect(a.w2, b.w2)) / len(list_distinct(list_concat(a.w2, b.w2))) AS j FROM o a JOIN o b ON a.sid = b.sid AND a.src = b.src AND a.rn = 1 AND b.rn = 2)
SELECT src, count(*) AS n, round(avg(same::INT), 6) AS same, round(median(j), 6) AS jacc FROM x GROUP BY src""")
def sibling_similarity(spark, d):
    """The first and the second record of each entity and source, without a self-join."""
    from pyspark.sql import Window

    w = Window.partitionBy("sid", "src").orderBy("rid")
    x = name_pairs(spark, d).withColumns({"rn": F.row_number().over(w), "n2": F.lead("name2").over(w), "v2": F.lead("w2").over(w)}).filter("rn = 1 AND n2 IS NOT NULL")
    j = F.size(F.array_intersect("w2", "v2")) / F.size(F.array_union("w2", "v2"))
    return x.select("src", (F.col("name2") == F.col("n2")).cast("double").alias("same"), j.alias("j")).groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("same"), 6).alias("same"), F.round(F.median("j"), 6).alias("jacc"))
