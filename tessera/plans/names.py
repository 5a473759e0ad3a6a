"""Queries on names and numbers: ``part`` by brand, customers and suppliers by nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import aggregates, rules
from ..registry import query
from ..session import table


@query("namesakes", """WITH c AS (SELECT p_name, p_brand, count(*) AS namesakes FROM part GROUP BY ALL) SELECT p_partkey, namesakes FROM part JOIN c USING (p_name, p_brand)""")
def namesakes(spark, d):
    return aggregates.namesakes(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"]).select("p_partkey", "namesakes")


@query("same_name_groups", """WITH g AS (SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(*) > 1) SELECT count(*) AS groups, sum(n)::BIGINT AS rows, max(n) AS largest, round(sum(n) / (SELECT count(*) FROM part), 6) AS share, round(avg((brands = 1)::INT), 6) AS one_brand FROM g""")
def same_name_groups(spark, d):
    p = table(spark, d, "part").select("p_name", "p_brand")
    g = p.groupBy("p_name").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))
    return g.agg(F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows"), F.max("n").alias("largest"), F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"), F.round(F.avg(F.when(F.col("n") > 1, (F.col("brands") == 1).cast("double"))), 6).alias("one_brand"))


@query("duplicates", """SELECT 'p_name' AS "column", count(p_name) - count(DISTINCT p_name) AS duplicates FROM part UNION ALL SELECT 'p_partkey', count(p_partkey) - count(DISTINCT p_partkey) FROM part UNION ALL SELECT 'row', (SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part))""")
def duplicates(spark, d):
    return aggregates.duplicates(table(spark, d, "part"), ["p_name", "p_partkey"])


@query("number_neighbours", """WITH c AS (SELECT c_custkey AS id, c_nationkey AS b, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS k FROM customer) SELECT id FROM c a WHERE EXISTS (SELECT 1 FROM c x WHERE x.b = a.b AND a.k - x.k BETWEEN 1 AND 13)""")
def number_neighbours(spark, d):
    """Customers with another of their nation 1 to 13 numbers below: a range join on buckets of the reach."""
    from ..operators.joins import range_semi

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("b"), X.as_int(F.regexp_extract("c_name", r"(\d+)$", 1)).alias("k"))
    return range_semi(c, c, "b", "k", 1, 13).select("id")


@query("number_pairs", """WITH x AS (SELECT s_suppkey AS id, [s_suppkey % 7, s_suppkey % 11, s_nationkey]::BIGINT[] AS a, [s_nationkey, s_suppkey % 5]::BIGINT[] AS b FROM supplier)
SELECT id, (a[1] = b[1])::INT::DOUBLE AS first_eq, list_contains(b, a[1])::INT::DOUBLE AS a0_in_b, round(ln(1 + list_min(list_transform(b, lambda v: abs(v - a[1])))), 6) AS mindiff, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jacc FROM x""")
def number_pairs(spark, d):
    n, k = F.col("s_nationkey").cast("bigint"), F.col("s_suppkey")
    f = N.number_features(F.array(k % 7, k % 11, n), F.array(n, k % 5))
    return table(spark, d, "supplier").select(k.alias("id"), f["int_first_eq"].alias("first_eq"), f["int_a0_in_b"].alias("a0_in_b"), F.round(f["int_a0_mindiff"], 6).alias("mindiff"), F.round(f["int_jacc"], 6).alias("jacc"))


@query("unseen_values", "SELECT DISTINCT s_nationkey AS nation FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)")
def unseen_values(spark, d):
    from ..sources.tables import unseen_values as unseen

    return unseen(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), table(spark, d, "customer").filter("c_acctbal > 9950").select(F.col("c_nationkey").alias("nation")), "nation")


@query("set_equality", "SELECT (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) AS missing, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) AS unknown")
def set_equality(spark, d):
    from ..operators.joins import set_difference_counts

    return set_difference_counts(table(spark, d, "nation").select("n_nationkey"), table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")))


@query("shares", "SELECT c_mktsegment AS seg, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1")
def shares(spark, d):
    return aggregates.shares(table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg")), "seg").select("seg", "n", F.round("share", 6).alias("share"))


@query("abbreviation_lookup", """WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), m AS (SELECT lower(p_name) AS n, count(*) AS c FROM part GROUP BY 1), f AS (SELECT unnest(string_split(lower(p_name), ' ')) AS tok FROM part), c AS (SELECT tok, count(*) AS n FROM f GROUP BY tok)
SELECT p_partkey, sum(n)::BIGINT AS weight, count(*) AS words FROM (SELECT p_partkey, unnest(w) AS tok FROM t) JOIN c USING (tok) GROUP BY p_partkey""")
def abbreviation_lookup(spark, d):
    """Token lookup in a small dimension: explode, join, gather again."""
    p = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("w"))
    c = p.select(F.explode("w").alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    return p.select("p_partkey", F.explode(F.array_distinct("w")).alias("tok")).join(c, "tok").groupBy("p_partkey").agg(F.sum("n").alias("weight"), F.count("*").alias("words"))


@query("skew_safe_join", "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def skew_safe_join(spark, d):
    from ..operators.joins import salted_join

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return salted_join(o, c, "k", salts=8).groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("structural_rule", """WITH s AS (SELECT s_suppkey AS sid, s_nationkey AS n, s_suppkey % 20 AS h FROM supplier), c AS (SELECT c_custkey AS rid, c_nationkey AS n, c_custkey % 20 AS h, c_custkey % 3 AS w FROM customer) SELECT rid, sid FROM c JOIN s USING (n, h) WHERE w <> 2""")
def structural_rule(spark, d):
    """Customers and suppliers of one nation as claims with made-up houses; words with a score below 0.1 reject."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 20).alias("h1"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 20).alias("h2"), (F.col("c_custkey") % 3).alias("w"))
    name = F.array(F.lit("trader"), F.concat(F.lit("nation"), F.col("n").cast("string")))
    x = c.join(s, "n").select(
        "rid", "sid", F.col("h1").cast("string").alias("house1"), F.col("h2").cast("string").alias("house2"), F.lit(-1).alias("second1"), F.lit(-1).alias("second2"),
        F.array().cast("array<string>").alias("street1"), F.array().cast("array<string>").alias("words2"), name.alias("name1"), name.alias("name2"), F.element_at(name, 2).alias("rare1"),
        name.alias("full1"), F.concat(name, F.element_at(F.array(F.array().cast("array<string>"), F.array(F.lit("fine")), F.array(F.lit("odd"))), F.col("w").cast("int") + 1)).alias("full2"),
        F.create_map(F.lit("fine"), F.lit(0.5), F.lit("odd"), F.lit(0.01)).alias("z"),
    )
    return rules.structural(x).select("rid", "sid")


@query("rarest_word_negatives", """WITH w AS (SELECT DISTINCT p_partkey AS id, p_brand AS b, unnest(string_split(p_name, ' ')) AS w FROM part), f AS (SELECT b, w, count(*) AS df FROM w GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT id, b, w FROM (SELECT w.*, row_number() OVER (PARTITION BY id ORDER BY df, w) AS rn FROM w JOIN f USING (b, w)) WHERE rn = 1),
x AS (SELECT r.id, w.id AS other, row_number() OVER (PARTITION BY r.id ORDER BY md5(r.id || '|' || w.id), w.id) AS rn FROM r JOIN w USING (b, w) WHERE r.id <> w.id) SELECT id, other FROM x WHERE rn <= 2""")
def rarest_word_negatives(spark, d):
    from ..operators import pairs

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.split("p_name", " ").alias("w"))
    return pairs.rarest_word_negatives(p, "w", 2)


@query("random_negatives", """WITH p AS (SELECT p_partkey AS id, p_brand AS b, ('0x' || substr(md5(p_partkey || '|1'), 1, 8))::BIGINT % 4 AS g1, ('0x' || substr(md5(p_partkey || '|2'), 1, 8))::BIGINT % 4 AS g2 FROM part),
x AS (SELECT a.id, o.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY md5(a.id || '|' || o.id || '|3'), o.id) AS rn FROM p a JOIN p o ON a.b = o.b AND a.g1 = o.g2 AND a.id <> o.id) SELECT id, other FROM x WHERE rn <= 2""")
def random_negatives(spark, d):
    from ..operators import pairs

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"))
    return pairs.random_negatives(p, 2, buckets=4)


LEGAL_SQL = "(SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)"


@query("legal_edits", f"""WITH x AS {LEGAL_SQL}, e AS (SELECT *, len(list_filter(b, lambda w: NOT list_contains(a, w))) AS plus, len(list_filter(a, lambda w: NOT list_contains(b, w))) AS minus FROM x)
SELECT p_partkey, plus::DOUBLE AS legal_added, minus::DOUBLE AS legal_dropped, len(a)::DOUBLE AS legal_a, len(b)::DOUBLE AS legal_b, (plus + minus)::DOUBLE AS legal_xor FROM e""")
def legal_edits(spark, d):
    """Words that one side of a pair has and the other lacks, as of canonical legal forms: the words of a part's name and type."""
    p = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("a"), F.split(F.lower("p_type"), " ").alias("b"))
    return p.select("p_partkey", *[c.alias(n) for n, c in N.legal_edits(F.col("a"), F.col("b")).items()])


@query("word_z_features", """WITH w AS (SELECT lower(p_type) AS t, unnest(list_distinct(string_split(lower(p_type), ' '))) AS w FROM part), c AS (SELECT w, count(*) AS n FROM w GROUP BY w), s AS (SELECT w, (n - m) / m AS z FROM c, (SELECT avg(n) AS m FROM c) WHERE n > m),
x AS (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS w FROM part) SELECT p_partkey, count(*)::DOUBLE AS wa_n, count(z)::DOUBLE AS wa_k, round(min(z), 6) AS wa_min, round(max(z), 6) AS wa_max, round(avg(z), 6) AS wa_mean FROM x LEFT JOIN s USING (w) GROUP BY p_partkey""")
def word_z_features(spark, d):
    """Scores of a part's type words, of which only the more frequent half is known; words of types are a small dimension."""
    p = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_type"), " ").alias("w"))
    c = p.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    mean = c.agg(F.avg("n").alias("m"))
    z = c.join(mean, F.col("n") > F.col("m")).select("w", ((F.col("n") - F.col("m")) / F.col("m")).alias("z"))
    x = p.select("p_partkey", F.explode("w").alias("w")).join(z, "w", "left").groupBy("p_partkey").agg(F.collect_list("w").alias("w"), F.map_from_entries(F.collect_set(F.when(F.col("z").isNotNull(), F.struct("w", "z")))).alias("z"))
    f = N.word_z_features(F.col("w"), F.col("z"), "wa")
    return x.select("p_partkey", *[(c if n in ("wa_n", "wa_k") else F.round(c, 6)).alias(n) for n, c in f.items()])


@query("expanded_names", """SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(lower(p_name), ' '), lambda w: CASE w WHEN 'red' THEN 'rather red' WHEN 'blue' THEN 'sea blue' ELSE w END), lambda w: w NOT IN ('null', 'none', 'nan', 'na')), ' ') AS name FROM part""")
def expanded_names(spark, d):
    """Abbreviations written out by a map; an expansion of two words gives two tokens."""
    words = F.create_map(F.lit("red"), F.lit("rather red"), F.lit("blue"), F.lit("sea blue"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.expand(F.split(F.lower("p_name"), " "), words), " ").alias("name"))


@query("lookup_default", "SELECT c_custkey, coalesce(n_name, 'elsewhere') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON n_nationkey = c_nationkey")
def lookup_default(spark, d):
    """A dimension's value, or a default where it has none."""
    from ..operators.joins import lookup

    n = table(spark, d, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "n_name", "elsewhere").select("c_custkey", "n_name")


@query("edit_features")
def edit_features(spark, d):
    """Words that a part's type adds to its name or lacks of it, typing errors aside, with their document frequency in place of suspicion."""
    from ..operators.features import edit_features as edits

    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("block"), F.split(F.lower("p_name"), " ").alias("a"), F.split(F.lower("p_type"), " ").alias("b"))
    n = p.groupBy("block").agg(F.count("*").alias("n"))
    c = p.select("block", F.explode(F.array_distinct(F.concat("a", "b"))).alias("w")).groupBy("block", "w").agg(F.count("*").alias("c")).join(n, "block")
    stats = c.select("block", F.col("w").alias("token"), (F.col("c") / F.col("n")).alias("susp"), F.log(F.col("c") / F.col("n")).alias("df"))
    out = edits(p, "p_partkey", "a", "b", stats, "block")
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("ed_")])
