"""Queries on claims: ``lineitem`` rows as records that claim an order.

sid = l_orderkey, p = l_quantity / 50, src from l_linestatus, number = l_suppkey, truth = l_returnflag 'R', entities = orders.
The record id joins the four columns that identify a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import decide, evaluation, rules, windows
from ..registry import query
from ..session import table

CLAIMS = """c AS (SELECT l_orderkey AS sid, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid, l_quantity / 50 AS p,
  CASE WHEN l_linestatus = 'O' THEN 'S3' ELSE 'S2' END AS src, l_suppkey AS kr, l_returnflag = 'R' AS tru, 1 + l_tax AS wt, l_discount AS disc, l_shipdate AS ship FROM lineitem)"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("sid"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
        (F.col("l_quantity") / 50).alias("p"),
        F.when(F.col("l_linestatus") == "O", "S3").otherwise("S2").alias("src"),
        F.col("l_suppkey").alias("kr"),
        (F.col("l_returnflag") == "R").alias("tru"),
        (1 + F.col("l_tax")).alias("wt"),
        F.col("l_discount").alias("disc"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"))


@query("entity_context", f"""WITH {CLAIMS},
r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY p DESC, rid) AS rn FROM c),
x AS (SELECT *, CASE WHEN rn = 1 THEN nth_value(p, 2) OVER (PARTITION BY sid ORDER BY p DESC, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE max(p) OVER (PARTITION BY sid) END AS om FROM r)
SELECT rid, (count(*) OVER w - 1)::BIGINT AS e_n, (sum((p >= .9)::INT) OVER w - (p >= .9)::INT)::BIGINT AS e_ge90, (sum((p >= .5)::INT) OVER w - (p >= .5)::INT)::BIGINT AS e_ge50,
 (sum((p >= .2)::INT) OVER w - (p >= .2)::INT)::BIGINT AS e_ge20, round(sum(p) OVER w - p, 6) AS e_sum, round(coalesce(om, 0), 6) AS e_max_other, (rn - 1)::BIGINT AS e_rank,
 (sum((p >= .5)::INT) OVER (PARTITION BY sid, src) - (p >= .5)::INT)::BIGINT AS e_ge50_same_src,
 (sum((p >= .5)::INT) OVER w - sum((p >= .5)::INT) OVER (PARTITION BY sid, src))::BIGINT AS e_ge50_other_src FROM x WINDOW w AS (PARTITION BY sid)""")
def entity_context(spark, d):
    x = windows.entity_context(claims(spark, d))
    return x.select("rid", "e_n", "e_ge90", "e_ge50", "e_ge20", F.round("e_sum", 6).alias("e_sum"), F.round("e_max_other", 6).alias("e_max_other"), "e_rank", "e_ge50_same_src", "e_ge50_other_src")


@query("number_peers", f"""WITH {CLAIMS}, k AS (SELECT *, CASE WHEN kr % 5 = 0 THEN -1 ELSE kr % 7 END AS k2 FROM c),
x AS (SELECT *, row_number() OVER (PARTITION BY sid, k2 ORDER BY p DESC, rid) AS rn, nth_value(p, 2) OVER (PARTITION BY sid, k2 ORDER BY p DESC, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p2 FROM k),
n AS (SELECT sid, count(DISTINCT k2) FILTER (k2 >= 0) AS keys FROM k GROUP BY sid)
SELECT rid, CASE WHEN k2 >= 0 THEN (count(*) OVER w - 1)::DOUBLE END AS e_np_n, CASE WHEN k2 >= 0 THEN round(CASE WHEN rn = 1 THEN p2 ELSE max(p) OVER w END, 6) END AS e_np_max,
 CASE WHEN k2 >= 0 THEN round(sum(p) OVER w - p, 6) END AS e_np_sum, keys AS e_np_keys FROM x JOIN n USING (sid) WINDOW w AS (PARTITION BY sid, k2)""")
def number_peers(spark, d):
    c = claims(spark, d).withColumn("kr", F.when(F.col("kr") % 5 == 0, -1).otherwise(F.col("kr") % 7))
    x = windows.number_peers(c)
    return x.select("rid", F.col("e_np_n").cast("double").alias("e_np_n"), F.round("e_np_max", 6).alias("e_np_max"), F.round("e_np_sum", 6).alias("e_np_sum"), "e_np_keys")


@query("macro_f", f"""WITH {CLAIMS}, g AS (SELECT sid, sum((p >= .6 AND tru)::INT)::DOUBLE AS tp, sum((p >= .6)::INT)::DOUBLE AS np, sum(tru::INT)::DOUBLE AS nt FROM c GROUP BY sid),
e AS (SELECT coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM (SELECT DISTINCT o_orderkey AS sid FROM orders) LEFT JOIN g USING (sid))
SELECT round(avg(CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1 ELSE 0 END WHEN tp = 0 THEN 0 ELSE 1.25 * (tp/np) * (tp/nt) / (.25 * tp/np + tp/nt) END), 6) AS macro_f, count(*) AS n FROM e""")
def macro_f(spark, d):
    c = claims(spark, d).withColumn("acc", F.col("p") >= 0.6)
    return evaluation.macro_f(evaluation.entity_counts(entities(spark, d), c)).select(F.round("macro_f", 6).alias("macro_f"), "n")


@query("weighted_macro_f", f"""WITH {CLAIMS}, g AS (SELECT sid, sum((p >= .6 AND tru)::INT)::DOUBLE AS tp, sum(CASE WHEN p >= .6 THEN CASE WHEN tru THEN 1 ELSE wt END ELSE 0 END) AS np, sum(tru::INT)::DOUBLE AS nt FROM c GROUP BY sid),
e AS (SELECT coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM orders LEFT JOIN g ON sid = o_orderkey)
SELECT round(avg(CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1 ELSE 0 END WHEN tp = 0 THEN 0 ELSE 1.25 * (tp/np) * (tp/nt) / (.25 * tp/np + tp/nt) END), 6) AS macro_f, count(*) AS n FROM e""")
def weighted_macro_f(spark, d):
    c = claims(spark, d).withColumn("acc", F.col("p") >= 0.6)
    return evaluation.macro_f(evaluation.entity_counts(entities(spark, d), c, weight="wt")).select(F.round("macro_f", 6).alias("macro_f"), "n")


@query("threshold_sweep", f"""WITH {CLAIMS}, t AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold),
g AS (SELECT threshold, sid, sum((p >= threshold AND tru)::INT)::DOUBLE AS tp, sum((p >= threshold)::INT)::DOUBLE AS np, sum(tru::INT)::DOUBLE AS nt FROM c, t GROUP BY ALL),
e AS (SELECT t.threshold, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM orders CROSS JOIN t LEFT JOIN g ON g.sid = o_orderkey AND g.threshold = t.threshold)
SELECT threshold, round(avg(CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1 ELSE 0 END WHEN tp = 0 THEN 0 ELSE 1.25 * (tp/np) * (tp/nt) / (.25 * tp/np + tp/nt) END), 6) AS macro_f FROM e GROUP BY threshold""")
def threshold_sweep(spark, d):
    return evaluation.sweep(entities(spark, d), claims(spark, d), [0.3, 0.5, 0.7, 0.9]).select("threshold", F.round("macro_f", 6).alias("macro_f"))


@query("auc", f"""WITH {CLAIMS}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS rn FROM c), m AS (SELECT p, avg(rn) AS rk FROM r GROUP BY p),
x AS (SELECT sum(rk) FILTER (tru) AS s, count(*) FILTER (tru) AS np, count(*) FILTER (NOT tru) AS nn FROM c JOIN m USING (p))
SELECT round((s - np * (np + 1) / 2) / (np * nn::DOUBLE), 6) AS auc FROM x""")
def auc(spark, d):
    return evaluation.auc(claims(spark, d), "p", "tru").select(F.round("auc", 6).alias("auc"))


@query("per_group_sweep", """WITH s AS (SELECT DISTINCT o_orderkey AS sid, o_orderpriority AS grp FROM orders), t AS (SELECT unnest([0.5, 0.8])::DOUBLE AS threshold),
n AS (SELECT threshold, grp, sid, count(l_orderkey) FILTER (l_quantity / 50 >= threshold) AS m FROM s CROSS JOIN t LEFT JOIN lineitem ON l_orderkey = sid GROUP BY ALL)
SELECT grp, threshold, count(*) AS entities, round(avg((m = 0)::INT), 6) AS empty_share, round(avg(m), 6) AS matches FROM n GROUP BY ALL""")
def per_group_sweep(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_orderpriority").alias("grp"))
    levels = [0.5, 0.8]
    m = claims(spark, d).groupBy("sid").agg(*[F.count_if(F.col("p") >= t).alias(f"m{i}") for i, t in enumerate(levels)])
    x = s.join(m, "sid", "left").na.fill(0)
    row = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"m{i}").alias("m")) for i, t in enumerate(levels)])).alias("r")
    x = x.select("grp", row).select("grp", "r.*")
    return x.groupBy("grp", "threshold").agg(F.count("*").alias("entities"), F.round(F.avg((F.col("m") == 0).cast("double")), 6).alias("empty_share"), F.round(F.avg("m"), 6).alias("matches"))


@query("assign_argmax", f"""WITH {CLAIMS}, r AS (SELECT sid, rid, p, row_number() OVER (PARTITION BY kr, sid % 1000 ORDER BY p DESC, rid) AS rn, kr, sid % 1000 AS b FROM c)
SELECT kr, b, rid, round(p, 6) AS p FROM r WHERE rn = 1 AND p >= .8""")
def assign_argmax(spark, d):
    c = claims(spark, d).withColumn("b", F.col("sid") % 1000).withColumn("g", F.struct("kr", "b"))
    return decide.assign_by_rank(c, 0.8, rid="g", sid="rid").select("kr", "b", "rid", F.round("p", 6).alias("p"))


@query("best_per_entity", f"WITH {CLAIMS} SELECT sid, max(p) AS p, (arg_max(rid, (p, -kr))) AS rid FROM (SELECT sid, p, kr, min(rid) AS rid FROM c GROUP BY ALL) GROUP BY sid")
def best_per_entity(spark, d):
    c = claims(spark, d).groupBy("sid", "p", "kr").agg(F.min("rid").alias("rid"))
    best = c.groupBy("sid").agg(F.max("p").alias("p"), F.max_by("rid", F.struct("p", (-F.col("kr")).alias("k"))).alias("rid"))
    return best.select("sid", "p", "rid")


@query("override_lists", f"""WITH {CLAIMS} SELECT sid, rid, CASE WHEN disc >= .09 THEN 0.0 WHEN disc <= .01 THEN 1.0 ELSE p END AS q FROM c""")
def override_lists(spark, d):
    c = claims(spark, d).withColumn("q", F.col("p"))
    return decide.override(c, c.filter("disc <= 0.01"), c.filter("disc >= 0.09")).select("sid", "rid", "q")


@query("agreement_veto", f"""WITH {CLAIMS}, a AS (SELECT kr AS rid, arg_max(sid, (p, -sid)) AS sid, max(p) AS q FROM c GROUP BY kr),
b AS (SELECT kr AS rid, arg_max(sid, (p, -sid)) AS sid, max(p) * .9 AS q FROM c WHERE disc > .02 GROUP BY kr)
SELECT a.rid, a.sid, round(CASE WHEN a.sid = b.sid THEN least(a.q, b.q) ELSE 0 END, 6) AS q FROM a LEFT JOIN b USING (rid)""")
def agreement_veto(spark, d):
    def top(c, scale):
        t = c.groupBy(F.col("kr").alias("rid")).agg(F.max_by("sid", F.struct("p", (-F.col("sid")).alias("n"))).alias("sid"), (F.max("p") * scale).alias("q"))
        return t

    c = claims(spark, d)
    return decide.veto(top(c, 1.0), top(c.filter("disc > 0.02"), 0.9)).select("rid", "sid", F.round("q", 6).alias("q"))


@query("number_veto", f"""WITH {CLAIMS}, o AS (SELECT sid, min(kr) AS ks FROM c GROUP BY sid), x AS (SELECT c.sid, rid, kr % 20 AS kr, ks % 20 AS ks, p AS q FROM c JOIN o USING (sid)),
y AS (SELECT *, q >= .3 AND kr <> ks AND abs(kr - ks) <= 6 AS s FROM x), z AS (SELECT *, sum(s::INT) OVER (PARTITION BY sid, kr) AS n FROM y)
SELECT sid, rid, CASE WHEN s AND n >= 2 THEN 0.0 ELSE q END AS q FROM z""")
def number_veto(spark, d):
    c = claims(spark, d)
    x = c.withColumn("ks", F.min("kr").over(Window.partitionBy("sid")) % 20).withColumn("kr", F.col("kr") % 20).withColumn("q", F.col("p"))
    return decide.number_veto(x, 0.3, 6).select("sid", "rid", "q")


@query("group_thresholds", f"""WITH {CLAIMS} SELECT src, count(*) AS n FROM c WHERE p >= CASE src WHEN 'S3' THEN .5 ELSE .8 END GROUP BY src""")
def group_thresholds(spark, d):
    return decide.group_threshold(claims(spark, d), "src", {"S3": 0.5}, 0.8, score="p").groupBy("src").agg(F.count("*").alias("n"))


@query("final_assembly", f"""WITH {CLAIMS}, m AS (SELECT rid, sid, p AS q, src AS country, disc FROM c),
v AS (SELECT rid, sid, CASE WHEN disc = .05 THEN 0 ELSE least(q, q * .95) END AS q, country, disc FROM m),
o AS (SELECT rid, sid, CASE WHEN disc >= .09 THEN 0.0 WHEN disc <= .01 THEN 1.0 ELSE q END AS q, country FROM v)
SELECT rid, sid, round(q, 6) AS q FROM o WHERE q >= CASE country WHEN 'S3' THEN .5 ELSE .7 END""")
def final_assembly(spark, d):
    m = claims(spark, d).select("rid", "sid", F.col("p").alias("q"), F.col("src").alias("country"), "disc")
    second = m.filter("disc != 0.05").select("rid", "sid", (F.col("q") * 0.95).alias("q"))
    out = decide.assemble(m, [second], m.filter("disc <= 0.01").select("rid", "sid"), m.filter("disc >= 0.09").select("rid", "sid"), 0.7, {"S3": 0.5})
    return out.select("rid", "sid", F.round("q", 6).alias("q"))


@query("restore_empty", f"""WITH {CLAIMS}, a AS (SELECT DISTINCT sid FROM c WHERE p >= .9), r AS (SELECT c.*, row_number() OVER (PARTITION BY c.sid ORDER BY p DESC, rid) AS rn FROM c WHERE p >= .4 AND sid NOT IN (SELECT sid FROM a) AND NOT (src = 'S3' AND coalesce(CASE WHEN disc <> .03 THEN disc - .05 END <= 0, false)))
SELECT rid, sid FROM r WHERE rn = 1""")
def restore_empty(spark, d):
    c = claims(spark, d).withColumn("llm", F.when(F.col("disc") != 0.03, F.col("disc") - 0.05))
    return rules.restore_empty(c, accepted=0.9, floor=0.4, unlabelled=F.col("src") == "S3", score="p").select("rid", "sid")


@query("positions", f"""WITH {CLAIMS}, o AS (SELECT sid, min(kr) % 5 AS ks FROM c GROUP BY sid), x AS (SELECT rid, c.sid, CASE WHEN kr % 11 = 0 THEN -1 ELSE kr % 5 END AS kr, ks FROM c JOIN o USING (sid)),
n AS (SELECT sid, kr, count(*) AS n FROM x WHERE kr >= 0 AND ks >= 0 AND kr <> ks GROUP BY sid, kr), m AS (SELECT sid, kr AS dk FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n DESC, kr) AS rn FROM n) WHERE rn = 1),
p AS (SELECT rid, x.sid, CASE WHEN kr < 0 OR ks < 0 THEN 'NONE' WHEN kr = ks THEN 'SAME' WHEN kr = dk THEN 'D' ELSE 'OTHER' END AS pos FROM x LEFT JOIN m USING (sid))
SELECT rid, pos, least(sum((pos IN ('D', 'OTHER'))::INT) OVER (PARTITION BY sid), 4)::BIGINT AS n_d FROM p""")
def positions(spark, d):
    c = claims(spark, d)
    x = c.withColumn("ks", F.min("kr").over(Window.partitionBy("sid")) % 5).withColumn("kr", F.when(F.col("kr") % 11 == 0, -1).otherwise(F.col("kr") % 5))
    return rules.census(rules.positions(x)).select("rid", "pos", "n_d")


@query("word_spread", f"""WITH {CLAIMS}, x AS (SELECT sid, kr % 40 AS w, disc < .02 AS plain FROM c), s AS (SELECT sid, least(count(*), 4) AS nd FROM x GROUP BY sid), y AS (SELECT w, nd, plain FROM x JOIN s USING (sid)),
r AS (SELECT nd, count(*) / sum(count(*)) OVER () AS share FROM y WHERE plain GROUP BY nd), b AS (SELECT unnest(range(0, 5)) AS nd),
q AS (SELECT w, nd, count(*) AS n FROM y WHERE NOT plain GROUP BY w, nd), t AS (SELECT w, sum(n) AS tot FROM q GROUP BY w HAVING sum(n) >= 10)
SELECT t.w, tot::BIGINT AS n, round(sum(abs(coalesce(q.n, 0) / tot - coalesce(r.share, 0))) / 2, 6) AS tv FROM t CROSS JOIN b LEFT JOIN q ON q.w = t.w AND q.nd = b.nd LEFT JOIN r ON r.nd = b.nd GROUP BY t.w, tot""")
def word_spread(spark, d):
    x = claims(spark, d).select("sid", (F.col("kr") % 40).alias("w"), (F.col("disc") < 0.02).alias("plain"))
    x = x.withColumn("n_d", F.least(F.count("*").over(Window.partitionBy("sid")), F.lit(4)))
    return rules.word_spread(x, least=10).select("w", "n", F.round("tv", 6).alias("tv"))


@query("house_word_rate", f"""WITH {CLAIMS}, x AS (SELECT src AS c, kr % 50 AS w, tru AS same FROM c), b AS (SELECT c, avg(same::INT) AS base FROM x GROUP BY c), h AS (SELECT src AS c, avg(tru::INT) AS hi FROM c WHERE disc < .03 GROUP BY src),
r AS (SELECT c, w, count(*) AS n, (sum(same::INT) + 20 * any_value(base)) / (count(*) + 20) AS rate FROM x JOIN b USING (c) GROUP BY c, w HAVING count(*) >= 30),
l AS (SELECT c, quantile_cont(rate, .05) AS lo FROM (SELECT c, rate, unnest(range(n // 100 + 1)) FROM r WHERE n >= 40) GROUP BY c)
SELECT c, w, n, round(rate, 6) AS rate, round(least(greatest((rate - lo) / (hi - lo), -.5), 1.5), 4) AS z FROM r JOIN l USING (c) JOIN h USING (c)""")
def house_word_rate(spark, d):
    c = claims(spark, d)
    x = c.select(F.col("src").alias("c"), (F.col("kr") % 50).alias("w"), F.col("tru").alias("same"))
    hi = c.filter("disc < 0.03").groupBy(F.col("src").alias("c")).agg(F.avg(F.col("tru").cast("double")).alias("hi"))
    out = rules.word_rates(x, hi, pseudo=20, least=30, least_low=40)
    return out.select("c", "w", "n", F.round("rate", 6).alias("rate"), F.round("z", 4).alias("z"))


@query("rate_table", f"""WITH {CLAIMS} SELECT coalesce(src, 'ALL') AS src, CASE WHEN grouping(flag) = 1 THEN 'ALL' ELSE flag END AS flag, count(*) AS n, round(avg(tru::INT), 6) AS r_true, round(avg((p >= .5)::INT), 6) AS r_half
FROM (SELECT *, (disc > .05)::VARCHAR AS flag FROM c) GROUP BY GROUPING SETS ((src, flag), ())""")
def rate_table(spark, d):
    from ..operators import aggregates

    c = claims(spark, d).withColumn("flag", (F.col("disc") > 0.05).cast("string")).withColumn("half", F.col("p") >= 0.5)
    out = aggregates.rate_table(c, ["src", "flag"], {"r_true": "tru", "r_half": "half"})
    return out.select("src", "flag", "n", F.round("r_true", 6).alias("r_true"), F.round("r_half", 6).alias("r_half"))


@query("cluster_shape", f"""WITH {CLAIMS}, g AS (SELECT sid, count(*) FILTER (src = 'S2') AS n2, count(*) FILTER (src = 'S3') AS n3, min(p) AS lo, max(p) AS hi, bool_or(tru) AS any_true, bool_and(tru) AS all_true FROM c GROUP BY sid)
SELECT least(n2, 4) AS n2, least(n3, 4) AS n3, count(*) AS n, round(avg(lo), 6) AS lo, round(avg(hi), 6) AS hi, round(avg(any_true::INT), 6) AS any_true, round(avg(all_true::INT), 6) AS all_true FROM g GROUP BY 1, 2""")
def cluster_shape(spark, d):
    g = claims(spark, d).groupBy("sid").agg(F.count_if(F.col("src") == "S2").alias("n2"), F.count_if(F.col("src") == "S3").alias("n3"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.bool_or("tru").alias("a"), F.bool_and("tru").alias("e"))
    g = g.withColumns({"n2": F.least("n2", F.lit(4)), "n3": F.least("n3", F.lit(4))})
    return g.groupBy("n2", "n3").agg(F.count("*").alias("n"), F.round(F.avg("lo"), 6).alias("lo"), F.round(F.avg("hi"), 6).alias("hi"), F.round(F.avg(F.col("a").cast("double")), 6).alias("any_true"), F.round(F.avg(F.col("e").cast("double")), 6).alias("all_true"))


@query("cross_tab", """SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def cross_tab(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("sole_occupants", f"""WITH {CLAIMS}, s AS (SELECT sid, min(kr) AS n, string_agg(DISTINCT (kr % 3)::VARCHAR, ' ' ORDER BY (kr % 3)::VARCHAR) AS w FROM c GROUP BY sid), x AS (SELECT *, count(*) OVER (PARTITION BY n, w) AS here FROM s)
SELECT sid, here FROM x""")
def sole_occupants(spark, d):
    s = claims(spark, d).groupBy("sid").agg(F.min("kr").alias("n"), F.array_join(F.array_sort(F.collect_set((F.col("kr") % 3).cast("string"))), " ").alias("w"))
    return rules.occupants(s, ["n", "w"]).select("sid", "here")


@query("numeric_scores", f"""WITH {CLAIMS}, x AS (SELECT DISTINCT p FROM c) SELECT p, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS logit, round(1 / (1 + exp(-p)), 6) AS logistic, round(p / (p + (1 - p) * 1.5), 6) AS shifted, least(greatest(p * 3 - 1, -.5), 1.5) AS clipped FROM x""")
def numeric_scores(spark, d):
    x = claims(spark, d).select("p").distinct()
    p = F.col("p")
    return x.select("p", F.round(N.logit(p), 6).alias("logit"), F.round(N.logistic(p), 6).alias("logistic"), F.round(N.prior_shift(p, 1.5), 6).alias("shifted"), N.clip(p * 3 - 1, -0.5, 1.5).alias("clipped"))


@query("expected_f_selection")
def expected_f_selection(spark, d):
    return decide.select_expected_f(claims(spark, d), odds=1.2).select("sid", "rid", "p")


@query("poisson_binomial", f"""WITH {CLAIMS}, t AS (SELECT sid, list(p ORDER BY p DESC, rid)[1:3] AS q FROM c GROUP BY sid HAVING count(*) >= 3)
SELECT sid, round((1-q[1])*(1-q[2])*(1-q[3]), 6) AS p0, round(q[1]*q[2]*q[3], 6) AS p3 FROM t""")
def poisson_binomial(spark, d):
    top = windows.first_per_group(claims(spark, d), "sid", 3, [F.desc("p"), "rid"])
    t = top.groupBy("sid").agg(F.collect_list("p").alias("q")).filter(F.size("q") == 3).withColumn("pmf", N.poisson_binomial(F.col("q")))
    return t.select("sid", F.round(F.element_at("pmf", 1), 6).alias("p0"), F.round(F.element_at("pmf", 4), 6).alias("p3"))


@query("test_like_harness", f"""WITH {CLAIMS}, n AS (SELECT count(*) FILTER (tru) AS m, count(*) FILTER (NOT tru) AS pool FROM c), w AS (SELECT floor(.39 / .61 * m) / pool AS w FROM n),
g AS (SELECT sid, sum((p >= .6 AND tru)::INT)::DOUBLE AS tp, sum(CASE WHEN p >= .6 THEN CASE WHEN tru THEN 1 ELSE w END ELSE 0 END) AS np, sum(tru::INT)::DOUBLE AS nt FROM c, w GROUP BY sid),
e AS (SELECT coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM orders LEFT JOIN g ON sid = o_orderkey)
SELECT round(any_value(w), 6) AS weight, round(avg(CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1 ELSE 0 END WHEN tp = 0 THEN 0 ELSE 1.25 * (tp/np) * (tp/nt) / (.25 * tp/np + tp/nt) END), 6) AS macro_f FROM e, w""")
def test_like_harness(spark, d):
    c = claims(spark, d)
    w = c.agg(evaluation.distractor_weight(0.39, F.count_if("tru"), F.count_if(~F.col("tru"))).alias("w"))
    x = c.crossJoin(F.broadcast(w)).withColumn("acc", F.col("p") >= 0.6)  # one row
    f = evaluation.macro_f(evaluation.entity_counts(entities(spark, d), x, weight="w"))
    return f.crossJoin(F.broadcast(w)).select(F.round("w", 6).alias("weight"), F.round("macro_f", 6).alias("macro_f"))


@query("rule_before_after", f"""WITH {CLAIMS} SELECT src, count(*) AS changed, round(avg(tru::INT), 6) AS precision, count(*) FILTER (p >= .7) AS before, count(*) FILTER (p * .9 >= .7) AS after FROM c WHERE (p >= .7) <> (p * .9 >= .7) GROUP BY src""")
def rule_before_after(spark, d):
    return rules.change_report(claims(spark, d), F.col("p") >= 0.7, F.col("p") * 0.9 >= 0.7, F.col("tru"), "src")


@query("fix_same_address", f"""WITH {CLAIMS}, x AS (SELECT rid, sid, (kr % 40)::VARCHAR AS w, disc, p FROM c), t AS (SELECT DISTINCT (l_suppkey % 40)::VARCHAR AS w FROM lineitem WHERE l_suppkey % 40 < 10), k AS (SELECT DISTINCT (l_suppkey % 40)::VARCHAR AS w FROM lineitem WHERE l_suppkey % 40 >= 30)
SELECT rid, CASE WHEN w IN (SELECT w FROM t) THEN 'restore' WHEN w IN (SELECT w FROM k) THEN 'reject' ELSE 'leave' END AS fix FROM x""")
def fix_same_address(spark, d):
    c = claims(spark, d).withColumn("added", F.array((F.col("kr") % 40).cast("string")))
    true = [str(i) for i in range(10)]
    decoy = [str(i) for i in range(30, 40)]
    return rules.word_fixes(c, "added", true, decoy).select("rid", "fix")


@query("baseline_grid", f"""WITH {CLAIMS}, x AS (SELECT p AS score, p AS name, 1 - disc * 8 AS address, kr % 2 = 0 AS mutual, tru FROM c), t AS (SELECT count(*) FILTER (tru) AS t FROM x),
g AS (SELECT * FROM (VALUES ('cosine', .75, 0), ('both', .5, .6), ('mutual', .5, .6), ('sum', .7, 0)) v(rule, a, b)),
y AS (SELECT rule, a::DOUBLE AS a, b::DOUBLE AS b, count(*) AS accepted, count(*) FILTER (tru) AS h FROM x, g WHERE CASE rule WHEN 'cosine' THEN score >= a WHEN 'both' THEN name >= a AND address >= b WHEN 'mutual' THEN name >= a AND address >= b AND mutual ELSE .4 * name + .6 * address >= a END GROUP BY rule, a, b)
SELECT rule, a, b, accepted, round(h / accepted, 6) AS precision, round(h / t, 6) AS recall FROM y, t""")
def baseline_grid(spark, d):
    x = claims(spark, d).select(F.col("p").alias("score"), F.col("p").alias("name"), (1 - F.col("disc") * 8).alias("address"), (F.col("kr") % 2 == 0).alias("mutual"), "tru")
    out = rules.baseline_grid(x, [("cosine", 0.75, 0), ("both", 0.5, 0.6), ("mutual", 0.5, 0.6), ("sum", 0.7, 0)])
    return out.select("rule", "a", "b", "accepted", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("weak_names", f"""WITH {CLAIMS}, x AS (SELECT src, p * 100 AS name, (1 - disc * 8) * 100 AS address FROM c) SELECT src, round(avg((name < 50)::INT), 6) AS weak_share, round(quantile_cont(address, .5) FILTER (name < 50), 4) AS address_median, round(avg((name < 50 AND address < 50)::INT), 6) AS both_weak FROM x GROUP BY src""")
def weak_names(spark, d):
    x = claims(spark, d).select("src", (F.col("p") * 100).alias("name"), ((1 - F.col("disc") * 8) * 100).alias("address"))
    return rules.weak_names(x, ["src"]).select("src", F.round("weak_share", 6).alias("weak_share"), F.round(F.element_at("address_q", 2), 4).alias("address_median"), F.round("both_weak", 6).alias("both_weak"))


@query("blend_report", f"""WITH {CLAIMS} SELECT src, count(*) FILTER (p > .05 AND p < .95) AS unsure, count(CASE WHEN disc > .05 THEN disc END) AS scored, count(*) FILTER (p >= .7) AS before, count(*) FILTER (p * (1 - disc) >= .7) AS after FROM c GROUP BY src""")
def blend_report(spark, d):
    x = claims(spark, d).withColumns({"after": F.col("p") * (1 - F.col("disc")), "llm": F.when(F.col("disc") > 0.05, F.col("disc"))})
    return rules.blend_report(x, "p", "after", "llm", 0.7, "src")


@query("feature_summary", f"""WITH {CLAIMS} SELECT round(avg(p), 6) AS mean_p, round(stddev_samp(p), 6) AS std_p, min(p) AS min_p, max(p) AS max_p, round(avg(disc), 6) AS mean_disc, round(stddev_samp(disc), 6) AS std_disc FROM c""")
def feature_summary(spark, d):
    return claims(spark, d).agg(F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.stddev_samp("p"), 6).alias("std_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.round(F.avg("disc"), 6).alias("mean_disc"), F.round(F.stddev_samp("disc"), 6).alias("std_disc"))


@query("unjudged_claims", f"""WITH {CLAIMS} SELECT rid, sid FROM c WHERE p BETWEEN .4 AND .6 AND NOT disc > .03""")
def unjudged_claims(spark, d):
    c = claims(spark, d)
    scores = c.select("rid", "sid", F.when(F.col("disc") > 0.03, F.col("disc")).alias("llm"))
    return rules.unjudged(c.filter("p BETWEEN 0.4 AND 0.6"), scores).select("rid", "sid")
