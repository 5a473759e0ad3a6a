"""Queries on candidate pairs: (part, supplier) of ``lineitem``, scored by their share of the part's sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from ..registry import query
from ..session import table

CANDS = """g AS (SELECT l_partkey AS rid, l_suppkey AS sid, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1, 2), cand AS (SELECT rid, sid, s / 399989 AS score FROM g)"""


def candidates(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("rid"), F.col("l_suppkey").alias("sid")).agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    return g.select("rid", "sid", (F.col("s") / 399989).alias("score"))


@query("retrieval_features", f"""WITH {CANDS}, x AS (SELECT *, max(score) OVER (PARTITION BY rid) AS top1, lead(score) OVER (PARTITION BY rid ORDER BY score DESC, sid) AS nxt, row_number() OVER (PARTITION BY rid ORDER BY score DESC, sid) - 1 AS rank FROM cand),
e AS (SELECT *, exp((score - top1) / .05) AS e FROM x)
SELECT rid, sid, rank, round(top1 - score, 6) AS gap_top1, round(score - coalesce(nxt, -1), 6) AS gap_next, sum((score >= top1 - .02)::INT) OVER w::BIGINT AS n02, sum((score >= top1 - .05)::INT) OVER w::BIGINT AS n05,
 sum((score >= top1 - .1)::INT) OVER w::BIGINT AS n10, round(e / sum(e) OVER w, 6) AS soft FROM e WINDOW w AS (PARTITION BY rid)""")
def retrieval_features(spark, d):
    x = windows.retrieval_features(candidates(spark, d))
    return x.select("rid", "sid", "rank", F.round("gap_top1", 6).alias("gap_top1"), F.round("gap_next", 6).alias("gap_next"), "n02", "n05", "n10", F.round("soft", 6).alias("soft"))


@query("entity_ranks", f"""WITH {CANDS}, x AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, sid) - 1 AS rank FROM cand)
SELECT rid, sid, row_number() OVER (PARTITION BY sid ORDER BY score DESC, rid) - 1 AS s1_rank, count(*) OVER (PARTITION BY sid) AS s1_nref, sum((rank = 0)::INT) OVER (PARTITION BY sid)::BIGINT AS s1_ntop FROM x""")
def entity_ranks(spark, d):
    c = candidates(spark, d)
    x = windows.entity_ranks(c.withColumn("rank", windows.rank_in("rid", "score", ["sid"])))
    return x.select("rid", "sid", "s1_rank", "s1_nref", "s1_ntop")


@query("best_rows", f"""WITH {CANDS}, x AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS p2, sum((score >= .2)::INT) OVER (PARTITION BY rid)::BIGINT AS rec_n20 FROM cand WINDOW w AS (PARTITION BY rid ORDER BY score DESC, sid))
SELECT rid, sid, round(score, 6) AS p, round(p2, 6) AS p2, rec_n20, round(score - p2, 6) AS margin FROM x WHERE rn = 1""")
def best_rows(spark, d):
    x = windows.best_rows(candidates(spark, d), score="score")
    return x.select("rid", "sid", F.round("score", 6).alias("p"), F.round("p2", 6).alias("p2"), "rec_n20", F.round("margin", 6).alias("margin"))


@query("scorer_context", f"""WITH {CANDS}, z AS (SELECT rid, sid, CASE WHEN sid % 13 = 0 THEN -20.0 ELSE score * 4 - 1 END AS ce FROM cand),
x AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY ce DESC, sid) AS rn, nth_value(ce, 2) OVER (PARTITION BY rid ORDER BY ce DESC, sid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c2, max(ce) OVER (PARTITION BY rid) AS m FROM z)
SELECT rid, sid, rn - 1 AS ce_rank, round(ce - CASE WHEN rn = 1 THEN c2 ELSE m END, 6) AS ce_gap, row_number() OVER (PARTITION BY sid ORDER BY ce DESC, rid) - 1 AS ce_s1_rank, (sum((ce > 0)::INT) OVER (PARTITION BY sid) - (ce > 0)::INT)::BIGINT AS ce_s1_pos FROM x""")
def scorer_context(spark, d):
    c = candidates(spark, d).withColumn("ce", F.when(F.col("sid") % 13 != 0, F.col("score") * 4 - 1))
    x = windows.scorer_context(c)
    return x.select("rid", "sid", "ce_rank", F.round("ce_gap", 6).alias("ce_gap"), "ce_s1_rank", "ce_s1_pos")


def _shortlist(name: str, rule: str, keep: str):
    @query(name, f"""WITH {CANDS}, x AS (SELECT *, max(score) OVER (PARTITION BY rid) AS top, row_number() OVER (PARTITION BY rid ORDER BY score DESC, sid) AS rn FROM cand),
e AS (SELECT *, exp((score - top) / .05) AS e FROM x), f AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY rid ORDER BY score DESC, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(e) OVER (PARTITION BY rid) AS before FROM e)
SELECT rid, sid FROM f WHERE {keep}""")
    def run(spark, d):
        return windows.shortlist(candidates(spark, d), rule).select("rid", "sid")

    return run


shortlist_top = _shortlist("shortlist_top", "top:3", "rn <= 3")
shortlist_gap = _shortlist("shortlist_gap", "gap:0.1", "top - score <= .1")
shortlist_softmax = _shortlist("shortlist_softmax", "softmax:0.05:0.8", "before < .8")


@query("shortlist_study", f"""WITH {CANDS}, m AS (SELECT rid, sid, score, max(score) OVER (PARTITION BY rid) AS top FROM cand), t AS (SELECT unnest([.02, .1, .5])::DOUBLE AS tau), r AS (SELECT count(DISTINCT rid) AS n, count(DISTINCT sid) AS ns FROM cand)
SELECT tau, round(count(*) / any_value(n), 6) AS per_record, round(count(*) / any_value(ns), 6) AS per_entity, count(DISTINCT rid) AS records FROM m, t, r WHERE top - score <= tau GROUP BY tau""")
def shortlist_study(spark, d):
    x = windows.retrieval_features(candidates(spark, d))
    taus = [0.02, 0.1, 0.5]
    base = x.agg(F.countDistinct("rid").alias("n"), F.countDistinct("sid").alias("ns"), *[F.count_if(F.col("gap_top1") <= t).alias(f"c{i}") for i, t in enumerate(taus)], *[F.countDistinct(F.when(F.col("gap_top1") <= t, F.col("rid"))).alias(f"r{i}") for i, t in enumerate(taus)])
    row = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.round(F.col(f"c{i}") / F.col("n"), 6).alias("per_record"), F.round(F.col(f"c{i}") / F.col("ns"), 6).alias("per_entity"), F.col(f"r{i}").alias("records")) for i, t in enumerate(taus)])).alias("r")
    return base.select(row).select("r.*")


@query("pseudo_labels", f"""WITH {CANDS}, x AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, sid) - 1 AS rank FROM cand), b AS (SELECT rid, sid, score FROM x WHERE rank = 0),
u AS (SELECT x.rid, x.sid, (x.sid = b.sid AND b.score >= .3)::INT AS y FROM x JOIN b USING (rid) WHERE rank < 5 AND (b.score >= .3 OR b.score <= .1))
SELECT DISTINCT rid, sid, y FROM u""")
def pseudo_labels(spark, d):
    from ..operators import pairs

    return pairs.pseudo_labels(candidates(spark, d), high=0.3, low=0.1, top=5)


CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(rid::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"


@query("hash_folds", f"WITH {CANDS}, r AS (SELECT rid, count(*) AS n FROM cand GROUP BY rid) SELECT rid, n, ({CRC} % 10)::INT AS fold FROM r")
def hash_folds(spark, d):
    from ..operators import pairs

    return candidates(spark, d).groupBy("rid").agg(F.count("*").alias("n")).withColumn("fold", pairs.fold(F.col("rid").cast("string")))


@query("negative_samples", """WITH p AS (SELECT p_partkey AS id, p_brand AS b, p_name AS n FROM part), x AS (SELECT a.id AS id, c.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY (a.id * 7919 + c.id * 104729) % 10007, c.id) AS rn FROM p a JOIN p c ON a.b = c.b AND a.n <> c.n)
SELECT id, other FROM x WHERE rn <= 2""")
def negative_samples(spark, d):
    from ..operators import pairs

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.col("p_name").alias("name"))
    return pairs.negatives(p, k=2)


@query("record_folds", f"""WITH {CANDS}, o AS (SELECT rid AS r, arg_min(sid, (-score, sid)) AS s FROM cand GROUP BY rid), r AS (SELECT r, CASE WHEN r % 2 = 0 THEN s ELSE r END AS rid FROM o) SELECT r AS rid, ({CRC} % 10)::INT AS fold FROM r""")
def record_folds(spark, d):
    """The fold of the owner, here for even records their best entity; of the others that of their own id."""
    from ..operators import pairs

    best = candidates(spark, d).withColumn("rn", F.row_number().over(windows.best_first("rid", "score", ["sid"]))).filter("rn = 1")
    own = best.select("rid", F.col("sid").alias("owner")).filter("rid % 2 = 0")
    return pairs.record_folds(best.select("rid"), own, best.select("rid", "sid").limit(0))
