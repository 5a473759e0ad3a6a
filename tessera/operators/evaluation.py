"""Evaluation: macro F0.5 and its weighted form, sweeps, recall at k, ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_beta(tp: Column, predicted: Column, true: Column, beta2: float = 0.25) -> Column:
    """F of one entity: without truth 1 if nothing is predicted, else 0; without a hit 0."""
    p, r = tp / predicted, tp / true
    hit = (1 + beta2) * p * r / (beta2 * p + r)
    return F.when(true == 0, F.when(predicted == 0, 1.0).otherwise(0.0)).when(tp == 0, 0.0).otherwise(hit)


def entity_counts(entities: DataFrame, claims: DataFrame, sid: str = "sid", accepted: str = "acc", true: str = "tru", weight: str | None = None) -> DataFrame:
    """Every entity with weighted hits, predictions and truths; those without claims have zeros."""
    w = F.col(weight) if weight else F.lit(1.0)
    a, t = F.col(accepted), F.col(true)
    c = claims.groupBy(sid).agg(
        F.sum(F.when(a & t, 1.0).otherwise(0.0)).alias("tp"),
        F.sum(F.when(a, F.when(t, 1.0).otherwise(w)).otherwise(0.0)).alias("np"),
        F.sum(F.when(t, 1.0).otherwise(0.0)).alias("nt"),
    )
    return entities.select(sid).join(c, sid, "left").na.fill(0.0, ["tp", "np", "nt"])


def macro_f(counts: DataFrame) -> DataFrame:
    """One row: the mean F over all entities, and their number."""
    return counts.agg(F.avg(f_beta(F.col("tp"), F.col("np"), F.col("nt"))).alias("macro_f"), F.count("*").alias("n"))


def sweep(entities: DataFrame, claims: DataFrame, thresholds: list[float], sid: str = "sid", score: str = "p", true: str = "tru") -> DataFrame:
    """Macro F at every threshold. One pass: each claim is aggregated into all thresholds' counts at once."""
    aggs, t, p = [F.sum(F.col(true).cast("double")).alias("nt")], F.col(true), F.col(score)
    for i, x in enumerate(thresholds):
        aggs += [F.sum(F.when((p >= x) & t, 1.0).otherwise(0.0)).alias(f"tp{i}"), F.sum(F.when(p >= x, 1.0).otherwise(0.0)).alias(f"np{i}")]
    c = entities.select(sid).join(claims.groupBy(sid).agg(*aggs), sid, "left").na.fill(0.0)
    row = c.agg(*[F.avg(f_beta(F.col(f"tp{i}"), F.col(f"np{i}"), F.col("nt"))).alias(f"f{i}") for i in range(len(thresholds))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"f{i}").alias("macro_f")) for i, x in enumerate(thresholds)])).alias("r")).select("r.*")


def recall_at(ranked: DataFrame, truth: DataFrame, ks: list[int], entity: str = "sid", record: str = "rid", rank: str = "rank") -> DataFrame:
    """Per k: share of true pairs found, and of entities with all found. ``rank`` counts from 0; the least over views counts."""
    best = ranked.groupBy(entity, record).agg(F.min(rank).alias("r"))
    t = truth.select(entity, record).join(best, [entity, record], "left")
    per = t.groupBy(entity).agg(F.count("*").alias("n"), *[F.count_if(F.col("r") < k).alias(f"h{k}") for k in ks])
    row = per.agg(*[F.struct((F.sum(f"h{k}") / F.sum("n")).alias("recall"), F.avg((F.col(f"h{k}") == F.col("n")).cast("double")).alias("all_found")).alias(f"k{k}") for k in ks])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}.recall").alias("recall"), F.col(f"k{k}.all_found").alias("all_found")) for k in ks])).alias("x")).select("x.*")


def auc(d: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve. Ties count half.

    Scores are counted per value first, so the running sum has as many rows as there are values, and it runs over value ranges
    that are summed on their own before.
    """
    v = d.groupBy(score).agg(F.count_if(label).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    v = v.withColumn("b", F.floor(F.col(score) * 64))
    lower = v.groupBy("b").agg(F.sum("neg").alias("bn"))
    before = lower.withColumn("below", F.coalesce(F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "below")
    own = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = v.withColumn("own", own).join(before, "b")
    return x.agg((F.sum(F.col("pos") * (F.col("below") + F.col("own") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def pooled(d: DataFrame, accepted: Column, true: Column, n_true: Column) -> DataFrame:
    """One row: precision and recall over all pairs."""
    tp, n = F.sum((accepted & true).cast("double")), F.sum(accepted.cast("double"))
    return d.agg((tp / n).alias("precision"), (tp / F.max(n_true)).alias("recall"))


def distractor_weight(share: float, n_matched: Column, n_pool: Column) -> Column:
    """The weight that gives unmatched records the share they have where results are judged."""
    return F.floor(share / (1 - share) * n_matched) / n_pool
