"""Queries on models: quality labels of ``documents`` from counts of their text. Fitted models have no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, models, pairs
from ..registry import query
from ..session import table, written

FEATURES = ["n_chars", "n_words", "n_lines", "n_digits", "n_long", "mean_len"]


def labelled(spark, d):
    t = F.col("text")
    words = F.size(F.split(t, r"\s+"))
    x = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.length(t).alias("n_chars"), words.alias("n_words"), F.size(F.split(t, "\n")).alias("n_lines"),
        F.regexp_count(t, F.lit(r"\d")).alias("n_digits"), F.regexp_count(t, F.lit(r"\w{12,}")).alias("n_long"), (F.length(t) / words).alias("mean_len"),
    )
    y = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label"))
    return written(models.design(x.join(y, "id", "left"), FEATURES), "design")


def small(seed: int):
    return models.trees(FEATURES, rounds=5, depth=3, seed=seed)


@query("cross_fitted_scores")
def cross_fitted_scores(spark, d):
    x = labelled(spark, d).filter("label IS NOT NULL")
    return models.cross_fit(x, small, pairs.fold(F.col("id").cast("string")), 2).select("id", "label", F.round("p", 6).alias("p"))


@query("bagged_scores")
def bagged_scores(spark, d):
    x = labelled(spark, d)
    return models.bagged(x.filter("label IS NOT NULL"), x, small, 2).select("id", F.round("p", 6).alias("p"))


@query("blended_scores")
def blended_scores(spark, d):
    x = labelled(spark, d).withColumns({"q": F.least(F.col("n_words") / 1000, F.lit(0.99)), "llm": F.when(F.col("n_digits") > 0, F.col("n_lines") / 10)})
    m = models.logistic_blend(x.filter("label IS NOT NULL"), "q", "llm", "label")
    return models.blended(m, x, "q", "llm").select("id", F.round("blend", 6).alias("blend"))


@query("self_trained_scores")
def self_trained_scores(spark, d):
    x = labelled(spark, d)
    out = models.self_training(x.filter("label IS NOT NULL"), x.filter("label IS NULL"), small, 2, 0.9, 0.1)
    return out.select("id", F.round("p", 6).alias("p"))


@query("feature_importances")
def feature_importances(spark, d):
    m = small(0).fit(labelled(spark, d).filter("label IS NOT NULL"))
    return spark.createDataFrame(models.importances(m, FEATURES), "feature string, importance double")


@query("scorer_auc")
def scorer_auc(spark, d):
    """Ranking quality on folds that the model hasn't seen."""
    x = labelled(spark, d).filter("label IS NOT NULL")
    p = models.cross_fit(x, small, pairs.fold(F.col("id").cast("string")), 2)
    return evaluation.auc(p.withColumn("y", F.col("label") == 1), "p", "y").select(F.round("auc", 6).alias("auc"))
