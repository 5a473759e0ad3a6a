"""Scorers on feature tables: gradient-boosted trees and logistic blends from ``pyspark.ml``, cross-fitted by folds of the id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import logit


def design(df: DataFrame, features: list[str], missing: float = -999.0) -> DataFrame:
    """Feature columns as doubles; a missing value is a number of its own, for trees have no branch for nulls."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in features})


def trees(features: list[str], label: str = "label", weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 0) -> Pipeline:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt])


def probability(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def cross_fit(df: DataFrame, make: Callable[[int], Pipeline], fold: Column, n: int, name: str = "p") -> DataFrame:
    """Every row scored by a model that hasn't seen its fold."""
    df = df.withColumn("fold_", F.pmod(fold, F.lit(n)).cast("int"))
    out = None
    for k in range(n):
        model = make(k).fit(df.filter(F.col("fold_") != k))
        part = probability(model, df.filter(F.col("fold_") == k), name)
        out = part if out is None else out.unionByName(part)
    return out.drop("fold_")


def bagged(train: DataFrame, test: DataFrame, make: Callable[[int], Pipeline], seeds: int, name: str = "p") -> DataFrame:
    """The mean score of models of several seeds."""
    out = test
    for s in range(seeds):
        out = probability(make(s).fit(train), out, f"{name}_{s}")
    return out.withColumn(name, sum((F.col(f"{name}_{s}") for s in range(seeds)), F.lit(0.0)) / seeds).drop(*[f"{name}_{s}" for s in range(seeds)])


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: -x[1])


def logistic_blend(df: DataFrame, score: str, extra: str, label: str, weight: str | None = None) -> PipelineModel:
    """A weighted logistic regression on [logit(score), extra], regularised as strongly as one unit against the summed loss."""
    x = df.filter(F.col(extra).isNotNull()).withColumn("z", logit(F.col(score)))
    total = x.agg(F.sum(weight) if weight else F.count("*").cast("double")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(float(total or 0), 1.0), elasticNetParam=0.0, standardization=False)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=["z", extra], outputCol="features"), lr]).fit(x)


def blended(model: PipelineModel, df: DataFrame, score: str, extra: str) -> DataFrame:
    """Blended scores where there is an extra one, the old score elsewhere."""
    x = df.withColumn("z", logit(F.col(score)))
    has = probability(model, x.filter(F.col(extra).isNotNull()), "blend").drop("z")
    rest = x.filter(F.col(extra).isNull()).withColumn("blend", F.col(score)).drop("z")
    return has.unionByName(rest)


def self_training(labelled: DataFrame, unlabelled: DataFrame, make: Callable[[int], Pipeline], rounds: int, high: float, low: float, label: str = "label") -> DataFrame:
    """Scores of unlabelled rows after rounds that add the surest of them as labels; each round vetoes the one before by the
    lesser score."""
    train, out = labelled, None
    cols = labelled.columns
    for r in range(rounds):
        scored = probability(make(r).fit(train), unlabelled, "p")
        out = scored if out is None else scored.join(out.select("id", F.col("p").alias("p0")), "id").withColumn("p", F.least("p", "p0")).drop("p0")
        sure = out.filter((F.col("p") >= high) | (F.col("p") <= low)).withColumn(label, (F.col("p") >= high).cast("double"))
        train = labelled.unionByName(sure.select(*cols))
    return out


def with_external_score(df: DataFrame, scores: DataFrame, keys: list[str], name: str, low: float, high: float, base: str = "q") -> DataFrame:
    """A score from outside (cross-encoder, judge), null outside the band of the base score where it isn't asked for."""
    x = df.join(scores.select(*keys, name), keys, "left")
    return x.withColumn(name, F.when((F.col(base) > low) & (F.col(base) < high), F.col(name)))
