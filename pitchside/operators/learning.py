"""Learners, walk-forward validation and inference with Spark's own models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.operators.histories import fold_of, placed


def features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers are 0."""
    return df.fillna(0.0, columns)


def classifier(df: DataFrame, columns: list[str], label: str = "label") -> PipelineModel:
    """Outcome probabilities by multinomial logistic regression."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), LogisticRegression(featuresCol="x", labelCol=label, maxIter=30, regParam=0.01)]).fit(features(df, columns))


@dataclass
class Boosted:
    """Boosted trees of each outcome against the others; probabilities are scaled to sum to 1."""

    models: list[PipelineModel]

    def transform(self, df: DataFrame) -> DataFrame:
        for i, m in enumerate(self.models):
            df = m.transform(df).withColumn(f"p{i}_", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
        own = [F.col(f"p{i}_") for i in range(len(self.models))]
        p = F.array(*[c / sum(own) for c in own])
        return df.withColumn("p", p).drop(*[f"p{i}_" for i in range(len(own))]).withColumn("prediction", (F.array_position("p", F.array_max("p")) - 1).cast("double"))


def boosted(df: DataFrame, columns: list[str], label: str = "label", classes: int = 3, trees: int = 20, depth: int = 4) -> Boosted:
    """Outcome probabilities by boosted trees; of two outcomes one model, of more one for each."""
    rows = features(df, columns)
    models = []
    for k in range(classes):
        stages = [VectorAssembler(inputCols=columns, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="is_", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=7)]
        models.append(Pipeline(stages=stages).fit(rows.withColumn("is_", (F.col(label) == k).cast("double"))))
    return Boosted(models)


def regressor(df: DataFrame, columns: list[str], label: str = "label", trees: int = 20) -> PipelineModel:
    """A total by boosted trees on squared error."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), GBTRegressor(featuresCol="x", labelCol=label, maxIter=trees, maxDepth=4, stepSize=0.1, seed=7)]).fit(features(df, columns))


def predicted(model: PipelineModel | Boosted, df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the prediction and, of a classifier, the probabilities as an array p."""
    out = model.transform(features(df, columns)).drop("x", "rawPrediction")
    return out.withColumn("p", vector_to_array("probability")).drop("probability") if "probability" in out.columns else out


def multiclass_brier(p: Column, label: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == label).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)


def scores(prediction: Column, label: Column) -> list[Column]:
    """Accuracy of outcomes, and root of the mean squared error of totals."""
    return [F.avg((prediction == label).cast("double")).alias("accuracy"), F.sqrt(F.avg(F.pow(prediction - label, 2))).alias("rmse")]


def walk_forward(df: DataFrame, columns: list[str], day: Column, tie: str, folds: int = 3, label: str = "label", fit=classifier) -> DataFrame:
    """fold, n_train, n_test, brier, accuracy and rmse: each fold is tested on a model of all rows before it.

    One model is fitted for each fold; the rows stay in Spark.
    """
    rows = placed(df, day, tie)
    rows = rows.withColumn("fold_", fold_of(F.col("n_"), folds, F.col("position_")))
    out = None
    for k in range(1, folds + 1):
        train, test = rows.where(F.coalesce("fold_", F.lit(0)) < k), rows.where(F.col("fold_") == k)
        got = predicted(fit(train, columns, label), test, columns)
        accuracy, rmse = scores(F.col("prediction"), F.col(label))
        brier = F.avg(multiclass_brier(F.col("p"), F.col(label))) if "p" in got.columns else F.lit(None).cast("double")
        row = got.agg(F.count(F.lit(1)).alias("n_test"), F.round(brier, 4).alias("brier"), F.round(accuracy, 4).alias("accuracy"), F.round(rmse, 4).alias("rmse"))
        row = row.select(F.lit(k).alias("fold"), F.lit(train.count()).cast("long").alias("n_train"), "n_test", "brier", "accuracy", "rmse")
        out = row if out is None else out.unionByName(row)
    return out
