"""Classifiers over feature tables: split by a hash of the key, fitted, saved, loaded, and applied to tables and streams alike."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_FEATURES = ["r", "g", "b", "layer_hash", "area", "perimeter", "aspect", "px", "py"]


def part_of(key: Column) -> Column:
    """train (70 %), validation (15 %) or test (15 %), the same on every run."""
    band = F.pmod(F.xxhash64(key), F.lit(100))
    return F.when(band < 70, "train").when(band < 85, "validation").otherwise("test")


def with_corrections(classes: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """classes(key, label) with the label of corrections(key, label) where a user has set one; the last one by name wins if there are several."""
    own = corrections.groupBy(key).agg(F.max("label").alias("_own"))
    return classes.join(own, key, "left").withColumn("label", F.coalesce("_own", "label")).drop("_own")


def fitted(samples: DataFrame, features: list[str], hidden: int = 24, rounds: int = 120) -> PipelineModel:
    """samples(features..., label string) -> a pipeline that adds `said`: features assembled and scaled, a perceptron with one hidden layer.
    Rows without a label, or with a null feature, are left out."""
    rows = samples.select(*(F.col(c).cast("double").alias(c) for c in features), "label").dropna()
    labels = StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    steps = [
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        MultilayerPerceptronClassifier(featuresCol="_scaled", labelCol="_label", predictionCol="_said", probabilityCol="_probability", rawPredictionCol="_votes", layers=[len(features), hidden, max(2, len(labels.labels))], maxIter=rounds, seed=5),
    ]
    model = Pipeline(stages=steps).fit(labels.transform(rows))
    return PipelineModel(stages=[*model.stages, IndexToString(inputCol="_said", outputCol="said", labels=labels.labels)])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def applied(rows: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    """rows, of a table or a stream, with `said`; rows with a null feature are left out."""
    ready = rows.withColumns({c: F.col(c).cast("double") for c in features})
    return model.transform(ready).drop("_raw", "_scaled", "_votes", "_probability", "_said")


def confusion(rows: DataFrame) -> DataFrame:
    """rows(label, said) -> label, said, n."""
    return rows.groupBy("label", "said").agg(F.count(F.lit(1)).alias("n"))
