"""The entity classifier: held-out confusion, saving, streams, rows without features."""

import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planfold.operators import learning
from planfold.plans import checks
from planfold.sources.fixtures import Views


@pytest.fixture(scope="module")
def samples(spark, sf):
    return checks.entity_samples(Views(spark, sf)).withColumn("part", learning.part_of(F.col("entity_id"))).cache()


@pytest.fixture(scope="module")
def model(samples):
    return learning.fitted(samples.where("part = 'train'"), learning.ENTITY_FEATURES)


def test_labels_are_no_function_of_the_features(samples):
    seen = samples.groupBy("layer_hash").agg(F.countDistinct("label").alias("n"))
    assert seen.where("n < 3").count() == 0


def test_held_out_confusion(samples, model):
    """A tenth of the labels is a user's word against the rules, and those can't be foreseen: of the rest nearly all must be right."""
    found = learning.confusion(learning.applied(samples.where("part = 'test'"), model, learning.ENTITY_FEATURES)).collect()
    n = sum(r.n for r in found)
    right = sum(r.n for r in found if r.label == r.said)
    most = max(Counter({r.label: 0 for r in found} | {k: sum(r.n for r in found if r.label == k) for k in {r.label for r in found}}).values())
    assert n == samples.where("part = 'test'").count() > 500
    assert right / n > 0.85 > most / n


def test_saved_model_scores_a_stream(spark, samples, model):
    path, source, out, check = (tempfile.mkdtemp(prefix="planfold-test-") for _ in range(4))
    learning.save(model, f"{path}/m")
    rows = samples.where("part = 'test'").drop("part")
    rows.write.mode("overwrite").parquet(source)
    loaded = learning.load(f"{path}/m")
    stream = learning.applied(spark.readStream.schema(rows.schema).parquet(source), loaded, learning.ENTITY_FEATURES)
    query = stream.select("entity_id", "said").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {r.entity_id: r.said for r in spark.read.parquet(out).collect()}
    assert got == {r.entity_id: r.said for r in learning.applied(rows, model, learning.ENTITY_FEATURES).collect()}


def test_rows_without_features_or_labels(spark, model):
    features = ", ".join(f"{c} double" for c in learning.ENTITY_FEATURES)
    whole, holed = (1.0,) * 9, (None, *(1.0,) * 8)
    rows = spark.createDataFrame([(1, *whole), (2, *holed)], f"entity_id long, {features}")
    assert [r.entity_id for r in learning.applied(rows, model, learning.ENTITY_FEATURES).collect()] == [1]
    few = spark.createDataFrame([(*whole, "a"), (*holed, "b"), (*whole, None), ((2.0,) * 9)[:9] + ("b",)], f"{features}, label string")
    assert {r.said for r in learning.applied(few, learning.fitted(few, learning.ENTITY_FEATURES), learning.ENTITY_FEATURES).collect()} <= {"a", "b"}


def test_corrections_win(spark):
    classes = spark.createDataFrame([(1, "wall"), (2, "wall")], "k long, label string")
    own = spark.createDataFrame([(2, "entrance"), (2, "envelope"), (3, "wall")], "k long, label string")
    assert {r.k: r.label for r in learning.with_corrections(classes, own, "k").collect()} == {1: "wall", 2: "envelope"}
