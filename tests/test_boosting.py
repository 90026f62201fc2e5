"""Boosted trees counted by column are the trees of spark.ml."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from wakeline.operators import boosting, models


def table(spark, n, parts):
    """Features with many values, mostly zeros, few values, negative ones, a copy of another, and one value."""
    i = F.col("id")
    h = F.pmod(F.xxhash64("id"), F.lit(10_007)).cast("double")
    rows = spark.range(n, numPartitions=parts).select(
        array_to_vector(F.array(
            h, F.when(i % 9 == 0, h).otherwise(0.0), (i % 7).cast("double"), F.sin(i), h * 0.5, F.lit(3.0), F.cos(i),
        )).alias("features"),
        (F.floor(h / 10) + 100 * F.sin(i * 0.7) + F.when(i % 500 == 0, 5000).otherwise(0)).alias("y"),
    )
    return rows


def trees(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.trees]


@pytest.mark.parametrize("n, parts", [(12_500, 3), (60, 2), (2, 1)])
def test_trees_are_those_of_spark_ml(spark, monkeypatch, n, parts):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 2_000)
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 700)
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 2)
    rows, booster = table(spark, n, parts), models._booster("y", 5, 4, 0.1)
    got, want = boosting.fit(booster, rows), booster.fit(rows)
    assert trees(got) == trees(want) and len(trees(got)) == 5
    assert got.treeWeights == want.treeWeights and got.numFeatures == want.numFeatures == 7
    assert got.getMaxIter() == 5 and got.featureImportances == want.featureImportances
    both = got.transform(rows).withColumnRenamed("prediction", "p")
    assert want.transform(both.select("features", "p")).where(F.col("p") != F.col("prediction")).count() == 0


def test_differences_of_siblings_give_the_same_predictions(spark, monkeypatch):
    rows, booster = table(spark, 5_000, 2), models._booster("y", 4, 4, 0.1)
    want = [r[0] for r in booster.fit(rows).transform(rows).select("prediction").collect()]
    monkeypatch.setattr(boosting, "EXACT_ROWS", 0)
    counted, sums = [], boosting._counted
    monkeypatch.setattr(boosting, "_counted", lambda level, plan: counted.append((len(level), len(sums(level, plan)))) or sums(level, plan))
    got = [r[0] for r in boosting.fit(booster, rows).transform(rows).select("prediction").collect()]
    assert np.allclose(got, want, rtol=1e-9) and all(few <= (n + 1) // 2 + n % 2 for n, few in counted)
    assert any(few < n for n, few in counted)


def test_without_subsamples(spark):
    rows = table(spark, 400, 2)
    booster = GBTRegressor(featuresCol="features", labelCol="y", maxIter=3, maxDepth=3, seed=7, minInstancesPerNode=20, maxBins=8)
    assert trees(boosting.fit(booster, rows)) == trees(booster.fit(rows))


def test_values_that_spark_ml_refuses(spark):
    rows = table(spark, 60, 2)
    vector = lambda bad: rows.withColumn("features", array_to_vector(F.array(F.lit(bad), "y")))
    label = lambda bad: rows.withColumn("y", F.when(F.col("y") < 100, F.col("y")).otherwise(bad))
    for odd in (vector(float("nan")), vector(float("inf")), label(float("nan")), label(None)):
        with pytest.raises(Exception, match="must not be"):
            boosting.fit(models._booster("y", 2, 2, 0.1), odd)


def test_picks_follow_the_generator_of_spark(spark):
    theirs = spark._jvm.org.apache.spark.util.random.XORShiftRandom(45)
    want = [theirs.nextDouble() < 0.8 for _ in range(3_000)]
    jumps = boosting.Jumps()
    first, state = boosting.picks(boosting.start_state(45), 2_100, 0.8, jumps)
    assert [*first, *boosting.picks(state, 900, 0.8, jumps)[0]] == want


def test_the_post_model_is_not_fitted_row_by_row(spark, monkeypatch):
    # Each level of each tree passed all rows through loops over objects: most of the time of model_forecast.
    fitted, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows: fitted.append(rows.count()) or fit(self, rows))
    posts = spark.range(40).select(
        (F.col("id") % 2).alias("channel_id"), F.col("id").alias("post_id"),
        F.timestamp_seconds(F.col("id") * 90_000).alias("published_at"),
        F.struct(*[(F.col("id") * k % 17).cast("double").alias(c) for k, c in
                   enumerate(("views", "likes", "comments", "shares", "saves"), 3)]).alias("engagement_metrics"),
        F.struct(*[F.lit(0.3).alias(c) for c in ("positive", "neutral", "negative")]).alias("sentiment"),
        F.lit(0).alias("topic_encoded"),
    )
    model = models.train_post_model(posts, rounds=3, depth=2)
    assert fitted == [2] and model.stages[-1].getNumTrees == 3  # two rows of zeros for the layout of a stored model
