"""Distributed gradient-boosted models: post engagement and account growth."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import growth_velocity
from ..session import at_most, settled
from . import boosting
from .features import FEATURE_COLUMNS, feature_matrix
from .upsert import sentiment_block

GROWTH_FEATURES = ["subscriber_count", "positive_pct", "neutral_pct", "negative_pct", "total_comments_analyzed"]


class AlignedFeatures(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The training columns in their order as one vector; a column the table lacks, or a NULL, is 0.

    Saved with the model, so a table of any shape and column order can be scored later. All other columns stay as
    they are."""

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, outputCol: str | None = None):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getInputCols()
        have = set(dataset.columns)
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in names]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*filled)))


def _booster(target: str, rounds: int, depth: int, rate: float) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol=target, lossType="squared", maxIter=rounds, maxDepth=depth, stepSize=rate,
        subsamplingRate=0.8, seed=42,
    )


def _varying(vectors: DataFrame, column: str) -> list[int]:
    """Indices of the features with more than one value (all, if none has).

    No tree can split on the others, yet every pass over the rows would count them. A feature with NaN has a NaN variance
    and stays."""
    s = vectors.select(Summarizer.metrics("min", "max", "variance").summary(F.col(column)).alias("s")).first()["s"]
    ranges = list(zip(s["min"], s["max"], s["variance"], strict=True))
    return [i for i, (low, high, var) in enumerate(ranges) if low != high or var != 0] or list(range(len(ranges)))


def train_post_model(
    history: DataFrame, target: str = "views", rounds: int = 100, depth: int = 6, rate: float = 0.05, target_lead: int = 0
) -> PipelineModel:
    """Fit on the features of all channels. With ``target_lead`` the target is that many posts ahead."""
    rows = feature_matrix(history).withColumn("label_target", F.col(target))
    if target_lead:
        ahead = rows.select("channel_id", (F.col("position") - target_lead).alias("position"),
                            F.col(target).alias("label_target"))
        rows = rows.drop("label_target").join(ahead, ["channel_id", "position"])
    names = [c for c in FEATURE_COLUMNS if c != target]
    aligned = AlignedFeatures(inputCols=names, outputCol="all_features")
    # The fit reads its rows three times before it holds them in bins, so the vectors are written, not their columns.
    vectors = settled(aligned.transform(rows).select("all_features", "label_target"), "features")
    if at_most(vectors, 1):
        raise ValueError("training needs at least seven posts of one channel")
    used = _varying(vectors, "all_features")
    chosen = VectorSlicer(inputCol="all_features", outputCol="features", indices=used).transform(vectors)
    model = boosting.fit(_booster("label_target", rounds, depth, rate), chosen)
    return PipelineModel([AlignedFeatures(inputCols=[names[i] for i in used], outputCol="features"), model])


def growth_rows(accounts: DataFrame, as_of: Column) -> DataFrame:
    """Training rows: accounts with a sentiment block, target subscribers per day alive."""
    known = sentiment_block(accounts).where(F.col("sentiment").isNotNull() & F.col("created_at").isNotNull())
    zero = F.lit(0.0)
    return known.select(
        "platform", "platform_id",
        F.coalesce("subscriber_count", F.lit(0)).cast("double").alias("subscriber_count"),
        *[F.coalesce(f"sentiment.{c}", zero).alias(c) for c in ("positive_pct", "neutral_pct", "negative_pct")],
        F.coalesce("sentiment.total_comments_analyzed", F.lit(0)).cast("double").alias("total_comments_analyzed"),
        growth_velocity(F.col("subscriber_count"), F.col("created_at"), as_of).alias("growth_velocity"),
    )


def hold_out(rows: DataFrame, key: list[str], share: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key, so a row stays on its side whatever the partitioning."""
    slot = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(100))
    return rows.where(slot >= share), rows.where(slot < share)


def train_growth_model(
    accounts: DataFrame, as_of: Column, rounds: int = 100, depth: int = 5, rate: float = 0.1, save_to: str | None = None
) -> tuple[PipelineModel, DataFrame]:
    """Fit the growth model; returns it with one row of metrics (RMSE of the hold-out, rows, features)."""
    spark = accounts.sparkSession
    rows = settled(growth_rows(accounts, as_of), "growth")
    if at_most(rows, 1):
        raise ValueError("training needs at least two accounts with sentiment data")
    train, test = hold_out(rows, ["platform", "platform_id"])
    aligned = AlignedFeatures(inputCols=GROWTH_FEATURES, outputCol="features")
    model = Pipeline(stages=[aligned, _booster("growth_velocity", rounds, depth, rate)]).fit(train)
    metrics = regression_metrics(spark, model, train, test, "growth_velocity", GROWTH_FEATURES)
    if save_to:
        model.write().overwrite().save(f"{save_to}/model")
        metrics.write.mode("overwrite").parquet(f"{save_to}/metrics")
    return model, metrics


def regression_metrics(
    spark: SparkSession, model: PipelineModel, train: DataFrame, test: DataFrame, target: str, features: list[str]
) -> DataFrame:
    held = model.transform(test)
    empty = at_most(test, 0)
    rmse = None if empty else RegressionEvaluator(labelCol=target, metricName="rmse").evaluate(held)
    sides = train.select(F.lit(True).alias("is_train")).unionByName(test.select(F.lit(False).alias("is_train")))
    sizes = sides.agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"))
    return sizes.select(
        "n_train", "n_test", F.lit(rmse).cast("double").alias("rmse"), F.lit(target).alias("target"),
        F.array(*[F.lit(f) for f in features]).alias("feature_order"),
    )


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

