import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from wakeline import fixed_values as V
from wakeline.operators import features, forecast, models, priors
from wakeline.schemas import POST_HISTORY

START = dt.datetime(2026, 8, 1, 12)


def history(spark, sizes, base=300.0, category=None, shuffle_times=False):
    rows = []
    for ch, n in sizes.items():
        for i in range(n):
            v = base * (1 + 0.05 * i) if not shuffle_times else float((i * 7919) % 1000 + 1)
            at = START + dt.timedelta(days=2 * i if not shuffle_times else i // 3)
            rows.append((ch, f"{ch}-{i:05d}", at, "t", category, (v, v * 0.06, v * 0.01, v * 0.005, v * 0.002), None,
                         (0.6, 0.3, 0.1), i % 4))
    return spark.createDataFrame(rows, POST_HISTORY)


def window_features(flat):
    """Lags and rolling measures as plain SQL windows over whole channels.

    Long channels lose the rows without five predecessors; in short ones a missing lag takes the channel's first
    value, or zero where the channel has no such lag at all.
    """
    order = "(PARTITION BY channel_id ORDER BY published_at, post_id)"
    lags = ", ".join(
        f"CASE WHEN pos >= {k} THEN lag({c}, {k}) OVER {order} WHEN n > {k} THEN first_value({c}) OVER {order} ELSE 0 END AS {c}_lag{k}"
        for k in range(1, 6) for c in features.LAGGED)
    frame = "(PARTITION BY channel_id ORDER BY pos ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    rolls = ", ".join(
        f"avg({c}) OVER {frame.format(w - 1)} AS {c}_roll{w}_mean, "
        f"coalesce(stddev_samp({c}) OVER {frame.format(w - 1)}, 0) AS {c}_roll{w}_std"
        for w in V.ROLLING_WINDOWS for c in V.ENGAGEMENT_METRICS)
    return duckdb.sql(f"""
        WITH placed AS (SELECT *, row_number() OVER {order} - 1 AS pos, count(*) OVER (PARTITION BY channel_id) AS n FROM flat),
        lagged AS (SELECT *, {lags} FROM placed)
        SELECT *, {rolls} FROM lagged WHERE n <= 5 OR pos >= 5 ORDER BY channel_id, pos""").df()


@pytest.mark.parametrize("chunk, bucket", [(50_000, 86_400), (7, 86_400), (6, 3 * 86_400)])
def test_features_equal_sql_windows(spark, chunk, bucket):
    # One channel holds most rows; short channels take the back-fill path.
    h = history(spark, {"hot": 60, "six": 6, "five": 5, "two": 2, "one": 1}, shuffle_times=True)
    got = features.feature_matrix(h, chunk, bucket).toPandas()
    for ch, want in window_features(features.flatten(h).toPandas()).groupby("channel_id"):
        mine = got[got.channel_id == ch].sort_values("position")
        assert list(mine.post_id) == list(want.post_id)
        for c in [*features.LAGGED, *features.LAG_COLUMNS, *features.ROLLING_COLUMNS]:
            np.testing.assert_allclose(mine[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9, err_msg=f"{ch} {c}")
    assert set(features.FEATURE_COLUMNS) <= set(got.columns)


def test_calendar_defaults(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 6, 2, 5),), (None,)], "t timestamp").select(*features.calendar(F.col("t")))
    assert [tuple(r) for r in rows.collect()] == [(6, 5, 6, 1), (0, 12, 1, 0)]


@pytest.mark.parametrize("name, want", [
    ("TECHNOLOGY", "tech"), ("videogames", "gaming"), ("movies", "entertainment"), ("science", "education"),
    ("political", "news"), ("songs", "music"), ("general", "general"),
])
def test_category_aliases(one, name, want):
    assert one(priors.canonical_category(F.col("c")), c=name) == want


def detect(spark, title=None, description=None, explicit=None, category=None, posts=()):
    ch = spark.createDataFrame([("c", explicit, category, title, description)],
                               "channel_id string, explicit_category string, category string, title string, description string")
    h = spark.createDataFrame([("c", f"{i:03d}", START + dt.timedelta(days=i), t, k) for i, (t, k) in enumerate(posts)],
                              "channel_id string, post_id string, published_at timestamp, title string, category string")
    return priors.detect_category(ch, h).first()["category"]


def test_category_detection(spark):
    assert detect(spark, title="Python coding and software review") == "tech"
    assert detect(spark, description="Minecraft gameplay walkthrough") == "gaming"
    assert detect(spark, posts=[("movie trailer and film", None)]) == "entertainment"
    assert detect(spark, title="minecraft", category="diy", posts=[("x", "odd"), ("y", "Songs")]) == "music"
    assert detect(spark, explicit="Software", category="music") == "tech"
    assert detect(spark, title="nothing here", explicit="unknown_xyz") == "general"
    assert detect(spark, title="learn how to") == "education"
    assert detect(spark, posts=[("x", None)] * 10 + [("song album", "songs")]) == "general"
    assert detect(spark, title="game python") == "gaming"  # a tie goes to registry order


def channel(spark, **cols):
    return spark.range(1).select(F.lit("c").alias("channel_id"), *[F.lit(v).alias(k) for k, v in cols.items()])


def test_cold_start_forecast(spark):
    rows = priors.category_forecast(channel(spark, category="gaming"), priors.category_priors(spark)).orderBy("step").collect()
    want = [(8712.5, 5663.1, 11761.9), (8930.3, 5804.7, 12055.9), (9153.6, 5949.8, 12357.3)]
    for r, w in zip(rows, want):
        assert np.allclose((r["predicted_views"], r["ci_low"], r["ci_high"]), w, atol=0.15)
    assert [r["step"] for r in rows] == [1, 2, 3, 4, 5]


def test_interval_widths(spark):
    ch = spark.createDataFrame([(c, c) for c in priors.CATEGORIES], "channel_id string, category string")
    out = priors.category_forecast(ch, priors.category_priors(spark), 1).toPandas().set_index("category")
    half = (out.ci_high - out.ci_low) / 2 / out.predicted_views
    assert abs(half["tech"] - 0.33871) < 1e-4 and abs(half["education"] - 1 / 3) < 1e-4
    assert all(abs(half[c] - 0.35) < 1e-4 for c in ("gaming", "entertainment", "news", "music", "general"))


def test_warmup_posts(spark):
    ch = channel(spark, category="tech", needed=3, scale_views=500.0).withColumn("anchor", F.lit(START).cast("timestamp"))
    rows = priors.warmup_posts(ch, priors.category_priors(spark)).orderBy("published_at").collect()
    assert [r["engagement_metrics"]["views"] for r in rows] == [471.2, 480.6, 490.2]
    assert [(START - r["published_at"]).days for r in rows] == [9, 6, 3]


@pytest.mark.parametrize("n, weight, engine", [
    (0, 1.0, "category_benchmark"), (1, 0.8, "transfer_learning"), (2, 0.6, "transfer_learning"),
    (4, 0.2, "transfer_learning"), (5, 0.0, "transfer_learning"), (8, 0.0, "baseline_moving_avg"),
])
def test_regimes(spark, n, weight, engine):
    ch = spark.createDataFrame([("c", "tech", None, None, None)],
                               "channel_id string, explicit_category string, category string, title string, description string")
    rows = forecast.blended_forecast(ch, history(spark, {"c": n}), priors.category_priors(spark)).orderBy("step").collect()
    assert len(rows) == 5 and {(r["prior_weight"], r["engine"]) for r in rows} == {(weight, engine)}
    if n == 2:
        assert np.allclose([r["predicted_views"] for r in rows[:3]], [312.4, 317.4, 322.5], atol=0.15)


def test_seeded_noise_stays_in_range(spark):
    flat = features.flatten(history(spark, {"c": 6}))
    plain = forecast.baseline_forecast(flat).toPandas().predicted_views
    noisy = forecast.baseline_forecast(flat, noise_seed=1).toPandas().predicted_views
    assert ((noisy / plain).between(0.949, 1.051)).all() and not (noisy == plain).all()


def linear_model(h):
    """A fitted spark.ml pipeline over three features, and the same formula for pandas rows."""
    used = ["views_lag1", "views_roll5_mean", "likes_roll3_std"]
    stages = [VectorAssembler(inputCols=used, outputCol="features"),
              LinearRegression(featuresCol="features", labelCol="views", regParam=0.1)]
    model = Pipeline(stages=stages).fit(features.feature_matrix(h))
    w, b = model.stages[1].coefficients, model.stages[1].intercept
    return model, lambda row: sum(w[i] * row[c] for i, c in enumerate(used)) + b


def test_recursive_forecast_equals_the_full_recompute(spark):
    h = history(spark, {"long": 23, "edge": 6, "seven": 7}, shuffle_times=True)
    as_of = F.lit(dt.datetime(2027, 1, 1)).cast("timestamp")
    model, formula = linear_model(h)
    got = forecast.model_forecast(h, model, as_of, steps=3).toPandas()
    flat = features.flatten(h).toPandas().sort_values(["published_at", "post_id"])
    for ch, part in flat.groupby("channel_id"):
        part = part.reset_index(drop=True)
        for step in range(1, 4):
            v = formula(window_features(part).iloc[-1])
            seen = part[part.views > 0]
            l, c = v * (seen.likes / seen.views).mean(), v * (seen.comments / seen.views).mean()
            row = got[(got.channel_id == ch) & (got.step == step)].iloc[0]
            assert np.allclose([row.predicted_views, row.predicted_likes, row.predicted_comments], [v, l, c], atol=0.06)
            new = dict.fromkeys(part.columns, 0.0) | {
                "channel_id": ch, "published_at": pd.Timestamp("2027-01-01") + pd.Timedelta(days=step), "post_id": "z", "views": v, "likes": l, "comments": c, "sentiment_positive": 0.5,
                "sentiment_neutral": 0.4, "sentiment_negative": 0.1}
            part = pd.concat([part, pd.DataFrame([new])], ignore_index=True)


def test_post_model_trains_and_forecasts(spark):
    h = history(spark, {"a": 14, "b": 9, "few": 2}, shuffle_times=True)
    model = models.train_post_model(h, rounds=2, depth=2)
    cats = spark.createDataFrame([("a", "tech"), ("b", "tech"), ("few", "music")], "channel_id string, category string")
    longer = forecast.with_warmup(h, cats, priors.category_priors(spark))
    assert longer.where("channel_id = 'few'").count() == 6
    out = forecast.model_forecast(longer, model, F.current_timestamp(), steps=2)
    assert out.groupBy("channel_id").count().where("count = 2").count() == 3


def test_steps_read_single_fields_of_the_last_posts(spark):
    # Lambdas over the array of posts took most of a step: the mean was computed anew for every element.
    seen = []

    class Recorder:
        def transform(self, rows):
            seen.append(rows)
            return rows.withColumn("prediction", F.lit(100.0))

    h = history(spark, {"long": 23, "six": 6, "seven": 7, "eight": 8}, shuffle_times=True)
    forecast.model_forecast(h, Recorder(), F.current_timestamp(), steps=2)
    assert "lambda" not in seen[0]._jdf.queryExecution().analyzed().toString()
    got = seen[0].toPandas().set_index("channel_id")
    for ch, want in window_features(features.flatten(h).toPandas()).groupby("channel_id"):
        for c in [*features.LAGGED, *features.LAG_COLUMNS, *features.ROLLING_COLUMNS]:
            assert np.isclose(got.loc[ch, c], want.iloc[-1][c], atol=1e-9), (ch, c)


def test_training_writes_vectors_and_skips_features_of_one_value(spark, monkeypatch):
    written, settled = [], models.settled
    monkeypatch.setattr(models, "settled", lambda df, name: written.append(settled(df, name)) or written[-1])
    h = history(spark, {"a": 30, "b": 19}, shuffle_times=True)
    model = models.train_post_model(h, rounds=3, depth=3)
    assert [f.dataType.typeName() for f in written[0].schema] == ["vectorudt", "double"]
    used = model.stages[0].getInputCols()
    rows = features.feature_matrix(h)
    n = rows.select(*[F.count_distinct(c).alias(c) for c in features.FEATURE_COLUMNS]).first().asDict()
    assert used == [c for c in features.FEATURE_COLUMNS if c != "views" and n[c] > 1] and n["hour_of_day"] == 1

    # The same rows with all features make the same trees.
    names = [c for c in features.FEATURE_COLUMNS if c != "views"]
    every = written[0].withColumnRenamed(written[0].columns[0], "features")
    full = models._booster("label_target", 3, 3, 0.05).fit(every)
    both = model.transform(rows).withColumnRenamed("prediction", "few").drop("features")
    both = full.transform(models.AlignedFeatures(inputCols=names, outputCol="features").transform(both))
    assert both.where(F.col("few") != F.col("prediction")).count() == 0 and both.select("few").distinct().count() > 3


def test_a_feature_of_one_value_and_nan_stays(spark):
    nan = float("nan")
    rows = spark.createDataFrame([([1.0, nan, 2.0],), ([1.0, 3.0, 2.0 + 1e-12],), ([1.0, 3.0, 2.0],)], "v array<double>")
    vectors = rows.select(array_to_vector("v").alias("v"))
    assert models._varying(vectors, "v") == [1, 2]
    assert models._varying(vectors.limit(1), "v") == [1]
    assert models._varying(spark.createDataFrame([([4.0, 5.0],)] * 2, "v array<double>").select(array_to_vector("v").alias("v")), "v") == [0, 1]


def test_growth_model_and_saved_form(spark, tmp_path):
    rows = [("youtube", f"c{i}", 100 * (i + 1), START - dt.timedelta(days=10 + i),
             {"sentiment": f'{{"positive_pct": {0.1 * (i % 5)}, "neutral_pct": 0.3, "negative_pct": 0.2, "total_comments_analyzed": {i}}}'})
            for i in range(40)] + [("youtube", "none", 5, START, {})]
    a = spark.createDataFrame(rows, "platform string, platform_id string, subscriber_count bigint, created_at timestamp, extra_metadata map<string,string>")
    as_of = F.lit(START).cast("timestamp")
    one_row = models.growth_rows(a, as_of).where("platform_id = 'c0'").first()
    assert one_row["growth_velocity"] == 10.0
    assert models.growth_rows(a, as_of).count() == 40
    model, metrics = models.train_growth_model(a, as_of, rounds=2, depth=2, save_to=str(tmp_path))
    m = metrics.first()
    assert m["n_train"] + m["n_test"] == 40 and m["rmse"] >= 0
    assert models.load_model(f"{tmp_path}/model").stages[0].getInputCols() == models.GROWTH_FEATURES
    with pytest.raises(ValueError):
        models.train_growth_model(a.limit(1), as_of)

    # A table without two of the columns, in another order, with others: as if the columns held 0.
    loaded, rows = models.load_model(f"{tmp_path}/model"), models.growth_rows(a, as_of)
    short = rows.select(F.lit(7).alias("features_of_another_table"), *reversed([c for c in rows.columns if c not in ("positive_pct", "subscriber_count")]))
    zeros = rows.withColumns({"positive_pct": F.lit(0.0), "subscriber_count": F.lit(None).cast("double")})
    predicted = lambda m, df: sorted((r["platform_id"], r["prediction"]) for r in m.transform(df).collect())
    assert predicted(loaded, short) == predicted(loaded, zeros) == predicted(model, zeros) != predicted(model, rows)
    assert set(short.columns) < set(loaded.transform(short).columns)
