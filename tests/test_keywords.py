import pytest
from pyspark.sql import functions as F

from wakeline.operators import keywords

TEXTS = [
    "Apples and Oranges!! apples http://a.b/c oranges2 don't worry worry",
    "Bananas;bananas www.site.com/x APPLES é́clair naïveté naïveté",
    "zebra yacht zebra yacht　xenon 2024year 2024year",
]


# Counted by hand. Ties keep the order in which the words first occur.
TOP = {
    "trend": [("apples", 3), ("worry", 2), ("naïveté", 2), ("zebra", 2), ("yacht", 2), ("2024year", 2)],
    "topic": [("apples", 3), ("oranges", 2), ("worry", 2), ("naïveté", 2), ("zebra", 2), ("yacht", 2)],
    "context": [("apples", 3), ("worry", 2), ("naïveté", 2), ("zebra", 2), ("yacht", 2), ("2024year", 2)],
}


@pytest.mark.parametrize("rule", ["trend", "topic", "context"])
def test_ranking_of_counted_texts(spark, rule):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, body string")
    got = keywords.top_keywords(df, 6, rule, order=[F.col("i")]).orderBy("rank").collect()
    assert [(r["keyword"], r["frequency"]) for r in got] == TOP[rule]


def test_per_group_lists(spark):
    df = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(TEXTS)], "g int, i int, body string")
    ranked = keywords.top_keywords_per(df, ["g"], 3, "trend", order=[F.col("i")])
    lists = {r["g"]: r["topics"] for r in keywords.keyword_lists(ranked, ["g"]).collect()}
    assert lists[0] == ["apples", "worry", "zebra"]
    assert lists[1] == ["naïveté", "bananasbananas", "apples"]


def correlate(spark, rd, yt):
    side = lambda ws: spark.createDataFrame(list(enumerate(ws, 1)), "rank int, keyword string")
    rows = keywords.correlate_topics(side(rd), side(yt)).orderBy("position").collect()
    return [(r["topic"], r["is_shared"], r["youtube_relevance"], r["reddit_discussion_volume"]) for r in rows]


def test_topic_correlation_shared(spark):
    got = correlate(spark, ["gaming", "review", "walk"], ["walk", "epic", "gaming"])
    assert got == [("gaming", True, "High", "High"), ("walk", True, "High", "High"), ("review", False, "Medium", "High"),
                   ("epic", False, "High", "Medium")]


def test_topic_correlation_fallback(spark):
    got = correlate(spark, ["a1", "b1"], ["c1", "d1", "e1", "f1", "g1"])
    assert [g[0] for g in got] == ["a1", "b1", "c1", "d1", "e1", "f1"]
    assert [g[1] for g in got] == [True] * 4 + [False] * 2


def test_video_topics(one):
    tags = F.array(*[F.lit(x) for x in ("a", "b", "c", "d", "e")])
    assert one(keywords.video_topics(tags, F.array(F.lit("b"), F.lit("x"), F.lit("y"), F.lit("z")))) == [
        "a", "b", "c", "d", "x", "y"]
