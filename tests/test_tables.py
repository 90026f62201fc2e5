"""Writes, payload readers, ranking helpers and streams."""

import datetime as dt
import json
import os

import pytest

from pyspark.sql import functions as F

from wakeline import schemas
from wakeline.operators import ranking, scoring, sentiment, upsert
from wakeline.session import settled
from wakeline.sources import payloads, stored, tables
from wakeline.streaming import comments as streams

T0 = dt.datetime(2024, 5, 10)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_field_wise_upsert_is_idempotent(spark):
    cols = "platform string, platform_id string, body string, score bigint, sentiment_label string, ingested_at timestamp"
    old = spark.createDataFrame([("r", "1", "old", 5, "positive", T0), ("r", "2", "keep", 1, None, T0)], cols)
    # Many copies of one key, in any order: the newest value of each field wins.
    new = spark.createDataFrame(
        [("r", "1", f"v{i}", None if i == 9 else i, None, T0 + dt.timedelta(hours=i)) for i in range(10)]
        + [("r", "3", "new", 7, None, T0)], cols)
    once = upsert.set_fields(old, new)
    want = [("1", "v9", 8, "positive"), ("2", "keep", 1, None), ("3", "new", 7, None)]
    pick = ("platform_id", "body", "score", "sentiment_label")
    assert rows_of(once.na.fill("-"), *pick) == [tuple("-" if x is None else x for x in w) for w in want]
    assert rows_of(upsert.set_fields(once, new).na.fill("-"), *pick) == rows_of(once.na.fill("-"), *pick)


def test_insert_only_never_touches_stored_rows(spark):
    cols = "platform string, platform_id string, body string"
    old = spark.createDataFrame([("r", "1", "stored")], cols)
    new = spark.createDataFrame([("r", "1", "clobber"), ("r", "2", "b"), ("r", "2", "a")], cols)
    assert rows_of(upsert.insert_only(old, new), "platform_id", "body") == [("2", "a")]


def test_account_upsert_and_metadata(spark):
    a = spark.createDataFrame([("id1", "youtube", "c", "Old", "d", 5, None, {"k": "v", "sentiment": "x"}, T0, T0)], schemas.ACCOUNTS)
    later = T0 + dt.timedelta(days=1)
    new = spark.createDataFrame([("id9", "youtube", "c", "New", 6, later, later), ("id8", "youtube", "z", "Z", 1, later, later)],
                                "id string, platform string, platform_id string, display_name string, subscriber_count bigint, created_at timestamp, updated_at timestamp")
    out = upsert.upsert_accounts(a, new)
    assert rows_of(out, "platform_id", "id", "display_name", "subscriber_count") == [("c", "id1", "New", 6), ("z", "id8", "Z", 1)]
    assert out.where("platform_id = 'c'").first()["created_at"] == T0
    c = spark.createDataFrame([("youtube", "c", "positive"), ("youtube", "c", "neutral"), ("youtube", "c", None)],
                              "platform string, parent_id string, sentiment_label string")
    summary = sentiment.tally(c).withColumnRenamed("parent_id", "platform_id")
    at = F.lit("2024-06-01 10:00:00").cast("timestamp")
    merged = upsert.sentiment_block(upsert.merge_sentiment(a, summary, model="m1", analyzed_at=at)).first()
    assert merged["extra_metadata"]["k"] == "v" and merged["updated_at"] == dt.datetime(2024, 6, 1, 10)
    assert merged["sentiment"].asDict() == {
        "positive_pct": 0.5, "neutral_pct": 0.5, "negative_pct": 0.0, "total_comments_analyzed": 2,
        "model": "m1", "analyzed_at": "2024-06-01T10:00:00Z"}


def as_json(spark, *objects):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),) for o in objects], "json string")


def test_video_and_channel_resources(spark):
    item = {"id": "dQw4w9WgXcQ", "snippet": {"title": "Never", "channelTitle": "VEVO", "publishedAt": "2009-10-25T06:57:33Z",
            "tags": ["a"], "thumbnails": {"medium": {"url": "m"}, "default": {"url": "d"}}},
            "statistics": {"viewCount": "1500000000", "likeCount": "x"}}
    r = payloads.videos(as_json(spark, {"items": [item]}, "{broken", {"items": [{"id": "b"}]})).orderBy("video_id").collect()
    assert [x["video_id"] for x in r] == ["b", "dQw4w9WgXcQ"]
    assert (r[1]["views"], r[1]["likes"], r[1]["comment_count"], r[1]["thumbnail_url"], r[1]["tags"]) == (1_500_000_000, 0, 0, "m", ["a"])
    assert (r[0]["title"], r[0]["views"], r[0]["tags"]) == ("", 0, [])
    ch = payloads.channels(as_json(spark, {"items": [{"id": "UC1", "snippet": {"title": "T"}, "statistics": {"subscriberCount": "7"}}]})).first()
    assert (ch["display_name"], ch["subscriber_count"], ch["views"]) == ("T", 7, 0)
    _, bad = payloads.parse_json(as_json(spark, "{broken", {"items": []}), "json", schemas.VIDEO_LIST_JSON)
    assert [x["json"] for x in bad.collect()] == ["{broken"]


def test_listing_threads_and_reddit_payloads(spark):
    listing = {"pageInfo": {"totalResults": 100}, "nextPageToken": "CAUQAA", "items": [
        {"id": {"videoId": "vid123"}, "snippet": {"title": "Video 1", "publishedAt": "2026-01-01T00:00:00Z"}}, {"id": {}}]}
    assert rows_of(payloads.video_listing(as_json(spark, listing)), "video_id", "next_page_token", "total_results") == [("vid123", "CAUQAA", 100)]
    thread = lambda text: {"snippet": {"topLevelComment": {"id": text, "snippet": {"textDisplay": text}}}}
    got = payloads.comment_threads(as_json(spark, {"items": [thread(" 12345 "), thread(" 123456 ")]}))
    assert rows_of(got, "body", "like_count") == [("123456", 0)]
    sub = payloads.submissions(as_json(spark, {"id": "p", "title": "t", "subreddit": "S", "score": 3, "created_utc": 1.0, "thumbnail": "self", "permalink": "/r/s/1"})).first()
    assert (sub["thumbnail_url"], sub["author"], sub["permalink"], sub["num_comments"]) == (None, "[deleted]", "https://reddit.com/r/s/1", 0)
    c = as_json(spark, *[{"id": str(i), "body": b, "subreddit": "R", "score": i, "created_utc": 10.0} for i, b in enumerate(["hi", "[deleted]", "[removed]", ""])])
    assert rows_of(payloads.reddit_comments(c), "platform_id", "parent_id", "score") == [("0", "r", 0)]


def test_ranking_helpers(spark):
    s = spark.createDataFrame([("v3", 1), ("v1", 2)], "video_id string, position int")
    st = spark.createDataFrame([(f"v{i}", i) for i in range(9)], "video_id string, position int")
    assert [r["video_id"] for r in ranking.recently_tracked(s, st).collect()] == ["v3", "v1", "v0", "v2", "v4"]
    a = spark.createDataFrame([(f"id{i}", f"Name {i}") for i in range(9)], "platform_id string, display_name string")
    assert [r["platform_id"] for r in ranking.active_first(a, "NAME 7", 3).collect()] == ["id7", "id0", "id1"]
    one = spark.createDataFrame([("k", "first")], "platform_id string, body string")
    two = spark.createDataFrame([("k", "second")] * 50 + [("m", "x")], "platform_id string, body string")
    assert rows_of(ranking.first_source_wins([one, two]), "platform_id", "body") == [("k", "first"), ("m", "x")]
    c = spark.createDataFrame([("reddit", "X", i, T0 + dt.timedelta(seconds=i), str(i)) for i in range(5)],
                              "platform string, parent_id string, score int, ingested_at timestamp, platform_id string")
    assert [r["score"] for r in tables.scan_comments(c, "reddit", "x", newest=2).collect()] == [4, 3]
    turns = spark.createDataFrame([(1, t) for t in range(9)], "conv_id int, turn int")
    assert rows_of(ranking.last_turns(turns), "turn") == [(i,) for i in range(3, 9)]


COMMENT = "platform string, platform_id string, parent_id string, body string, published_at timestamp, ingested_at timestamp"


def comment_rows(ids, later=0, body=None):
    return [("reddit" if i % 2 else "youtube", f"c{i}", f"s{i % 3}", body or ("good" if i % 4 else "see https://youtu.be/dQw4w9WgXcQ bad"),
             T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + later)) for i in ids]


def test_stream_equals_batch(spark, tmp_path):
    rows = comment_rows(range(40))
    # Ten comments arrive twice, five of them once more in a third batch, long after the first copy.
    for n, part in enumerate((rows[:25], rows[15:], rows[:5])):
        spark.createDataFrame(part, COMMENT).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "term string, valence double")
    scorer = lambda t: scoring.lexicon_scores(t, lex)
    source = lambda: streams.read_stream(spark, f"{tmp_path}/in/*", COMMENT, files_per_batch=1)
    log, scores = f"{tmp_path}/log", f"{tmp_path}/scores"
    landed = []
    for _ in range(2):  # a restart finds nothing new
        streams.ingest(source(), log, f"{tmp_path}/cp", lambda batch, n: landed.append(batch.count())).awaitTermination()
        streams.score_once(streams.read_stream(spark, f"{log}/*/*", COMMENT, files_per_batch=1), scores, scorer, f"{tmp_path}/cps").awaitTermination()
    assert sorted(landed) == [5, 25, 25] and spark.read.parquet(log).count() == 55
    assert spark.read.parquet(scores).count() == 40  # every comment once, over three batches
    streams.ingest(source(), log, f"{tmp_path}/other").awaitTermination()  # a new checkpoint erases nothing
    assert spark.read.parquet(log).count() == 110
    streams.score_once(source(), scores, scorer, f"{tmp_path}/others").awaitTermination()  # and scores nothing again
    assert spark.read.parquet(scores).count() == 40
    state = streams.comment_state(spark, log, scores)
    assert state.count() == 40 and state.where("sentiment_processed").count() == 40

    batch = spark.createDataFrame(rows, COMMENT)
    for run in ("cp2", "cp3"):
        streams.run_updates(streams.running_shares(source()), f"{tmp_path}/u", f"{tmp_path}/{run}").awaitTermination()
    now = streams.newest_update(spark.read.parquet(f"{tmp_path}/u"), ["video_id"])
    assert now.collect() == streams.running_shares(batch).collect()
    labelled = lambda df: df.withColumn("sentiment_label", F.lit("positive"))
    streams.run_updates(streams.running_distribution(labelled(source())), f"{tmp_path}/d", f"{tmp_path}/cp4").awaitTermination()
    dist = streams.newest_update(spark.read.parquet(f"{tmp_path}/d"), ["platform", "parent_id"])
    assert dist.agg(F.sum("n")).first()[0] == 40
    assert rows_of(dist, "platform", "parent_id", "n") == rows_of(streams.running_distribution(labelled(batch)), "platform", "parent_id", "n")


def test_the_last_run_has_the_newest_update(spark, tmp_path):
    """A later run's first batch is newer than an earlier run's last one."""
    log = f"{tmp_path}/log"
    first = streams.run_name(spark, log, "one")
    spark.createDataFrame([("v", 9)], "video_id string, shares long").write.parquet(f"{log}/{first}/batch_id=5")
    second = streams.run_name(spark, log, "two")
    spark.createDataFrame([("v", 1)], "video_id string, shares long").write.parquet(f"{log}/{second}/batch_id=0")
    assert streams.run_name(spark, log, "one") == first < second == streams.run_name(spark, log, "two")
    assert streams.newest_update(spark.read.parquet(log), ["video_id"]).collect() == [("v", 1)]


def test_compacted_logs_keep_the_state(spark, tmp_path):
    """Twenty batches with late and partial copies: equal state, a flat number of files to read."""
    log, plain, read = f"{tmp_path}/log", f"{tmp_path}/plain", []
    run = streams.run_name(spark, log, "cp")
    for n in range(20):
        rows = [(*r[:3], None if n % 3 == 1 else f"text {n}", *r[4:]) for r in comment_rows(range(n, n + 6), later=(n * 7) % 11)]
        for where in (log, plain):
            spark.createDataFrame(rows, COMMENT).coalesce(1).write.parquet(f"{where}/{run}/batch_id={n}")
        if n % 4 == 3:
            streams.compact(spark, log)
        read.append(len(streams.batches(spark, log, streams.generations.newest(spark, log)[1].get("covered"))))
    assert max(read) <= 3 and read[-1] == 0 and len(streams.batches(spark, plain)) == 20
    columns = [c.split()[0] for c in COMMENT.split(", ")]
    assert rows_of(streams.comment_state(spark, log), *columns) == rows_of(streams.comment_state(spark, plain), *columns)
    left = [n for n in streams.generations.children(spark, log) if n.startswith("_snapshot")]
    assert len(left) == 2  # the newest, and the one a reader may still use


def test_a_crash_while_compacting_loses_nothing(spark, tmp_path, monkeypatch):
    log = f"{tmp_path}/log"
    run = streams.run_name(spark, log, "cp")
    for n in range(3):
        spark.createDataFrame(comment_rows(range(n, n + 5)), COMMENT).write.parquet(f"{log}/{run}/batch_id={n}")
    streams.compact(spark, log)
    spark.createDataFrame(comment_rows(range(50, 55)), COMMENT).write.parquet(f"{log}/{run}/batch_id=3")
    want = rows_of(streams.comment_state(spark, log), "platform_id", "body")

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(streams.generations, "publish", die)  # the snapshot is written, the generation is not
        with pytest.raises(OSError):
            streams.compact(spark, log)
    assert rows_of(streams.comment_state(spark, log), "platform_id", "body") == want and len(want) == 12
    (tmp_path / "log" / "_generations" / "000000000002").mkdir()  # a pointer that was never finished
    assert rows_of(streams.comment_state(spark, log), "platform_id", "body") == want
    streams.compact(spark, log)
    assert rows_of(streams.comment_state(spark, log), "platform_id", "body") == want


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    rows = [("reddit", f"c{i}", i, "a") for i in range(200)]
    cols = "platform string, platform_id string, ingested_at int, author string"
    folder = f"{tmp_path}/stored"
    files = lambda: {b: sorted(os.listdir(f)) for b, f in stored.layout(spark, folder).items()}
    stored.create(spark.createDataFrame(rows, cols), folder, buckets=8)
    before = files()
    fresh = spark.createDataFrame([("reddit", "c3", 900, "new"), ("reddit", "c3", 901, None), ("reddit", "other", 1, "b")], cols)
    stored.merge(fresh, folder)
    after, state = files(), rows_of(stored.load(spark, folder), "platform_id", "ingested_at", "author")
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and set(before) <= set(after)
    assert len(state) == 201 and ("c3", 901, "new") in state and ("other", 1, "b") in state
    stored.merge(fresh, folder)  # the same again
    assert rows_of(stored.load(spark, folder), "platform_id", "ingested_at", "author") == state
    stored.merge(fresh.limit(0), folder)
    snapshots = spark.createDataFrame([("reddit", "c4", 5, None)], cols)
    stored.merge(snapshots, folder, upsert.replace_snapshots)
    assert ("c4", 5, None) in rows_of(stored.load(spark, folder), "platform_id", "ingested_at", "author")
    with pytest.raises(RuntimeError):  # a second writer of the same generation
        stored.generations.publish(spark, folder, 1, {})


def test_equal_times_are_settled_by_content(spark):
    rows = [("reddit", "k", 1, v) for v in ("b", "z", "a")]
    cols = "platform string, platform_id string, ingested_at int, author string"
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, cols)
        assert upsert.set_fields(df.limit(0), df).first()["author"] == "z"


def test_settled_tables_keep_rows_and_schema(spark):
    df = spark.range(10).select("id", F.array(F.lit("x")).alias("a"))
    out = settled(df)
    assert out.dtypes == df.dtypes and out.count() == 10


def test_a_batch_is_scored_from_one_pass(spark, tmp_path, monkeypatch):
    """Rows leave the state store once for each batch; scoring reads its input three times, and did so with them before."""
    rows = spark.createDataFrame([("reddit", f"k{i % 8}", f"fine text {i % 8}", None) for i in range(12)],
                                 "platform string, platform_id string, body string, sentiment_label string")
    rows.withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    met, real = spark.sparkContext.accumulator(0), streams.first_arrivals

    def counted(stream):
        def run(batches):
            for b in batches:
                met.add(b.num_rows)
                yield b
        return real(stream).mapInArrow(run, stream.schema)

    monkeypatch.setattr(streams, "first_arrivals", counted)
    stream = streams.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    score = lambda t: t.select("text_key", F.lit("positive").alias("label"), F.lit(0.9).alias("score"))
    streams.score_once(stream, str(tmp_path / "scores"), score, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "scores")).collect()
    assert sorted((r.platform_id, r.sentiment_label) for r in got) == [(f"k{i}", "positive") for i in range(8)]
    assert met.value == 8
