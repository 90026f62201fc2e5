import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import fingerprint, linking, semantic


def test_fingerprint_columns(spark):
    v = spark.createDataFrame(
        [("v1", "Our New Smartwatch is Here ! *ANARC 2* | Tech Burner", "Tech Burner", ["Burner", "watch", "burnerx"], None),
         ("v2", "Rick Astley - Never Gonna Give You Up (Official Music Video)", "Marques Brownlee Official", [], None),
         ("v3", "", "", None, None)],
        "video_id string, title string, channel_title string, tags array<string>, published_at timestamp")
    a, b, c = fingerprint.fingerprints(v).orderBy("video_id").collect()
    assert a["creator_variants"] == ["tech burner", "tech", "burner", "shlok srivastava"]
    assert a["distinctive_phrases"] == ["ANARC 2", "Our New Smartwatch is Here !"]
    assert a["topic_words"] == ["smartwatch", "burner", "anarc", "tech"]
    assert a["tag_phrases"] == ["burner", "watch", "burnerx"]
    assert b["creator_variants"] == ["marques brownlee", "marques", "brownlee", "mkbhd"]
    assert b["distinctive_phrases"] == ["Rick Astley", "Never Gonna Give You Up"]
    assert b["topic_words"] == ["official", "astley", "never", "gonna", "music", "rick", "give"]
    assert c["creator_variants"] == [] and c["topic_words"] == []


PRINT = ("vid00000001", ["mark rober", "mark", "robert"], ["Glitter Bomb"], ["package", "thief", "maze", "backyard", "bomb"])


@pytest.mark.parametrize("text, want", [
    ("see VID00000001 now", ("url", 1.0)),
    ("xvid00000001x", ("url", 1.0)),
    ("mark rober glitter bomb", ("phrase_match", 0.9)),
    ("robertson: the GLITTER BOMBS", ("phrase_match", 0.9)),  # names and phrases match inside words
    ("mark made a glitter bomb", None),  # a short single name proves nothing
    ("glitter bomb", None),
    ("mark rober package thief maze", ("title_match", 0.8)),  # three of five words
    ("mark rober package thief backyard mazes", ("title_match", 0.85)),
    ("mark rober package thief backyard maze bomb", ("title_match", 0.9)),
    ("mark rober package thief", None),
    ("package thief maze backyard", None),
    ("", None),
])
def test_evidence(spark, text, want):
    schema = "video_id string, creator_variants array<string>, distinctive_phrases array<string>, topic_words array<string>"
    row = spark.createDataFrame([PRINT], schema).select(
        fingerprint.evidence(F.lower(F.lit(text)), F.struct("*")).alias("e")).first()["e"]
    assert (tuple(row) if row else None) == want


def test_shared_names_make_no_useless_pairs(spark):
    """One name that all share and common title words: candidate pairs stay near the results."""
    tested = []
    for n in (60, 120):
        v = spark.createDataFrame([(f"vid{i:08d}", f"gameplay walkthrough number {'abcdefghij'[i % 10]}{i:05d}", "gaming", [], None) for i in range(n)],
                                  "video_id string, title string, channel_title string, tags array<string>, published_at timestamp")
        posts = spark.createDataFrame([(f"p{i}", f"I like gaming gameplay walkthrough {i}") for i in range(n)], "post_id string, text string")
        found = fingerprint.verify(posts, fingerprint.fingerprints(v))
        assert found.count() == 0
        plan = found._jdf.queryExecution().executedPlan().toString()
        tested.append(plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin"))
        assert fingerprint.candidate_pairs(posts, fingerprint.fingerprints(v)).count() == 0
    assert tested == [0, 0]


def test_words_in_another_order_make_no_pairs(spark):
    """A phrase is looked up by neighbouring words: the same words the other way round, or apart, meet nothing."""
    schema = "video_id string, title string, channel_title string, tags array<string>, published_at timestamp"
    for n in (100, 300):
        v = spark.createDataFrame([(f"vid{i:08d}", "walkthrough gameplay", "gaming", [], None) for i in range(n)], schema)
        texts = ["gaming gameplay walkthrough", "gaming walkthrough of gameplay", "gaming walkthrough\tis gameplay", "gaming walkthroughs gameplay"]
        posts = spark.createDataFrame([(f"p{i}", texts[i % 4]) for i in range(n)], "post_id string, text string")
        prints = fingerprint.fingerprints(v)
        assert fingerprint.candidate_pairs(posts, prints).count() == 0
        assert fingerprint.verify(posts, prints).count() == 0
    found = fingerprint.verify(spark.createDataFrame([("p", "Gaming xwalkthrough gameplays")], "post_id string, text string"), prints)
    assert found.count() == n  # inside words at both ends


def test_phrases_of_many_words_and_odd_spaces(spark):
    """Single words, three words, two spaces, tabs, and names that lost a sign between two spaces."""
    schema = "video_id string, title string, channel_title string, tags array<string>, published_at timestamp"
    v = spark.createDataFrame([
        ("vid00000001", "Zed  Prime Cut", "A & B", [], None), ("vid00000002", "one two three four", "Mister Long Name", [], None),
        ("vid00000003", "unboxing", "Mister Long Name", [], None), ("vid00000004", "Tab\there it goes", "Ok & Go", [], None)], schema)
    texts = ["a  b: zed  prime cut", "a  b: zed prime cut", "a b zed  prime cut", "mister long name one two three four", "mister long name two three one four",
             "name long mister unboxings", "xmister long names unboxings", "ok  go tab\there it goes", "ok  go tab here it goes", "unboxing", ""]
    posts = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "post_id string, text string")
    prints = fingerprint.fingerprints(v)
    got = {(r["post_id"], r["video_id"], r["match_type"]) for r in fingerprint.verify(posts, prints).collect()}
    fp = F.struct(*[F.col(c) for c in ("video_id", "creator_variants", "distinctive_phrases", "topic_words")])
    rows = posts.crossJoin(prints).select("post_id", "video_id", fingerprint.evidence(F.lower("text"), fp).alias("e")).where("e IS NOT NULL")
    want = {(r["post_id"], r["video_id"], r["e"]["match_type"]) for r in rows.collect()}
    assert got == want and {("p0", "vid00000001", "phrase_match"), ("p6", "vid00000003", "phrase_match")} <= want


def test_posts_and_comments_from_one_index(spark):
    v = spark.createDataFrame([("vid00000001", "secret maze", "gardenia", [], None)],
                              "video_id string, title string, channel_title string, tags array<string>, published_at timestamp")
    posts = spark.createDataFrame([("c1", "gardenia: secret maze"), ("1", None), ("p1", "vid00000001")], "post_id string, text string")
    comments = spark.createDataFrame([("c1", "secret maze"), ("1", "gardenia secret maze")], "platform_id string, body string")
    of_posts, of_comments = fingerprint.verify_together(posts, comments, fingerprint.fingerprints(v))
    assert {(r.post_id, r.match_type) for r in of_posts.collect()} == {("c1", "phrase_match"), ("p1", "url")}
    assert {(r.platform_id, r.match_type) for r in of_comments.collect()} == {("1", "phrase_match")}


def test_evidence_equals_the_nested_loop(spark):
    rng = random.Random(7)
    words = ["mark", "rober", "marksmanship", "glitter", "bomb", "package", "thief", "squirrel", "maze", "backyard",
             "olympics", "engineer", "ok", "a", "x1", "hot"]
    makers = ["Mark Rober", "Glitter Labs", "A Bcd", "Hot", "Roberta"]
    videos = [(f"vid{i:08d}", " ".join(rng.sample(words, rng.randint(1, 7))) + rng.choice(["", " [maze run]", " | hot maze"]),
               rng.choice(makers), rng.sample(words, 2), None) for i in range(40)]
    texts = [(f"p{i}", " ".join(rng.choices(words + ["mark rober", "a bcd", "maze run", "glitter labs", "hotmaze"], k=rng.randint(1, 14)))
              + (f" xx-vid{rng.randint(0, 39):08d}zz" if i % 6 == 0 else "")) for i in range(120)]
    v = spark.createDataFrame(
        videos, "video_id string, title string, channel_title string, tags array<string>, published_at timestamp")
    prints = fingerprint.fingerprints(v)
    got = {(r["post_id"], r["video_id"]): (r["match_type"], r["similarity_score"]) for r in
           fingerprint.verify(spark.createDataFrame(texts, "post_id string, text string"), prints).collect()}
    fp = F.struct(*[F.col(c) for c in ("video_id", "creator_variants", "distinctive_phrases", "topic_words")])
    every = spark.createDataFrame(texts, "post_id string, text string").crossJoin(prints)
    rows = every.select("post_id", "video_id", fingerprint.evidence(F.lower("text"), fp).alias("e")).where("e IS NOT NULL")
    want = {(r["post_id"], r["video_id"]): tuple(r["e"]) for r in rows.collect()}
    assert {e[0] for e in want.values()} == {"url", "phrase_match", "title_match"}
    assert got == want


def test_parts_that_begin_alike_meet_only_their_words(spark):
    """Parts with long equal beginnings or ends: a word meets few of them, and all it holds are found."""
    same = "abcdefghijklmnopqrstuvwxyz"
    parts = [f"aaaaa{i:04d}" for i in range(300)] + [f"{i:04d}zzzzz" for i in range(300)] + [same + "1", same + "2", "1" + same, "ab", "c", ""]
    words = [f"x{p}y" for p in parts] + parts + ["", "b", "aaaaaa0001", "xab", "éaaaaa0007é"]
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string").distinct()
    index = spark.createDataFrame([(p,) for p in parts], "part string")
    tests = {"contains": str.__contains__, "start": str.startswith, "end": str.endswith}
    for hold, holds in tests.items():
        found = fingerprint._words_that(hold, vocabulary, index)
        want = {(w, p) for w in words for p in parts if p and holds(w, p)}
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)


def test_a_listing_of_one_split_is_spread(spark):
    schema = "video_id string, title string, channel_title string, tags array<string>, published_at timestamp"
    v = spark.createDataFrame([(f"vid{i:08d}", "secret maze", "gardenia", [], None) for i in range(50)], schema).coalesce(1)
    plan = fingerprint.fingerprints(v)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(video_id" in plan


def test_texts_of_posts_are_made_once(spark):
    """The text of an image post takes a join and a rank over the comments; evidence reads it several times."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(t):
        made.add(1)
        return t

    v = spark.createDataFrame([("vid00000001", "secret maze", "gardenia", [], "2024-05-10 00:00:00")],
                              "video_id string, title string, channel_title string, tags array<string>, published_at string")
    posts = spark.createDataFrame([(f"p{i}", "gardenia secret maze", "maze", 3, 0, "2024-05-11 00:00:00") for i in range(7)],
                                  "post_id string, raw string, subreddit string, score bigint, num_comments bigint, created_at string")
    v, posts = [d.withColumn(c, F.col(c).cast("timestamp")) for d, c in ((v, "published_at"), (posts, "created_at"))]
    found = fingerprint.collect_by_tier(posts.withColumn("text", text("raw")), v, fingerprint.fingerprints(v))
    assert found.count() == 7 and made.value == 7


def test_word_rows_carry_their_text_once(spark):
    """The words of a text stay one narrow row; repeated words and pairs are not written again for each neighbour."""
    posts = spark.createDataFrame([("a", "One  two\tone two"), ("b", ""), ("c", None)], "post_id string, text string")
    words = fingerprint.text_words(posts, "post_id", "text")
    assert {(r.post_id, tuple(r.w)) for r in words.collect()} == {("a", ("one", "", "two", "one", "two")), ("b", ("",))}
    assert sorted(tuple(r) for r in fingerprint._each_word(words, "post_id").collect()) == [("a", "one"), ("a", "two")]
    assert sorted(tuple(r) for r in fingerprint._word_pairs(words, "post_id").collect()) == [("a", "one", "two"), ("a", "two", "one")]


def test_tier_gate_spam_and_window(spark):
    v = spark.createDataFrame([("vid00000001", "Secret Garden Maze Tour", "Gardenia", [], "2024-05-10 00:00:00")],
                              "video_id string, title string, channel_title string, tags array<string>, p string")
    v = v.withColumn("published_at", F.to_timestamp("p")).drop("p")
    post = lambda i, text, score=1, sub="ok", day="2024-05-11": (f"p{i:02d}", sub, text, score, 0, day)
    link, phrase = "https://youtu.be/vid00000001", "gardenia: secret garden maze tour"
    rows = [post(i, link, -5) for i in range(9)]
    rows += [post(20, phrase), post(21, phrase, -1), post(22, phrase, sub="spam_x"), post(23, phrase, day="2024-05-01")]
    rows += [post(30, "gardenia garden secret maze"), post(31, "gardenia tour of secret maze")]
    schema = "post_id string, subreddit string, text string, score bigint, num_comments bigint, d string"
    make = lambda r: spark.createDataFrame(r, schema).withColumn("created_at", F.to_timestamp("d"))
    got = fingerprint.collect_by_tier(make(rows), v, fingerprint.fingerprints(v))
    assert sorted(r["post_id"] for r in got.collect()) == [f"p{i:02d}" for i in range(9)] + ["p20"]
    got = fingerprint.collect_by_tier(make(rows[5:]), v, fingerprint.fingerprints(v))
    assert {"p30", "p31"} <= {r["post_id"] for r in got.collect()}


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("plan", [{}, {"matrix_rows": 3, "block_rows": 7, "slice_rows": 11}])
def test_best_match_equals_numpy(spark, plan):
    rng = np.random.default_rng(3)
    q, c = unit(rng, 60, 16), unit(rng, 25, 16)
    c[4] = c[19]  # a tie: the smaller id wins
    q[0] = c[4]
    d = spark.createDataFrame([(f"d{i:02d}", v.tolist()) for i, v in enumerate(q)], "platform_id string, embedding array<float>")
    k = spark.createDataFrame([(f"v{i:02d}", v.tolist()) for i, v in enumerate(c)], "video_id string, embedding array<float>")
    got = {r["platform_id"]: (r["video_id"], r["similarity_score"]) for r in semantic.best_match(d, k, 0.3, **plan).collect()}
    # Unusable vectors take no part; rows of one key count together.
    d = d.union(spark.createDataFrame([("n1", None), ("n2", [1.0, 2.0]), ("n3", [None] * 16), ("d01", c[7].tolist())], d.schema))
    k = k.union(spark.createDataFrame([("v90", None), ("v91", [1.0])], k.schema))
    got = {r["platform_id"]: (r["video_id"], r["similarity_score"]) for r in semantic.best_match(d, k, 0.3, **plan).collect()}
    assert got.pop("d01") == ("v07", 1.0)
    q[1] = 0
    s = np.round(np.clip(q.astype(float) @ c.T.astype(float), 0, 1), 9)
    want = {f"d{i:02d}": (f"v{s[i].argmax():02d}", round(float(s[i].max()), 4)) for i in range(60) if s[i].max() >= 0.3}
    assert got.keys() == want.keys() and got["d00"][0] == "v04"
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) <= 1e-4 for i in want)


def test_no_candidates(spark):
    d = spark.createDataFrame([("d", [1.0])], "platform_id string, embedding array<float>")
    assert semantic.best_match(d, d.select(F.lit("v").alias("video_id"), "embedding").limit(0)).count() == 0


def test_tfidf_fixture(spark):
    c = spark.createDataFrame([("c1", "Python programming language asynchronous await event loop guide"), ("c2", "ok")],
                              "platform_id string, body string")
    v = spark.createDataFrame([("v_py", "Python Asyncio Complete Tutorial Guide", "Learn async await event loops in python")],
                              "video_id string, title string, description string")
    rows = semantic.tfidf_match(c, v, 0.30).collect()
    assert [(r["platform_id"], r["video_id"]) for r in rows] == [("c1", "v_py")] and rows[0]["similarity_score"] > 0.30


def test_tfidf_plans_agree_with_the_dense_search(spark, monkeypatch):
    """Repeated vectors, ties, zero vectors and null ids: broadcast, cells and the dense search find the same rows, and the
    candidates that are compared are the distinct vectors (every one of them was, before)."""
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(words, n))
    texts = [say(4) for _ in range(60)]
    c = spark.createDataFrame([(f"c{i % 150:03d}", say(25)) for i in range(160)] + [("z", "nothing " * 9), (None, say(25))], "platform_id string, body string")
    v = spark.createDataFrame([(f"v{i:03d}", texts[i * 7 % 60], None) for i in range(240)] + [(None, texts[3], None), ("zz", "?", None)],
                              "video_id string, title string, description string")
    d = semantic.discussion_texts(c).select("platform_id", F.col("clean_text").alias("text"))
    vt = v.select("video_id", semantic.video_text(F.col("title"), F.col("description"), F.col("video_id")).alias("text"))
    left, right = semantic.tfidf_vectors(d, vt, size=32)
    dense = lambda df: df.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.coalesce(
        F.try_element_at(F.map_from_arrays("embedding.indices", "embedding.values"), i), F.lit(0.0))))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for threshold in (0.1, 0.45):
        want = rows(semantic.best_match(dense(left), dense(right), threshold))
        assert len(want) > 50
        assert rows(semantic.match_sparse(left, right, threshold, size=32)) == want
        assert rows(semantic.match_sparse(left, right, threshold, size=32, matrix_rows=1, block_rows=16, slice_rows=50)) == want
    seen = []
    monkeypatch.setattr(semantic, "settled", lambda df, name="": seen.append((name, df.count())) or df)
    semantic.match_sparse(left, right, 0.1, size=32)
    assert dict(seen)["candidates"] <= 61 < right.count()


def test_encoder_hook(spark):
    t = spark.createDataFrame([("a", "xx"), ("b", "")], "platform_id string, clean_text string")
    load = lambda: lambda texts: np.array([[len(x), 0.0] for x in texts])
    rows = semantic.encode(t, load, "platform_id").orderBy("platform_id").collect()
    assert [list(r["embedding"]) for r in rows] == [[1.0, 0.0], [1.0, 0.0]]


def test_youtube_counts_resolve_legacy_parents(spark):
    c = spark.createDataFrame([
        ("youtube", "v1", "ch", "positive"), ("youtube", None, "v1", "negative"), ("youtube", "gone", "v2", "neutral"),
        ("youtube", "v2", "v1", "neutral"), ("reddit", "v1", "x", "positive"), ("youtube", "v1", "ch", None),
    ], "platform string, video_id string, parent_id string, sentiment_label string")
    v = spark.createDataFrame([("v1",), ("v2",)], "video_id string")
    got = {r["video_id"]: (r["n"], r["pos"], r["neu"], r["neg"]) for r in linking.youtube_label_counts(c, v).collect()}
    assert got == {"v1": (2, 1, 0, 1), "v2": (2, 0, 2, 0)}


def test_vectors_that_cannot_be_compared(spark):
    """Null, short and empty vectors, NaN and infinite components take no part, on either side and in either plan."""
    nan, inf = float("nan"), float("inf")
    bad = [[nan, 0.0], [inf, 0.0], [-inf, 1.0], [None, 1.0], [1.0], [], None]
    d = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])] + [(f"x{i}", v) for i, v in enumerate(bad)], "platform_id string, embedding array<float>")
    v = spark.createDataFrame([(f"v{i}", [1.0, 0.0]) for i in range(3)] + [(f"y{i}", v) for i, v in enumerate(bad)], "video_id string, embedding array<float>")
    for plan in ({}, {"matrix_rows": 1, "block_rows": 2, "slice_rows": 2}):
        assert [(r[0], r[1], r[3]) for r in semantic.best_match(d, v, **plan).collect()] == [("a", "v0", 1.0)]
    assert {r["platform_id"] for r in semantic.rejected(d, v).collect()} == {f"x{i}" for i in range(7)}


def test_candidate_index_recall(spark):
    """Clustered directions, one cell far larger than the others: recall over 0.9, and scores of the exact plan."""
    rng = np.random.default_rng(3)
    centre = unit(rng, 30, 16)
    near = lambda n, i: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(centre[i] + 0.25 * rng.normal(size=(n, 16)))
    which = np.where(rng.random(600) < 0.4, 0, rng.integers(0, 30, 600))
    v = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(near(600, which))], "video_id string, embedding array<float>")
    d = spark.createDataFrame([(f"d{i:03d}", x.tolist()) for i, x in enumerate(near(300, rng.integers(0, 30, 300)))], "platform_id string, embedding array<float>")
    exact = semantic.best_match(d, v, 0.3).cache()
    found = semantic.best_match(d, v, 0.3, index_cells=24, probes=4, block_rows=50, slice_rows=40)
    assert found.groupBy("platform_id").count().where("count > 1").count() == 0
    assert semantic.recall(found, exact) >= 0.9 and exact.count() > 250
    assert semantic.recall(semantic.best_match(d, v, 0.3, index_cells=24, probes=24), exact) == 1.0
    assert semantic.best_match(d, v.limit(0), 0.3, index_cells=4).count() == 0
    assert semantic.best_match(d.limit(0), v, 0.3, index_cells=4).count() == 0
