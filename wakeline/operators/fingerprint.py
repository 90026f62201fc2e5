"""Video fingerprints and text evidence that a post talks about a video.

Evidence has three tiers: the video id in the text (1.0); a safe creator name and a distinctive phrase
(0.90); a safe creator name and at least 60 % (and three) of the title words (0.80 to 0.95).

The tests are substring tests, so the obvious plan is a nested-loop join. Instead both sides are keyed by
what a match cannot avoid, which turns every tier into hash joins followed by the exact test:

* an id of 11 characters lies in a run of id characters, so it equals one of the run's 11-grams;
* the only word of a name or phrase lies inside one word of the text, and its first five characters are a 5-gram
  of that word;
* a name or phrase of several words is an inverted index entry with positions: its neighbouring words stand next to
  each other in the text, the left one at the end of a text word, the right one at the start of the next. The same
  words in another order, or apart, meet nothing;
* with n title words and k needed, any n-k+1 of them include a matched one, so only the rarest n-k+1 have
  to be looked up, and only in texts that mention a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_to
from .. import fixed_values as V
from ..functions import text as tx
from ..session import settled

_GRAM, _KEY = 5, 16  # characters by which words and parts meet, first and finally
_NO_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_NO_STRINGS)


def _by_length(words: Column) -> Column:
    """Longest first; equal lengths keep their order."""
    keyed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda s: s["w"])


def fingerprints(videos: DataFrame) -> DataFrame:
    """``video_id, title, channel_title, tags, published_at`` → fingerprint columns (all narrow)."""
    # Computed column by column, so no expression is repeated inside another one.
    v = videos.select(
        "video_id", "published_at",
        F.coalesce("title", F.lit("")).alias("title"),
        tx.strip(F.coalesce("channel_title", F.lit(""))).alias("channel"),
        F.coalesce("tags", _none()).alias("tags"),
    ).repartition("video_id")  # a listing is small in bytes and may be one split, the expressions are not cheap
    v = v.withColumns({
        "title_lower": F.lower("title"),
        "creator": tx.strip(F.regexp_replace(
            F.lower(tx.strip(F.regexp_replace("channel", V.CREATOR_SUFFIX_RE, ""))), r"[^a-z\s]", ""
        )),
        "tags_lower": F.transform("tags", lambda t: tx.strip(F.lower(t))),
        "first_tags": F.slice("tags", 1, 5),
    })
    title_lower, creator = F.col("title_lower"), F.col("creator")

    alias_map = F.create_map(
        *[x for k, names in V.CREATOR_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in names]))]
    )
    tag_names = F.filter(
        "tags_lower",
        lambda t: t.rlike(r"^[\p{L}\p{N}]{3,}$")
        & ~F.contains(title_lower, t)
        & (creator != "")
        & (F.contains(creator, t) | F.contains(t, creator)),
    )
    v = v.withColumns({
        "own_names": F.when(creator == "", _none()).otherwise(
            F.concat(F.array(creator), F.filter(F.split(creator, r"\s+"), lambda w: F.length(w) >= 3))
        ),
        "aliases": F.coalesce(F.try_element_at(alias_map, creator), _none()),
        "tag_names": tag_names,
        "title_words": F.filter(
            F.array_distinct(F.regexp_extract_all(title_lower, F.lit("[a-zA-Z]{3,}"), F.lit(0))),
            lambda w: ~w.isin(V.TITLE_STOP_WORDS),
        ),
        "bracketed": F.filter(
            F.transform(F.regexp_extract_all("title", F.lit(V.BRACKET_PHRASE_RE), F.lit(1)), tx.strip),
            lambda p: (F.length(p) >= 2) & ~F.lower(p).isin(V.GENERIC_SEGMENTS),
        ),
        "segments": F.filter(
            F.transform(
                F.split("title", V.SEGMENT_SPLIT_RE), lambda s: tx.strip(F.regexp_replace(s, V.BRACKETED_RE, ""))
            ),
            lambda s: F.length(s).between(4, 60)
            & ~F.lower(s).isin(V.GENERIC_SEGMENTS)
            & (F.lower(s) != F.lower("channel")),
        ),
    })
    full_text = F.concat_ws(
        " ", *[F.nullif(c, F.lit("")) for c in (F.col("title"), F.col("channel"), F.array_join("first_tags", " "))]
    )
    return v.select(
        "video_id",
        F.array_distinct(F.concat("own_names", "aliases", "tag_names")).alias("creator_variants"),
        _by_length(F.col("title_words")).alias("topic_words"),
        F.array_distinct(F.concat("bracketed", "segments")).alias("distinctive_phrases"),
        F.filter(F.transform("first_tags", lambda t: F.lower(tx.strip(t))), lambda t: t != "").alias("tag_phrases"),
        F.col("title").alias("title_raw"),
        full_text.alias("full_text"),
        "published_at",
    )


def safe_variants(variants: Column) -> Column:
    """Names precise enough to match on: two words, or at least five characters."""
    return F.filter(variants, lambda v: F.contains(v, F.lit(" ")) | (F.length(v) >= 5))


def needed_words(n: Column) -> Column:
    """Title words that have to be present: 60 %, at least three (impossible below three words)."""
    return F.greatest(F.ceil(n * 6 / F.lit(10.0)), F.lit(3)).cast("int")


def coverage_score(matched: Column) -> Column:
    return round_to(F.least(0.80 + 0.05 * F.greatest(matched - 3, F.lit(0)), F.lit(0.95)), 3)


def evidence(text_lower: Column, fp: Column) -> Column:
    """Exact test of one text against one fingerprint: struct(match_type, similarity_score) or NULL."""
    has = lambda p: F.contains(text_lower, F.lower(p))
    by_name = F.exists(safe_variants(fp["creator_variants"]), lambda v: F.contains(text_lower, v))
    by_phrase = F.exists(fp["distinctive_phrases"], has)
    n_words = F.size(fp["topic_words"])
    matched = F.size(F.filter(fp["topic_words"], lambda w: F.contains(text_lower, w)))

    def verdict(tag: str, score: Column) -> Column:
        return F.struct(F.lit(tag).alias("match_type"), score.cast("double").alias("similarity_score"))

    return (
        F.when(F.contains(text_lower, F.lower(fp["video_id"])), verdict("url", F.lit(1.0)))
        .when(by_name & by_phrase, verdict("phrase_match", F.lit(0.90)))
        .when(
            by_name & (n_words >= 3) & (matched >= 3) & (matched / n_words >= 0.60),
            verdict("title_match", coverage_score(matched)),
        )
    )


def _id_grams(text_lower: Column) -> Column:
    runs = F.regexp_extract_all(text_lower, F.lit(r"[a-z0-9_\-]{11,}"), F.lit(0))
    grams = F.transform(
        F.array_distinct(runs),
        lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 10), lambda i: F.substring(r, i, F.lit(11))),
    )
    return F.array_distinct(F.flatten(grams))


def text_words(posts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, w``: the words of each text in their order, one narrow row a text."""
    return posts.select(key, tx.runs(F.lower(text)).alias("w")).where(F.col("w").isNotNull())


def _each_word(words: DataFrame, *key: str) -> DataFrame:
    """``key, word``: each word of a text once."""
    # explode_outer: a plain explode would evaluate the array a second time for an inferred size filter.
    return words.select(*key, F.explode_outer(F.array_distinct("w")).alias("word")).where("word <> ''")


def _word_pairs(words: DataFrame, key: str) -> DataFrame:
    """``key, word, next``: words that stand next to each other."""
    places = words.select(key, "w", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1)))).alias("at"))
    pairs = places.select(key, F.element_at("w", F.col("at")).alias("word"), F.try_element_at("w", F.col("at") + 1).alias("next"))
    return pairs.where("word <> '' AND next <> ''")


def _words_that(hold: str, vocabulary: DataFrame, parts: DataFrame) -> DataFrame:
    """``word, part``: words of the vocabulary that contain a part, or that have it as their ``start`` or ``end``.

    The first characters of the parts (``heads``, few and usually broadcast) leave only the places of words where a part
    may begin. Those meet the parts on up to ``_KEY`` characters, so that parts which begin alike stay apart; then the
    test is exact. Hashes of the first characters do, as the parts settle what they let through."""
    end = hold == "end"
    key = F.substring("part", -_KEY if end else 1, _KEY)
    gram = F.substring(key, -_GRAM if end else 1, _GRAM)
    index = parts.select("part", key.alias("key")).where("key <> ''")
    heads = settled(index.select(F.xxhash64(gram).alias("gram"), F.length("key").alias("size")).distinct(), "heads")
    lengths = sorted(r[0] for r in heads.select(F.least("size", F.lit(_GRAM))).distinct().collect())  # at most five
    word, n = F.col("word"), F.length("word")
    if not lengths:
        return parts.select(F.col("part").alias("word"), "part").where(F.lit(False))
    last = F.greatest(n - lengths[0] + 1, F.lit(1)) if hold == "contains" else F.lit(1)
    begins = vocabulary.where(n >= lengths[0]).select("word", F.explode_outer(F.sequence(F.lit(1), last)).alias("at"))
    begins = begins.select("word", "at", F.explode_outer(F.array(*map(F.lit, lengths))).alias("n"))
    found = F.substring(word, -F.col("n") if end else F.col("at"), F.col("n"))
    begins = begins.select("word", "at", F.xxhash64(found).alias("gram")).join(heads, "gram")
    cut = F.substring(word, -F.col("size") if end else F.col("at"), F.col("size"))
    fits = {"contains": F.contains, "start": F.startswith, "end": F.endswith}[hold](word, F.col("part"))
    return begins.select("word", cut.alias("key")).distinct().join(index, "key").where(fits).select("word", "part").distinct()


def words_with(words: DataFrame, vocabulary: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(post, part) rows where some word of the post contains the part (column ``part``). The test runs once per distinct
    word of the corpus; posts only join the words that passed."""
    hits = settled(_words_that("contains", vocabulary, parts), "hits")
    return _each_word(words, key).join(hits, "word").select(key, "part").distinct()


def phrase_places(texts: DataFrame, vocabulary: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """``key, phrase``: posts in which a phrase (lower case) may stand; none in which it does is missing.

    Of a phrase with several words the rarest pair of neighbours is joined; a phrase whose other pairs occur nowhere
    has no place. One without neighbours (a single word, or words with more than one space between) is looked up by
    its longest word."""
    words = phrases.select("phrase").distinct().withColumn("w", tx.runs(F.col("phrase")))
    twos = F.filter(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w")).alias("b")),
                    lambda p: (p["a"] != "") & (p["b"] != ""))
    words = words.withColumn("twos", F.when(F.size("w") > 1, twos).otherwise(F.slice(twos, 1, 0)))
    single = words.where(F.size("twos") == 0).select("phrase", F.element_at(_by_length(F.col("w")), 1).alias("part"))
    found = words_with(texts, vocabulary, single.select("part").distinct(), key).join(single, "part").select(key, "phrase")

    two = settled(words.select("phrase", F.explode("twos").alias("p")).select("phrase", "p.a", "p.b").distinct(), "pairs")
    # Settled, so that their sizes are known: small ones are broadcast and the pairs of the texts are not shuffled.
    ends = settled(_words_that("end", vocabulary, two.select(F.col("a").alias("part")).distinct()), "ends")
    starts = settled(_words_that("start", vocabulary, two.select(F.col("b").alias("part")).distinct()), "starts")
    beside = _word_pairs(texts, key).join(ends.withColumnRenamed("part", "a"), "word").join(
        starts.select(F.col("word").alias("next"), F.col("part").alias("b")), "next")
    places = settled(beside.join(two.select("a", "b").distinct(), ["a", "b"], "left_semi").select(key, "a", "b").distinct(), "places")
    seen = places.groupBy("a", "b").agg(F.count("*").alias("posts"))
    rarest = two.join(seen, ["a", "b"], "left").groupBy("phrase").agg(
        F.min_by(F.struct("a", "b"), F.struct("posts", "a", "b")).alias("p"), F.count_if(F.col("posts").isNull()).alias("absent")
    ).where("absent = 0").select("phrase", "p.a", "p.b")
    return found.unionByName(places.join(rarest, ["a", "b"]).select(key, "phrase"))


def id_matches(posts: DataFrame, videos: DataFrame, key: str = "post_id", text: str = "text") -> DataFrame:
    """Tier 1 over whole tables: posts whose text contains a video's id, as a hash join on 11-grams."""
    grams = posts.select(key, F.explode_outer(_id_grams(F.lower(text))).alias("gram"))
    ids = videos.select("video_id", F.lower("video_id").alias("gram"))
    return grams.join(ids, "gram").select(key, "video_id")


def verify(
    posts: DataFrame, prints: DataFrame, key: str = "post_id", text: str = "text"
) -> DataFrame:
    """All (post, video) pairs with evidence: ``key, video_id, match_type, similarity_score``.

    A text match needs a creator name and, with it, a phrase or enough title words. So posts are first looked
    up by names (distinct names, so one shared by many videos costs one lookup), then by (name, phrase) or
    (name, rare title word) together. Only pairs that agree on both are tested in full.
    """
    by_id = settled(id_matches(posts, prints, key, text), "ids").select(
        key, "video_id", F.lit("url").alias("match_type"), F.lit(1.0).alias("similarity_score")
    )
    pairs = candidate_pairs(posts, prints, key, text).join(by_id.select(key, "video_id"), [key, "video_id"], "left_anti")

    # The exact test. Both lookups are on unique keys; AQE splits a hot post or a hot video.
    fp = F.struct(*[F.col(f"p.{c}").alias(c) for c in (
        "video_id", "creator_variants", "distinctive_phrases", "topic_words")])
    tested = (
        pairs.join(prints.alias("p"), "video_id")
        .join(posts.select(key, F.lower(text).alias("_text")), key)
        .select(key, "video_id", evidence(F.col("_text"), fp).alias("e"))
        .where(F.col("e").isNotNull())
        .select(key, "video_id", "e.match_type", "e.similarity_score")
    )
    return by_id.unionByName(tested)


def candidate_pairs(posts: DataFrame, prints: DataFrame, key: str = "post_id", text: str = "text") -> DataFrame:
    """(post, video) pairs in which a name and a rare enough clue of the video occur; no text match is missing."""
    words = settled(text_words(posts, key, text), "words")  # one pass over the texts
    vocabulary = settled(_each_word(words).distinct(), "vocabulary")
    named = prints.select("video_id", F.explode(safe_variants(F.col("creator_variants"))).alias("name"))
    mentions = settled(phrase_places(words, vocabulary, named.select(F.col("name").alias("phrase")), key)
                       .withColumnRenamed("phrase", "name"), "mentions")
    words = settled(words.join(mentions.select(key).distinct(), key, "left_semi"), "words")

    phrases = prints.select("video_id", F.explode("distinctive_phrases").alias("phrase")).select(
        "video_id", F.lower("phrase").alias("phrase"))
    by_phrase = phrase_places(words, vocabulary, phrases, key).select(key, F.concat(F.lit("p:"), "phrase").alias("clue"))

    n_words = F.size("topic_words")
    titles = prints.where(n_words >= 3).select(
        "video_id", (n_words - needed_words(n_words) + 1).alias("keep"), F.explode("topic_words").alias("part"))
    present = settled(words_with(words, vocabulary, titles.select("part").distinct(), key), "present")
    seen = present.groupBy("part").agg(F.count("*").alias("posts"))
    rarest = Window.partitionBy("video_id").orderBy(F.coalesce("posts", F.lit(0)), F.desc(F.length("part")), "part")
    rare = (
        titles.join(seen, "part", "left").withColumn("r", F.row_number().over(rarest))
        .where((F.col("r") <= F.col("keep")) & F.col("posts").isNotNull()).select("video_id", F.concat(F.lit("w:"), "part").alias("clue"))
    )
    clues = phrases.select("video_id", F.concat(F.lit("p:"), "phrase").alias("clue")).unionByName(rare)
    by_name = named.join(clues, "video_id").select("name", "clue", "video_id").distinct()
    there = by_phrase.unionByName(present.select(key, F.concat(F.lit("w:"), "part").alias("clue")))
    there = there.join(by_name.select("clue").distinct(), "clue", "left_semi")
    return mentions.join(there, key).join(by_name, ["name", "clue"]).select(key, "video_id").distinct()


def post_text(posts: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Text a post is judged by: URL, body, title, subreddit; image posts add their first ten comments."""
    parts = [F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in ("url", "selftext", "title", "subreddit")]
    base = posts.withColumn("text", F.concat_ws(" ", *parts))
    if comments is None:
        return base
    from .ranking import top_per_group

    images = posts.where(tx.is_image_url(F.col("url"))).select("post_id")
    body = tx.strip(F.coalesce("body", F.lit("")))
    real = comments.where((body != "") & ~body.isin("[deleted]", "[removed]"))
    first = top_per_group(
        real.join(images, "post_id", "left_semi").select("post_id", "platform_id", "published_at", "body"),
        ["post_id"], [F.asc("published_at"), F.asc("platform_id")], 10,
    )
    extra = first.groupBy("post_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "body"))), lambda s: s["body"]).alias("_bodies")
    )
    joined = base.join(extra, "post_id", "left")
    return joined.withColumn(
        "text", F.concat_ws(" ", F.nullif(F.col("text"), F.lit("")), F.array_join("_bodies", " "))
    ).drop("_bodies")


def verify_together(posts: DataFrame, comments: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of posts (``post_id, text``) and of comments (``platform_id, body``), from one index over both."""
    texts = posts.select(F.concat(F.lit("p"), "post_id").alias("key"), "text").unionByName(
        comments.select(F.concat(F.lit("c"), "platform_id").alias("key"), F.col("body").alias("text")))
    found = settled(verify(settled(texts, "texts"), prints, "key"), "evidence")

    def of(kind: str, name: str) -> DataFrame:
        return found.where(F.startswith("key", F.lit(kind))).withColumn(name, F.expr("substring(key, 2)")).drop("key")

    return of("p", "post_id"), of("c", "platform_id")


def collect_by_tier(
    posts: DataFrame, videos: DataFrame, prints: DataFrame, gate: int = V.TIER_GATE_POSTS, found: DataFrame | None = None
) -> DataFrame:
    """Posts accepted for each video; ``found`` is their evidence, where it is known already.

    Spam communities never count, negative scores only by URL, and posts older than the publish window are
    out. Text tiers are used for a video only while the tiers before hold fewer than ``gate`` posts.
    """
    ok = posts.where(~tx.is_spam_subreddit(F.col("subreddit")))
    if found is None:
        found = verify(settled(ok.select("post_id", "text"), "texts"), prints)  # the text is read three times
    found = found.join(
        ok.select("post_id", "subreddit", "score", "num_comments", "created_at"), "post_id"
    ).join(videos.select("video_id", F.col("published_at").alias("_published")), "video_id")
    tier = F.when(F.col("match_type") == "url", 1).when(F.col("match_type") == "phrase_match", 2).otherwise(3)
    kept = found.withColumn("tier", tier).where(
        ((F.col("score") >= 0) | (F.col("tier") == 1))
        & tx.in_publish_window(F.col("created_at"), F.col("_published"))
    )
    sizes = kept.groupBy("video_id").agg(
        F.count_if(F.col("tier") == 1).alias("_n1"), F.count_if(F.col("tier") <= 2).alias("_n2")
    )
    before = F.when(F.col("tier") == 2, F.col("_n1")).when(F.col("tier") == 3, F.col("_n2")).otherwise(0)
    return kept.join(sizes, "video_id").where(before < gate).drop("_n1", "_n2", "_published")
