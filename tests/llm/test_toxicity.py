"""Held-out accuracy on planted words, and the defined cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from wakeline.llm import toxicity
from wakeline.session import Workspace

BASE = ["the", "of", "river", "stone", "window", "walks", "green", "seven", "paper", "cloud", "little", "under"]
STEM, ENDS = "grolm", ["ig", "ant", "elo", "ur", "yx", "ath", "one", "ik", "esp", "arv"]


def corpus(n):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = [rng.choice(BASE) + rng.choice(["", "s", "y", "en"]) for _ in range(rng.randint(15, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rng.randrange(len(words)), STEM + rng.choice(ENDS))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_documents(spark):
    rows = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").filter("doc_id % 2 = 0 OR doc_id % 3 = 0")
    out = toxicity.fit(docs.drop("toxic"), labels, Workspace(spark)).score(docs.withColumn("score", F.lit("clash"))).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "word " * 30_000), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    out = toxicity.fit(docs, none, Workspace(spark)).score(docs).collect()
    assert len(out) == 5 and len({r.score for r in out}) == 1 and all(r.predicted == 0 for r in out)
    empty = toxicity.fit(docs.limit(0), none.limit(0), Workspace(spark)).score(docs.limit(0))
    assert empty.count() == 0


def test_several_labels_of_one_document(spark):
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").union(docs.select("doc_id", F.lit(0).alias("toxic")))
    assert toxicity.fit(docs.drop("toxic"), labels, Workspace(spark)).score(docs.select("doc_id", "text")).count() == 60


def kneser_ney(texts):
    """Log ratio of a word under both classes, from the definition; ``texts`` holds (text, class or None)."""
    per, pairs = (defaultdict(Counter), defaultdict(Counter)), set()
    for text, label in texts:
        for w in re.findall(r"[^\W_]+", (text or "").lower()):
            s = f"^{w}$"
            for k in range(1, len(s)):
                pairs.add((s[max(0, k - 7):k], s[k]))
                if label is not None:
                    per[label][s[max(0, k - 7):k]][s[k]] += 1
    orders = []
    for n in (3, 1, 0):
        level, longer = defaultdict(Counter), {(c[len(c) - min(n, len(c)):], x, c) for c, x in pairs}
        for c, x, _ in longer:
            level[c][x] += 1
        orders.append(level)
        pairs = {(c, x) for c, x, _ in longer}
    letters = len(orders[2][""]) + 1

    def shared(c, x, at=0):
        if at == 3:
            return 1 / letters
        n = (3, 1, 0)[at]
        c = c[len(c) - min(n, len(c)):]
        counts = orders[at][c]
        return (max(counts[x] - 0.75, 0) + 0.75 * len(counts) * shared(c, x, at + 1)) / sum(counts.values())

    def probability(label, c, x):
        counts = per[label][c]
        if not counts:
            return shared(c, x)
        total = sum(counts.values())
        return max(counts.get(x, 0) - 0.75, 0) / total + 0.75 * len(counts) / total * shared(c, x)

    def ratio(word):
        s, out = f"^{word}$", 0.0
        for k in range(1, len(s)):
            c = s[max(0, k - 7):k]
            if per[0][c] or per[1][c]:
                if per[0][c][s[k]] + per[1][c][s[k]]:
                    out += math.log(probability(1, c, s[k]) / probability(0, c, s[k]))
                else:
                    freed = [0.75 * sum(v > 0 for v in per[i][c].values()) / sum(per[i][c].values()) if sum(per[i][c].values()) else 1 for i in (0, 1)]
                    out += math.log(freed[1] / freed[0])
        return out

    return ratio


@pytest.mark.parametrize("entries", [toxicity.MODEL_ENTRIES, 0])
def test_features_equal_the_definition(spark, entries):
    """By broadcast arrays, and with more entries than may be broadcast, by joins."""
    rows = corpus(90) + [(200, "Éa ß_x 77 grolmig grolmig grolmig", 1), (201, "", 0), (202, None, 0), (203, "unseen wording", 0)] + corpus(3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, Workspace(spark), model_entries=entries)
    got = model.add_features(docs, "text").collect()
    known = {i: x for i, _, x in rows if i % 3 and zlib.crc32(str(i).encode()) % 4 < 2}
    ratio = kneser_ney([(t, known.get(i)) for i, t, _ in rows])
    assert len(got) == len(rows)
    for r in got:
        values = [ratio(w) for w in re.findall(r"[^\W_]+", (r.text or "").lower())]
        n, best = len(values), (sorted(values, reverse=True) + [0.0] * 3)[:3]
        want = [sum(values) / n, sum(max(v - 2, 0) for v in values) / n, *best, math.log1p(n)] if n else [0.0] * 6
        assert list(r.features) == pytest.approx(want, abs=1e-9)
