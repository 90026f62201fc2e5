"""Variants against plain comparison of all words, with and without crowded signatures."""

import random
import re
import zlib
from collections import Counter

import pytest

from wakeline.llm import spelling
from wakeline.session import Workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows, least):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    out = {}
    for w, c in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 5 * c else None
        out[w] = [c, len(others), form, words[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return out


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeéÿ", k=rng.randint(5, 9))) for _ in range(40)] + ["aaaaaa", "ababab", "x" * 300]
    words = set(base)
    for _ in range(2):
        for w in list(words):
            for _ in range(3):
                i, c = rng.randrange(len(w) + 1), rng.choice("abcdeéÿ")
                words.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]]))
    words = sorted(words)
    rows = []
    for i in range(150):
        picked = rng.choices(words, k=80) + rng.choices(words[:40], k=80) * 3
        rows.append((i if i % 9 else None, " ".join(w.upper() if rng.random() < 0.1 else w for w in picked)))
    chain = " ".join(["Chaina"] * 7 + ["chainab"] * 50 + ["schainab"] * 400)
    return rows + [(5, chain), (1, None), (2, ""), (3, "12 34 ×÷ıſ"), (4, "aaaaaa," * 300)] + rows[:3]


@pytest.mark.parametrize("options", [{}, {"crowd": 4}, {"crowd": 0}, {"parts": 2, "pieces": 3}, {"parts": 3, "pieces": 2}])
def test_variants_equal_plain_comparison(spark, options):
    rows = corpus(7)
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, word string, n int")
    with Workspace(spark) as work:
        got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in spelling.group(work, df, **options).collect()}
    want = expected(rows, 5)
    assert got == want and len(want) > 200 and sum(v[2] is not None for v in want.values()) > 10
    assert any(v[4] not in (w, v[2]) for w, v in want.items() if v[2])  # a chain of two forms


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK_BYTES", 50)
    rows = [(1, "élongated Wörds " * 500), (2, "a" * 5000 + " " + "é" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.occurrences(df).collect()}
    want = expected(rows, 1)
    assert {w: n for w, n in got.items() if len(w) >= 6} == {w: v[0] for w, v in want.items()}


def test_empty_table(spark):
    with Workspace(spark) as work:
        assert spelling.group(work, spark.createDataFrame([], "doc_id long, text string")).count() == 0
