"""Repeated runs of sentences against a plain recomputation."""

import random

from wakeline.llm import spans

PASSAGE = ("The old mill by the river had not turned for nine years. Its wheel was green with moss and full of nests. "
           "Every spring the children came to count the eggs! Nobody told them that the miller watched from his window. "
           "He had counted them first, and he liked to be right about such things.")


def filler(seed, n=8):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) + rng.choice(["", "", ".", "?"]) for _ in range(n * 6)) + ". "


def expected(rows, min_sentences=2, min_words=25):
    """First occurrence of every run, then every covered piece of the others."""
    first, every = {}, []
    for doc, text in sorted(rows):
        pieces = spans.sentences(text)
        for i in range(len(pieces)):
            words, n, used = [], 0, 0
            for j in range(i, len(pieces)):
                w = pieces[j].lower().split()
                if not w and j == i:
                    break
                words.append(" ".join(w))
                n, used = n + len(w), used + bool(w)
                if n >= min_words and used >= min_sentences:
                    key = "\n".join(x for x in words if x)
                    every.append((key, doc, i, j))
                    first[key] = min(first.get(key, (doc, i)), (doc, i))
                    break
    gone = {(doc, k) for key, doc, i, j in every if first[key] != (doc, i) for k in range(i, j + 1)}
    return {doc: "".join(p for k, p in enumerate(spans.sentences(text)) if (doc, k) not in gone) for doc, text in rows}


def test_passages_are_cut_once(spark):
    rows = [(i, filler(i) + (PASSAGE + " " if i % 3 == 0 else "") + filler(1000 + i)) for i in range(30)]
    rows += [(100, rows[4][1]), (101, PASSAGE + "\n" + PASSAGE), (102, "Short. Text. Short. Text."), (103, "Short. Text. Short. Text.")]
    out = {r.doc_id: r for r in spans.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.text for d, r in out.items()} == expected(rows)
    assert "counted them first" in out[0].text and all("counted them first" not in out[i].text for i in range(3, 30, 3))
    assert out[100].text == "" and out[101].text == "" and out[102].n_removed == 0 == out[103].n_removed


def test_pieces_make_the_text():
    for text in ("", "a", "...\n\n", " a. b.\n c", "word " * 500, PASSAGE):
        assert "".join(spans.sentences(text)) == text
    assert max(len(p.split()) for p in spans.sentences(" ".join(f"w{i}" for i in range(5000)))) < 100


def test_defined_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, PASSAGE, "c"), (3, PASSAGE, "c"), (None, PASSAGE, "d"), (4, PASSAGE + " x", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    out = [(r.doc_id, r.text) for r in spans.deduplicate(df).collect()]
    assert sorted(out, key=str) == sorted([(1, None), (2, ""), (3, ""), (3, ""), (None, PASSAGE), (4, "x")], key=str)
    assert spans.deduplicate(df.limit(0)).count() == 0
