"""Token ids against the reference library of the format, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from wakeline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CASES = [
    "", "   ", "a\n b", "a  x", "é" * 300, "ab" * 2000, " " * 3000, "x" * 5000, "don't we'll  \n\n x\t\ty <|endoftext|>",
    "日本語テキスト", "1234567 12 ", "\x1c a \x1c\n", "word\xa0 next", "\x00\x01", "😀👍🏽 emoji",
]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    texts = CASES + ["".join(rng.choice("ab \n\tcé'1. 日　-\xa0") for _ in range(rng.randint(0, 200))) for _ in range(500)]
    got = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text


def test_rows(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate([*CASES, None, CASES[3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(r.ids) // 4
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode(df.select("doc_id", "text", F.lit(None).cast("int").alias("extra")), PATH, public_tokenizers.PATTERN).columns[2] == "extra"
