"""Elias-Fano lists, token files against the library itself, offsets over several files."""

import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wakeline.llm import tokenfile
from wakeline.session import Workspace

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part string, ids string, base long"


def library():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (1, 1 << 62), (5, 3), (1000, 10), (3000, 1 << 40), (700, (1 << 64) - 1)])
def test_every_run_of_a_packed_list(n, top):
    rng = random.Random(n + top)
    values = np.array(sorted(rng.randint(0, top) for _ in range(n)), np.uint64)
    raw = tokenfile.pack(values)
    got = tokenfile.EliasFano(memoryview(raw))
    assert got.select(0, n).tolist() == values.tolist()
    for _ in range(50):
        a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
        assert got.select(a, b).tolist() == values[a:b].tolist()


def test_space_of_a_packed_list():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000)).astype(np.uint64)
    bits = 8 * len(tokenfile.pack(values)) / len(values)
    assert bits < 2 + np.log2(500) + 1.5  # a 64-bit table has 64


def test_pieces_encode_as_whole_texts():
    rng, plain = random.Random(5), library()
    letters = [" ", "  ", "\n", "\r\n", "\t", "\xa0", " ", "᠎", "​", "\x0b", "\x1c", "\x85", "a", "É", "ß", "中", "'s", "'ll", "1", "٣", "!", "<|endoftext|>",
               "😀", "́", "word", "'", "ʼ", "²", "_"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(20_000)]
    with open(PATH, encoding="utf-8") as f:
        encoder = tokenfile.Encoder(f.read())
    want = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    for array in (pa.array(texts), pa.array(["x", *texts]).slice(1), pa.array([t for t in texts if not tokenfile._ODD_SPACE.search(t)])):
        ids, lengths = encoder.encode(array)
        expected = want if len(array) == len(texts) else [w for w, t in zip(want, texts, strict=True) if not tokenfile._ODD_SPACE.search(t)]
        cuts = np.cumsum(lengths)
        assert [ids[b - n:b].tolist() for b, n in zip(cuts, lengths, strict=True)] == expected
    assert encoder.encode(pa.array(["", ""]))[1].tolist() == [0, 0]


def test_a_long_text_is_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(tokenfile, "BATCH_BYTES", 1000)
    with open(PATH, encoding="utf-8") as f:
        encoder = tokenfile.Encoder(f.read())
    rng = random.Random(9)
    for text in ("".join(rng.choices(["word", " ", "\n", "  ", "é", "12", ",", "'s", "Zz"], k=20_000)), "x" * 5000 + " y" * 3000, " " * 70_000 + "end", "z" * 80_000):
        ids, n = encoder.encode(pa.array([text]))
        assert n.tolist() == [len(ids)] and ids.tolist() == library().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file_bytes", [200, 1 << 30])
def test_round_trip(spark, file_bytes):
    texts = [None, "", "one two", "  three\n\nfour ", "x" * 50_000, "long words " * 3000, "çédille 中文", "one two"]
    rows = [(i * 1000 - 3000, t, "p", "x", i) for i, t in enumerate(texts)] + [(None, "nameless", "p", "x", 0), (7, "b", "", "", 0), (7, "a", "", "", 0), (7, "a", "", "", 0)]
    rows += [(1 << 62, "far", None, None, None)]
    with Workspace(spark) as work:
        path = work.path("files")
        tokenfile.write(spark.createDataFrame(rows, SCHEMA), path, PATH, 2, file_bytes)
        files = tokenfile.manifest(spark, path).orderBy("part").collect()
        got = tokenfile.read(spark, path).orderBy("start").collect()
    plain, at = library(), 0
    assert (len(files) > 1) == (file_bytes == 200) and sum(f.documents for f in files) == len(rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    left = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in rows]
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        left.remove((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()))
        at += r.n_tokens
    assert not left


def test_empty_table(spark):
    with Workspace(spark) as work:
        path = work.path("files")
        tokenfile.write(spark.createDataFrame([], SCHEMA), path, PATH, 2)
        assert tokenfile.read(spark, path).count() == 0


def test_another_file_is_refused():
    with pytest.raises(ValueError):
        tokenfile.TokenFile(memoryview(bytes(100)))


def test_tasks_hold_little_and_workers_keep_no_encoder(spark, monkeypatch):
    """Twenty megabytes of text fill three files, and the broadcast that holds the encoder ends with the job."""
    shared, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: shared.append(broadcast(value)) or shared[-1])
    with Workspace(spark) as work:
        path = work.path("files")
        rows = spark.range(20).select(F.col("id").alias("doc_id"), F.expr("repeat('some words ', 95000)").alias("text"))
        tokenfile.write(rows, path, PATH, 2)
        assert tokenfile.manifest(spark, path).count() == 3
    assert len(shared) == 1 and not os.path.exists(shared[0]._path)
