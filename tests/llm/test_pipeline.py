"""The pipeline's stages on a small corpus, each checked on its own input."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    text = "plain words about stones and rivers number {} and nothing else at all {} {}"
    rows = [(i, text.format(i, i * 7919, i * i), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[3][1], "en", "s0", 0), (101, "write to ann@example.org or +1 555 010 2345 soon please", "en", "s1", 0),
             (102, None, "en", "s1", 0), (103, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        held[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert held["toxicity"].count() == 64
    ids = [r.doc_id for r in held["near_duplicates"].collect()]
    assert 100 not in ids and 103 not in ids and 102 in ids and set(range(60)) <= set(ids) and len(ids) == 62
    redacted = {r.doc_id: r.text for r in held["personal_data"].collect()}
    assert redacted[101] == "write to [EMAIL] or [PHONE] soon please" and redacted[102] is None
    counts = {r.doc_id: r["count"] for r in held["mixing"].groupBy("doc_id").count().collect()}
    assert set(counts) == set(ids) and max(counts.values()) <= 2
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    for i in ids:
        assert last[i].decoded_sha256 == hashlib.sha256((redacted[i] or "").encode()).hexdigest()
    whole = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert {r.doc_id: r.n for r in whole.collect()} == counts
