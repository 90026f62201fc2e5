"""Base spans against plain regular expressions, the bootstrap on planted contexts, redaction."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wakeline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def accepted(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def expected(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items())
           for m in re.finditer(p, text or "") if accepted(k, m.group())]
    return [(k, s, e) for s, _, e, k in sorted(out)]


TEXTS = [
    None, "", "nothing here", "a@b", "a@b.c", "x a@b.c_d@e.f y", "a@b.c@d.e.f", "..@a-.b..c", "é😀 mail: q.w%e+r@x-y.co.uk.",
    "1.2.3.4.5.6.7.8", "999.1.1.1 0001.02.003.255 1.2.3.4.", "1.2.3", "ip 10.0.0.256",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "4111111111111112", "49927398716 4992739871600000",
    "0000 0000 0000", "+1 (555) 010-2345", "+15550102345)", "+1 2", "+12345678901234567", "+1+23456789012", "tel +49 30 1234567.",
    "\u00014111\u00011111 4111 1111 1111 1111\u0001", "9" * 3000, "1 2 " * 3000, "a.b-" * 2000 + "@x.y", "(" * 500 + "+1 555 010 2345",
    "٣٤٥٦ 4111111111111111", "a@b.c d@e.f " * 300,
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("base", F.lit(0))
    return {r.doc_id: r for r in pii.find(rows, carry=["doc_id", "text"]).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_base_spans(found, i):
    row = found[i]
    assert [(s.kind, s.start, s.end) for s in row.base] == expected(TEXTS[i])
    assert all(s.value == TEXTS[i][s.start:s.end] for s in row.base)
    assert row.added == []


def test_bootstrap_finds_unseen_identifiers(spark):
    seeds = [(i, f"please call hotline +1 555 010 {1000 + i} today") for i in range(40)]
    unseen = [(100, "please call hotline (555) 777-1234 today"), (101, "number 555 777 9999 is rare"),
              (102, "hotline 555 777 8888"), (102, "hotline 555 777 8888"), (103, "hotline a@b")]
    got = {}
    for r in pii.find(spark.createDataFrame(seeds + unseen, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.added])
    assert got[100] == [[("phone", 21, 34)]]
    assert got[102] == [[("phone", 8, 20)]] * 2
    assert got[101] == [[]] and got[103] == [[]] and all(v == [[]] for k, v in got.items() if k < 40)


def test_redaction(spark):
    text = "mail a@b.c or 10.0.0.1, card 4111 1111 1111 1111."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = pii.find(df, carry=["doc_id", "text"]).select("doc_id", pii.redacted(F.col("text"), F.col("base")).alias("t"))
    assert {r.doc_id: r.t for r in rows.collect()} == {1: "mail [EMAIL] or [IP], card [CARD].", 2: None, 3: ""}
    assert pii.find(df.limit(0)).count() == 0


def test_digest_columns(spark):
    df = spark.createDataFrame([(1, "a@b.c +1 555 010 2345")], "doc_id long, text string")
    row = pii.find(df).select(pii.joined(F.col("base")).alias("s")).first()
    assert row.s == "email:0:5,phone:6:21"
    assert len(hashlib.sha256(row.s.encode()).hexdigest()) == 64
