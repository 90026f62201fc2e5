"""The registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace
from . import ann, bpe, merkle, mixing, nndescent, pii, simhash, spans, spelling, tokenfile, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_RANKS)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


# Rules on (host, path) of a url, by which the contract of op7 decides before the list does.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the pages that were seen with a tracking parameter; their plain twins are blocked too."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.col("url").contains("utm_source=")).select("url")
    return urls.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _url_sql() -> str:
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    fits = " UNION ALL ".join(
        f"SELECT '{host}{path}' AS rule, '{host}' AS rule_host, '{path}' AS rule_path, '{act}' AS act"
        for host, path, act in URL_RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH rules AS ({fits}),
    cut AS (SELECT page_id, url, {rest} AS rest FROM pages),
    parts AS (
      SELECT page_id, url, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
             regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query
      FROM cut),
    canonical AS (
      SELECT page_id, url, host, path,
             CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)[.]', '') || rtrim(path, '/') ||
             array_to_string(list_transform(list_sort(list_filter(string_split(query, '&'),
               lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), lambda x: '?' || x), '') END AS canonical
      FROM parts),
    listed AS (SELECT DISTINCT canonical FROM canonical WHERE contains(url, 'utm_source=') AND canonical IS NOT NULL),
    fitting AS (
      SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(act, length(rule)) AS act
      FROM canonical, rules
      WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY page_id)
    SELECT c.page_id, c.host, c.path, f.rule,
           coalesce(f.act, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM canonical c LEFT JOIN fitting f ON c.page_id = f.page_id LEFT JOIN listed l ON c.canonical = l.canonical
    """


SQL["op7_url_filter"] = _url_sql()


@query
def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.deduplicate(docs)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), Workspace(spark, "toxicity"))
    return model.score(docs).select(
        "doc_id", F.coalesce(toxicity.fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


MIX_ENTROPY, MIX_REPETITION, MIX_SEED = 0.998, 2.5, 7


@query
def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, MIX_ENTROPY, MIX_REPETITION, seed=MIX_SEED)
    return mixed.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("tokens"), "copies")


SQL["op5_temperature_mix"] = f"""
    WITH RECURSIVE tok AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS tokens FROM documents),
    sums AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM tok GROUP BY source),
    shares AS (
      SELECT list_sort(list(tokens::DOUBLE / (SELECT sum(tokens) FROM sums))) AS p, max(tokens)::DOUBLE AS largest
      FROM sums WHERE tokens > 0),
    cool AS (
      SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
      UNION ALL
      SELECT i + 1, CASE WHEN bad THEN mid ELSE lo END, CASE WHEN bad THEN hi ELSE mid END
      FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
                   ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))))
                   - (lo + hi) / 2 * list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(x)))
                     / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2)))
                   > {MIX_ENTROPY} * ln(len(p)) AS bad
            FROM cool, shares WHERE i < 60)),
    repeat AS (
      SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
      UNION ALL
      SELECT i + 1, CASE WHEN bad THEN mid ELSE lo END, CASE WHEN bad THEN hi ELSE mid END
      FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, pow(p[1] / p[-1], (lo + hi) / 2 - 1) > {MIX_REPETITION} AS bad
            FROM repeat, shares WHERE i < 60)),
    exponent AS (
      SELECT p, largest, greatest(
        CASE WHEN ln(len(p)) > {MIX_ENTROPY} * ln(len(p)) THEN (SELECT hi FROM cool WHERE i = 60) ELSE 0 END,
        least(1.0, CASE WHEN p[-1] / p[1] > {MIX_REPETITION} THEN (SELECT hi FROM repeat WHERE i = 60) ELSE 0 END)) AS a
      FROM shares),
    norm AS (SELECT a, p[-1] AS most, largest, list_sum(list_transform(p, lambda x: pow(x, a))) AS z FROM exponent),
    target AS (
      SELECT source, tokens,
             CAST(round(pow(tokens / (largest / most), a) / z
               * (SELECT max(tokens * z / pow(tokens / (largest / most), a)) FROM sums, norm WHERE tokens > 0)) AS BIGINT) AS target
      FROM sums, norm),
    epochs AS (
      SELECT source, CASE WHEN tokens > 0 THEN target // tokens ELSE 1 END AS epochs,
             CASE WHEN tokens > 0 THEN target - target // tokens * tokens ELSE 0 END AS rest
      FROM target),
    keyed AS (
      SELECT tok.*, epochs, rest,
             substr(md5('{MIX_SEED}:' || epochs || ':' || substr(md5('{MIX_SEED}:block:' || doc_id), 1, 2)), 1, 3)
             || md5('{MIX_SEED}:' || epochs || ':' || doc_id) AS key
      FROM tok JOIN epochs ON tok.source IS NOT DISTINCT FROM epochs.source),
    placed AS (
      SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY key
                                           GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM keyed)
    SELECT doc_id, source, tokens, epochs + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END AS copies FROM placed
"""


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    path = work.path("archives")
    warc.write(read(spark, sf_dir, "pages"), path, work, "page_id", "url", "html")
    history = warc.index(warc.read(spark, path), work)
    return history.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.group(Workspace(spark, "spelling"), read(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path("files")
    tokenfile.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    changed = merkle.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    rows = docs.select("doc_id", "lang", merkle.leaf([F.col(c) for c in columns]).alias("leaf"),
                       F.when(tampered, changed).alias("changed"))
    found = merkle.manifest(Workspace(spark, "merkle"), rows, "lang", "doc_id")
    found = merkle.verified(found, F.coalesce("changed", "leaf"))
    proof = merkle.path_digest(F.concat("path", "top_path")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def _crc_sql(bytes_list: str) -> str:
    """Unsigned CRC-32 of a list of bytes, four bits at a time."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    nibbles = f"flatten(list_transform({bytes_list}, lambda b: [b & 15, b >> 4]))"
    step = f"xor(c >> 4, CAST({table} AS BIGINT[])[(xor(c, n) & 15) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || CAST({nibbles} AS BIGINT[]), lambda c, n: {step}), 4294967295)"


def _tree_sql(name: str, leaves: str) -> str:
    """``name``: every node of the trees over ``leaves`` (tree, idx, h, size), level by level."""
    return f"""
    {name} AS (
      SELECT tree, 0 AS level, idx, h, size FROM {leaves}
      UNION ALL
      SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (size + 1) // 2
      FROM {name} WHERE size > 1 GROUP BY tree, level, idx // 2, size),
    {name}_steps AS (
      SELECT l.tree, l.idx, list(CASE WHEN s.h IS NULL THEN 'N' WHEN n.idx % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY n.level) AS steps
      FROM {leaves} l JOIN {name} n ON n.tree = l.tree AND n.size > 1 AND n.idx = l.idx >> n.level
      LEFT JOIN {name} s ON s.tree = n.tree AND s.level = n.level AND s.idx = xor(n.idx, 1)
      GROUP BY l.tree, l.idx)"""


def _merkle_sql() -> str:
    coded = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')"
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda plus: "sha256(" + " || ".join(coded(f"(n_chars + {plus})" if c == "n_chars" else c) for c in columns) + ")"
    crc = _crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x))")
    return f"""
    WITH RECURSIVE rows AS (
      SELECT doc_id, {coded("lang")} AS tree, lang, {leaf(0)} AS h,
             CASE WHEN {crc} % 7 = 0 THEN {leaf(1)} ELSE {leaf(0)} END AS begin FROM documents),
    leaves AS (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size FROM rows),
    {_tree_sql("nodes", "leaves")},
    subroots AS (
      SELECT 'all' AS tree, tree AS name, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS size
      FROM (SELECT DISTINCT tree, lang FROM rows) JOIN (SELECT tree, h FROM nodes WHERE size = 1) USING (tree)),
    {_tree_sql("tops", "subroots")},
    met AS (
      SELECT l.doc_id, l.h AS leaf, l.begin, s.h AS subroot, (SELECT h FROM tops WHERE size = 1) AS root,
             coalesce(n.steps, []) || coalesce(t.steps, []) AS steps
      FROM leaves l JOIN subroots s ON s.name = l.tree
      LEFT JOIN nodes_steps n ON n.tree = l.tree AND n.idx = l.idx LEFT JOIN tops_steps t ON t.idx = s.idx),
    folded AS (
      SELECT *, list_reduce([begin] || steps, lambda h, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || h) WHEN 'R' THEN sha256(h || s[2:])
                                                          ELSE sha256(h) END) AS folded_root FROM met)
    SELECT doc_id, leaf, subroot, root,
           sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> 'N'), lambda s: s[2:]), '')) AS proof_sha256,
           folded_root, folded_root = root AS verified FROM folded
    """


SQL["op13_merkle_manifest"] = _merkle_sql()


def _spelling_sql() -> str:
    lower = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # U+00C0 to U+00FF are two bytes in UTF-8.
    crc = _crc_sql("flatten(list_transform(string_split(doc_id || ':' || w, ''), "
                   "lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END))")
    return f"""
    WITH RECURSIVE runs AS (
      SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents),
    uses AS (SELECT doc_id, {lower} AS w, count(*) AS k FROM runs GROUP BY 1, 2),
    marked AS (SELECT w, k, {crc} AS h FROM uses),
    slipped AS (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM marked),
    words AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
    cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    gaps AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM cut),
    near AS (
      SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
      UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY 1),
    forms AS (
      SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
      FROM words LEFT JOIN best USING (word)),
    chain AS (
      SELECT word, word AS at FROM forms
      UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n::DOUBLE AS form_n FROM forms JOIN ends USING (word)
    """


# A nullable count is a floating-point column in pandas, as Spark's result is.
SQL["op11_spelling_variants"] = _spelling_sql()
