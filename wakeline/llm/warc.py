"""WARC archives: write and read records, find revisits, and merge capture indexes.

Archives are written with Spark's text writer, whose line separator is the two line breaks that end a WARC record,
so executors need nothing but the shared file system. Payloads are given as text and stored as its UTF-8 bytes.
Archives are gzip files unless told otherwise; offsets count uncompressed bytes. Every archive holds about ``ARCHIVE_BYTES`` of payload: records are dealt to archives by hash, so neither one host
nor one payload fills a file. Archives are read back whole, one per row of Spark's binary-file source, and cut by
their ``Content-Length`` headers.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest id is the response and the
others revisit it. Only ids and digests are grouped, combined before the shuffle.

Each task sorts the index entries it holds by (URL key, timestamp, id): a run. Runs are cut at common range
boundaries, and per range a loser tree merges the pieces of all runs, so the concatenated ranges are the capture
histories in global order. Boundaries are on the whole sort key, so one URL with very many captures spans ranges.

Defined cases: a null payload is empty, a null URL is written as an empty target; rows with the same id and payload
are copies and all get the same record type (a copy of the response is a response); a null id revisits any record
with an id; an empty table gives no records and an empty index; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace

ARCHIVE_BYTES = 32_000_000
RANGE_ROWS = 200_000
END = "\r\n\r\n"
EPOCH = 1_700_000_000  # second of the capture with id 0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # of base 32
INDEX = ("urlkey string, timestamp string, id long, url string, record_type string, payload_digest string, "
         "payload_bytes long, refers_to long, archive string, offset long")


def _base32(hex_digest: Column) -> Column:
    """Bare base 32 of a 160-bit digest in hex: five hex digits make four characters."""
    chars = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(hex_digest, at, 5), 16, 10).cast("int")
        chars += [F.substr(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                  for shift in (15, 10, 5, 0)]
    return F.concat(*chars)


def _url_key(url: Column) -> Column:
    """Host labels in reverse order, then the rest: captures of one site stand together."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))


def _record() -> Column:
    """One record without its end: header lines, an empty line and, for a response, the payload."""
    revisit = F.col("response_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("response_id"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:record:"), text("id"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(EPOCH + F.coalesce("id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(text("url"), r"[\r\n]", "")),
        F.concat(F.lit("X-Url-Key: "), F.regexp_replace(_url_key(F.col("url")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), _base32(F.col("digest"))),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:record:"), text("response_id"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.octet_length("payload").cast("string"))),
    ]
    head = F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\r\n")
    return F.concat(head, F.lit(END), F.when(revisit, "").otherwise(F.col("payload")))


def write(df: DataFrame, path: str, work: Workspace, record_id: str, url: str, payload: str, min_bytes: int = 0,
          archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip") -> None:
    """Write one record per row of ``df`` to archives under ``path``, compressed with ``gzip`` or ``none``."""
    rows = df.select(F.col(record_id).cast("long").alias("id"), F.col(url).alias("url"),
                     F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    marks = work.save(rows.select("id", "digest", F.octet_length("payload").alias("n")), "marks")
    groups = work.save(marks.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("id").alias("response_id")), "groups")
    key = F.concat_ws(":", "digest", "id")
    kinds = marks.distinct().join(groups, "digest", "left").select(key.alias("key"), "response_id")
    kinds = work.save(kinds, "kinds")
    total = marks.agg(F.sum("n")).first()[0] or 0
    dealt = rows.withColumn("key", key).repartition(max(1, -(-total // archive_bytes)), "key")
    met = dealt.join(kinds, "key")
    met.select(_record().alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _parse(raw: memoryview | bytes, name: str) -> Iterator[dict]:
    """Records of one archive; a payload that does not match its digest is an error."""
    raw, at = gzip.decompress(raw) if name.endswith(".gz") else bytes(raw), 0
    while at < len(raw):
        stop = raw.index(END.encode(), at)
        lines = raw[at:stop].decode().split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = stop + len(END)
        size = int(head["Content-Length"])
        body = raw[start:start + size]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"{name}: payload at byte {at} does not match its digest")
        number = lambda x: int(x) if (x := x.removeprefix("<urn:record:").removesuffix(">")) else None
        yield {"urlkey": head["X-Url-Key"], "timestamp": head["WARC-Date"], "id": number(head["WARC-Record-ID"]),
               "url": head["WARC-Target-URI"], "record_type": kind, "payload_digest": digest,
               "payload_bytes": int(head["X-Payload-Length"]),
               "refers_to": number(head["WARC-Refers-To"]) if kind == "revisit" else None,
               "archive": name, "offset": at, "payload": body if kind == "response" else None}
        at = start + size + len(END)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index columns and ``payload`` (null for revisits) of every record under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, schema = INDEX.replace(",", "").split()[::2] + ["payload"], None
        kinds = [pa.int64() if t == "long" else pa.string() for t in INDEX.replace(",", "").split()[1::2]] + [pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(_parse(raw.as_buffer(), name.rsplit("/", 1)[-1]))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX + ", payload binary")


class LoserTree:
    """Merge of k sorted lists: each inner node keeps the loser of its match, the root's winner comes next."""

    def __init__(self, runs: list[list]):
        self.runs = [r for r in runs if r]
        self.at = [0] * len(self.runs)
        k = len(self.runs)
        self.loser = [-1] * k  # node 0 holds the winner
        for i in range(k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether list a goes before list b; an exhausted list loses, ties go to the earlier list."""
        x = self.runs[a][self.at[a]] if self.at[a] < len(self.runs[a]) else None
        y = self.runs[b][self.at[b]] if self.at[b] < len(self.runs[b]) else None
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        """Send list i from its leaf to the root."""
        node, k = (i + len(self.runs)) // 2, len(self.runs)
        while node > 0:
            other = self.loser[node]
            if other < 0:  # while the tree is built, the first to arrive waits here
                self.loser[node] = i
                return
            if self._less(other, i):
                self.loser[node], i = i, other
            node //= 2
        if k:
            self.loser[0] = i

    def __iter__(self) -> Iterator:
        for _ in range(sum(map(len, self.runs))):
            best = self.loser[0]
            yield self.runs[best][self.at[best]]
            self.at[best] += 1
            self._play(best)


def _order(row: dict) -> tuple:
    return row["urlkey"], row["timestamp"], row["id"] is None, row["id"] or 0, row["archive"], row["offset"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of one task in order, marked with the task's run number."""
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is not None:
        run = pa.array([TaskContext.get().partitionId()] * table.num_rows, pa.int64())
        keys = [("urlkey", "ascending"), ("timestamp", "ascending"), ("id", "ascending"), ("archive", "ascending"), ("offset", "ascending")]
        yield from table.append_column("run", run).sort_by(keys).to_batches(max_chunksize=10_000)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the pieces of runs in one range."""
    runs: dict[int, list] = {}
    schema = None
    for batch in batches:
        schema = batch.schema.remove(batch.schema.get_field_index("run"))
        for row in batch.to_pylist():
            runs.setdefault(row.pop("run"), []).append((_order(row), row))
    for piece in runs.values():  # a shuffle may hand over the parts of a run in another order
        if any(a[0] > b[0] for a, b in zip(piece, piece[1:], strict=False)):
            piece.sort(key=lambda x: x[0])
    out = []
    # Keys are unique by archive and offset, so rows themselves are never compared.
    for _, row in LoserTree([runs[i] for i in sorted(runs)]):
        out.append(row)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def index(records: DataFrame, work: Workspace, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The capture histories of all records: partitions are ascending ranges, each in order."""
    columns = [c.split()[0] for c in INDEX.split(", ")]
    runs = work.save(records.select(*columns).mapInArrow(_runs, INDEX + ", run long"), "runs")
    ranges = max(1, -(-runs.count() // range_rows))
    return runs.repartitionByRange(ranges, "urlkey", "timestamp", "id", "archive", "offset").mapInArrow(_merge, INDEX)
