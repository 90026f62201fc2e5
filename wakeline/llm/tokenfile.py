"""Token-id files with Elias-Fano document boundaries: write, seek, read.

Documents are dealt to files by ranges of (doc_id, hash of the text) and sorted, so the files in order hold them in
ascending order. A file is one block, made by one task:

    header    magic, bytes per id, documents, documents without an id, token ids, smallest doc_id, section sizes
    bounds    Elias-Fano list of the running ends of the documents, in token ids
    doc ids   Elias-Fano list of doc_id minus the smallest one
    ids       all token ids, little endian, two bytes each where the vocabulary allows, else four

An Elias-Fano list keeps the low ``l = log2(universe / n)`` bits of each value packed, and the high bits in unary in
a bit vector of at most three bits a value. Every ``SAMPLE``-th set bit's place is kept in 32 bits; ``select`` starts
there, so one offset, or the offsets of a run of documents, are found without a table of 64-bit offsets.

The blocks go through Spark's text writer, whose line break follows the last id and is ignored. Folder names hold
file number, documents and token ids, so the manifest needs no file to be opened. Texts are cut where the byte-level
pre-tokeniser always cuts; the tokenizers library encodes each distinct piece, and a worker remembers them, forgetting
all beyond ``CACHE_ENTRIES``. A text with unusual white space goes to the library whole.

Defined cases: a null text is empty, and an empty text has only the end id; a null doc_id comes first; rows of one
doc_id are ordered by the hash of the text, equal rows stand in any order; an empty table gives no file; other columns
are ignored; one document has to fit a task (its ids in memory), a file holds at least one document.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import at_most
from . import batches
from .bpe import _ODD_SPACE, _slices
from .order import running_totals

FILE_BYTES = 8_000_000  # of text for each file; a task holds its ids a few times over
BATCH_BYTES = 4_000_000
CACHE_ENTRIES = 200_000
BROADCAST_FILES = 200_000
SAMPLE = 256
MAGIC = b"WKTOKEN1"
HEADER, LIST = "<8sIQQQqQQ", "<QQIQ"  # formats of the headers of a file and of a list

SPACE, LETTER, SIGN = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \n\t\r")] = SPACE
for _c in range(33, 127):
    _KIND[_c] = LETTER if chr(_c).isalpha() else 0 if chr(_c).isdigit() else SIGN
_ODD_SPACE_BYTES = re.compile(b"|".join(re.escape(chr(c).encode()) for c in range(0x3001) if _ODD_SPACE.match(chr(c))))


def pack(values: np.ndarray) -> bytes:
    """Elias-Fano form of an ascending array of unsigned 64-bit values."""
    n, values = len(values), values.astype(np.uint64)
    universe = int(values[-1]) + 1 if n else 0
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    bits = np.arange(low, dtype=np.uint64)
    lows = np.packbits(((values[:, None] >> bits) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    high = np.packbits(high, bitorder="little")
    return b"".join([struct.pack(LIST, n, universe, low, len(high)), lows.tobytes(), high.tobytes(),
                     places[::SAMPLE].astype("<u4").tobytes()])


class EliasFano:
    """A packed list, read in place."""

    def __init__(self, raw: memoryview):
        self.n, self.universe, self.low, high = struct.unpack_from(LIST, raw)
        at, lows = struct.calcsize(LIST), -(-self.n * self.low // 8)
        self.lows = np.frombuffer(raw, np.uint8, lows, at)
        self.high = np.frombuffer(raw, np.uint8, high, at + lows)
        self.samples = np.frombuffer(raw, "<u4", -(-self.n // SAMPLE), at + lows + high)

    def select(self, start: int, stop: int) -> np.ndarray:
        """Values number ``start`` to ``stop - 1``."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first, last = start // SAMPLE, (stop - 1) // SAMPLE + 1
        begin = int(self.samples[first]) // 8
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        ones = ones[ones >= int(self.samples[first])][start - first * SAMPLE:stop - first * SAMPLE]
        out = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bit = start * self.low
            bits = np.unpackbits(self.lows[bit // 8:-(-stop * self.low // 8)], bitorder="little")[bit % 8:][:(stop - start) * self.low]
            weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
            out |= (bits.reshape(-1, self.low) * weights).sum(axis=1, dtype=np.uint64)
        return out


class TokenFile:
    """One file's content: offsets by ``select``, ids by slices."""

    def __init__(self, raw: memoryview):
        magic, self.width, self.documents, self.nameless, self.tokens, self.smallest, bounds, names = struct.unpack_from(HEADER, raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEADER)
        self.ends = EliasFano(raw[at:at + bounds])
        self.names = EliasFano(raw[at + bounds:at + bounds + names])
        self.ids = np.frombuffer(raw, f"<u{self.width}", self.tokens, at + bounds + names)

    def bounds(self, start: int, stop: int) -> np.ndarray:
        """First offsets of documents ``start`` to ``stop - 1``, and the end of the last one."""
        ends = self.ends.select(max(start - 1, 0), stop).astype(np.int64)
        return ends if start else np.concatenate([[0], ends])

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        none = max(0, min(stop, self.nameless) - start)
        values = self.names.select(max(start, self.nameless) - self.nameless, max(stop, self.nameless) - self.nameless)
        return [None] * none + [int(v) + self.smallest for v in values]


def block(doc_ids: list[int | None], lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """Content of a file; documents without an id come first, the others ascend."""
    named = [d for d in doc_ids if d is not None]
    smallest = named[0] if named else 0
    bounds = pack(np.cumsum(lengths).astype(np.uint64))
    names = pack(np.array([d - smallest for d in named], np.uint64))
    head = struct.pack(HEADER, MAGIC, width, len(doc_ids), len(doc_ids) - len(named), len(ids) // width, smallest, len(bounds), len(names))
    return b"".join([head, bounds, names, ids])


class Encoder:
    """Whole texts to token ids, by the JSON text of a tokenizers file."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_str(tokenizer)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token is a byte of text
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.cache: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> Iterator[np.ndarray]:
        for found in self.library.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(found.ids, self.dtype)

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode pieces and remember them. Words that begin with white space go to the library as one long text,
        whose ids are cut again where the pieces end."""
        spaced = [p for p in pieces if p[0] in b" \n\t\r" and p[-1] not in b" \n\t\r"]
        runs = [spaced[i:i + 100] for i in range(0, len(spaced), 100)]
        alone = [p for p in pieces if p[0] not in b" \n\t\r" or p[-1] in b" \n\t\r"]
        for run, ids in zip(runs, self._library([b"".join(r).decode(errors="replace") for r in runs]), strict=True):
            ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)))
            covered = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(covered, ends) + 1
            if cuts[-1] != len(ids) or (covered[cuts - 1] != ends).any():
                alone += run  # bytes that are no UTF-8
                continue
            starts = [0, *cuts[:-1].tolist()]
            self.cache.update((p, ids[i:j].tobytes()) for p, i, j in zip(run, starts, cuts.tolist(), strict=True))
        self.cache.update(zip(alone, (x.tobytes() for x in self._library([p.decode(errors="replace") for p in alone])), strict=True))

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data`` that begin at ``starts[:-1]``, and how many each has.

        Texts are cut before white space, and between a letter and a sign of ASCII: the pre-tokeniser cuts there, and
        never looks back."""
        kind = _KIND[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] == SPACE) & (kind[:-1] != SPACE) | (kind[1:] == SIGN) & (kind[:-1] == LETTER)
        cut[starts] = True
        cut[-1] = True
        bounds = np.flatnonzero(cut)
        coded = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        coded = coded.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = [p for p in distinct if p not in self.cache]
        if new:
            self._learn(new)
        packed = list(map(self.cache.__getitem__, distinct))
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        each = size[codes]
        ends = np.cumsum(each)
        ids = np.frombuffer(b"".join(packed), self.dtype)[np.repeat(first[codes] - ends + each, each) + np.arange(ends[-1])]
        before = np.concatenate([[0], ends])
        return ids, np.diff(before[np.searchsorted(bounds[:-1], starts)])

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_pieces`` of one long text, some bytes at a time; a part ends before white space."""
        parts, at = [], 0
        while at < len(data):
            stop = at + BATCH_BYTES
            while stop < len(data):
                kind = _KIND[data[stop - 1:stop + 65_536]]
                edge = np.flatnonzero((kind[1:] == SPACE) & (kind[:-1] != SPACE))
                stop += int(edge[0]) if len(edge) else len(kind) - 1
                if len(edge):
                    break
            stop = min(stop, len(data))
            parts.append(self._pieces(data[at:stop], np.array([0, stop - at]))[0])
            at = stop
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0]:starts[-1]]
        starts = starts - starts[0]
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        odd = {int(np.searchsorted(starts, m.start(), "right")) - 1 for m in _ODD_SPACE_BYTES.finditer(data)}
        if not odd:
            return self._long(data) if len(texts) == 1 and len(data) > BATCH_BYTES else self._pieces(data, starts)
        ids, lengths, at = [], [], 0
        for i in [*sorted(odd), len(texts)]:
            if i > at and starts[i] > starts[at]:
                found, n = self._pieces(data[starts[at]:starts[i]], starts[at:i + 1] - starts[at])
                ids.append(found)
                lengths += n.tolist()
            else:
                lengths += [0] * (i - at)
            if i < len(texts):
                ids.append(next(self._library([data[starts[i]:starts[i + 1]].tobytes().decode(errors="replace")])))
                lengths.append(len(ids[-1]))
            at = i + 1
        return np.concatenate(ids), np.array(lengths, np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) with the tokenizers file at ``tokenizer`` and write them under ``path``."""
    batches.bound(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    with open(tokenizer, encoding="utf-8") as f:  # a fixed vocabulary file
        # A worker keeps a broadcast value over its tasks, and with it the encoder and the chunks it has met.
        shared = docs.sparkSession.sparkContext.broadcast({"tokenizer": f.read()})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.get("encoder") or shared.value.setdefault("encoder", Encoder(shared.value["tokenizer"]))
        doc_ids, lengths, ids = [], [], []
        for whole in parts:
            for batch in _slices(whole, "text", BATCH_BYTES):
                found, n = encoder.encode(batch.column(1))
                doc_ids += batch.column(0).to_pylist()
                lengths.append(n + 1)
                ids.append(np.insert(found, np.cumsum(n), end_id))
        if doc_ids:
            lengths = np.concatenate(lengths)
            content = block(doc_ids, lengths, b"".join(ids), encoder.dtype.itemsize)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "documents": pa.array([len(doc_ids)], pa.int64()),
                "tokens": pa.array([int(lengths.sum())], pa.int64()), "content": pa.array([content], pa.binary())})

    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(files, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    blocks = dealt.mapInArrow(run, "part long, documents long, tokens long, content binary")
    # A cast of binary to string keeps the bytes as they are.
    blocks.withColumn("content", F.col("content").cast("string")).write.partitionBy("part", "documents", "tokens").text(path)
    shared.destroy()  # workers outlive the job, and would keep an encoder for each


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    names = ("part", "documents", "tokens")
    if names[0] not in files.columns:  # a table without rows has no folders
        return files.filter("false").select("content", *[F.lit(0).cast("long").alias(n) for n in names])
    return files.select("content", *[F.col(n).cast("long") for n in names])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part, documents, tokens, base`` of each file, from folder names; ``base`` counts the ids of earlier files."""
    return running_totals(_files(spark, path).select("part", "documents", "tokens"), "part", "tokens", "base")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ``ids`` are packed little-endian unsigned 32-bit integers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for base, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(memoryview(raw.as_buffer()))
                start = 0
                while start < file.documents:
                    stop = min(start + 1024, file.documents)
                    at = file.bounds(start, stop)
                    fits = max(1, int(np.searchsorted(at, at[0] + BATCH_BYTES // 4, "right")) - 1)
                    stop, at = min(stop, start + fits), at[:fits + 1]
                    ids = file.ids[int(at[0]):int(at[-1])].astype("<u4")
                    cuts = at - at[0]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(file.doc_ids(start, stop), pa.int64()), pa.array(base + at[:-1], pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    start = stop

    files = manifest(spark, path).select("part", "base")
    side = F.broadcast(files) if at_most(files, BROADCAST_FILES) else files
    found = _files(spark, path).select("part", "content").join(side, "part").select("base", "content")
    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
