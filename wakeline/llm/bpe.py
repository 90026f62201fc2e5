"""Byte-level BPE: encode texts to token ids and decode ids to bytes.

Merging works on numpy matrices. Distinct pieces of a batch are bucketed by length and padded to one matrix
per bucket. In each round every row looks up the ranks of all its neighbour pairs in a hash table, merges its
leftmost pair of the lowest rank, and is compacted by one place; rows without a mergeable pair leave the
matrix. Pieces longer than ``WIDE`` bytes, where rounds over a matrix would cost the square of the length,
go through an exact heap merge instead.

Every task keeps the pieces it has met in a bounded cache, so a text costs one dictionary lookup per piece.

Defined cases: a null text counts as empty, an empty text has no tokens, special tokens are ordinary text,
equal texts give equal ids, an empty table gives an empty table, and all other columns pass through (a column
named like an output column is replaced).
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDE = 256  # bytes of a piece above which the heap merge is used
CACHE_ENTRIES = 150_000  # pieces a task remembers
NONE = np.int64(1) << 40  # rank of a pair that does not merge

# White space other than these four characters makes the fast split below unsafe.
_CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a vocabulary file with lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    values.append(rank)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)
        todo, rank = np.array(keys, np.int64), np.array(values, np.int64)
        slot = self._home(todo)
        self.longest = 0  # probes that any key needs
        while len(todo):
            self.longest += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = todo[free]  # of several keys for one slot the last one written stays
            done = self.keys[slot] == todo
            self.values[slot[done]] = rank[done]
            todo, rank, slot = todo[~done], rank[~done], (slot[~done] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair, ``NONE`` where the pair does not merge or an id is negative."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.ravel()[open_]
        slot = self._home(keys)
        flat = out.ravel()
        for _ in range(self.longest):
            held = self.keys[slot]
            hit = held == keys
            flat[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (held != -1)
            if not go.any():
                break
            open_, keys, slot = open_[go], keys[go], (slot[go] + 1) & self.mask
        return flat.reshape(out.shape)


class Encoder:
    """Pieces to ids, with the cache of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.pair_of: dict[tuple[int, int], int] = {}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary must hold all 256 single bytes")
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One padded matrix (padding -1) merged to its end: the ids and their count per row."""
        n, width = ids.shape
        out, count = np.full((n, width), -1, np.int64), np.zeros(n, np.int64)
        where = np.arange(n)
        rank = np.full((n, width), NONE)  # of the pair that begins at each place; none begins at the last
        rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(where):
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(where)), best]
            stop = low == NONE
            if stop.any():
                out[where[stop], :ids.shape[1]] = ids[stop]
                go = ~stop
                ids, rank, where, best, low = ids[go], rank[go], where[go], best[go], low[go]
                if not len(where):
                    break
            at = np.arange(len(where))
            ids[at, best] = low
            # Compaction: everything right of the merged pair moves one place to the left.
            used = ids.shape[1] - 1 - int((ids[:, 1:] >= 0).sum(axis=1).max() < ids.shape[1] - 1)
            cols = np.arange(used)
            take = cols + (cols > best[:, None])
            ids, rank = np.take_along_axis(ids, take, axis=1), np.take_along_axis(rank, take, axis=1)
            for side in (best - 1, best):  # only the two pairs beside the merge are new
                ok = (side >= 0) & (side < used - 1)
                i, j = at[ok], side[ok]
                rank[i, j] = self.pairs.find(ids[i, j], ids[i, j + 1])
            rank[:, -1] = NONE
        count = (out >= 0).sum(axis=1)
        return out, count

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece with a heap over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        heap = [(int(r), int(i), int(ids[i]), int(ids[i + 1])) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                pair = (ids[i], ids[j])
                r = self.pair_of.get(pair)
                if r is None:
                    r = int(self.pairs.find(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if len(self.pair_of) < CACHE_ENTRIES:
                        self.pair_of[pair] = r
                if r != NONE:
                    heapq.heappush(heap, (r, i, *pair))

        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has merged since
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return np.array([x for x in ids if x >= 0], np.int64)

    def _learn(self, new: list[str]) -> None:
        """Add the ids of unseen pieces to the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.pieces[piece] = whole.to_bytes(4, "little")
            elif len(raw) > WIDE:
                self.pieces[piece] = self._merge_long(raw).astype("<u4").tobytes()
            else:
                buckets.setdefault(len(raw).bit_length(), []).append((piece, raw))
        for rows in buckets.values():
            for start in range(0, len(rows), 4096):
                part = rows[start:start + 4096]
                length = np.array([len(raw) for _, raw in part])
                width = int(length.max())
                raw = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in part), np.uint8)
                ids = self.single[raw].reshape(len(part), width)
                ids[np.arange(width) >= length[:, None]] = -1
                out, count = self._merge_rows(ids)
                packed, row = out.astype("<u4").tobytes(), 4 * width
                for i, ((piece, _), n) in enumerate(zip(part, count.tolist(), strict=True)):
                    self.pieces[piece] = packed[i * row:i * row + 4 * n]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > CACHE_ENTRIES or len(self.pieces) > CACHE_ENTRIES:
            self.chunks, self.pieces = {}, {}
        split = [self.pattern.findall(t) if _ODD_SPACE.search(t) else None for t in texts]
        parts = [_CHUNK.findall(t) if s is None else None for t, s in zip(texts, split, strict=True)]
        # A token never reaches from a non-space into the following space, so chunks encode independently.
        unseen: set[str] = set()
        for p in parts:
            if p is not None:
                unseen.update(p)
        unseen.difference_update(self.chunks)
        # A run of letters, with or without one space before it, is one piece.
        cut = {c: (c,) if c.isalpha() or c[0] == " " and c[1:].isalpha() else self.pattern.findall(c) for c in unseen}
        need: set[str] = set()
        for pieces in (*cut.values(), *(s for s in split if s is not None)):
            need.update(pieces)
        need.difference_update(self.pieces)
        self._learn(sorted(need))
        of = self.pieces.__getitem__
        for c, pieces in cut.items():
            self.chunks[c] = b"".join(map(of, pieces))
        chunk = self.chunks.__getitem__
        return [b"".join(map(chunk, p)) if s is None else b"".join(map(of, s))
                for p, s in zip(parts, split, strict=True)]


def _slices(batch: pa.RecordBatch, column: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``size`` bytes of one column each, one row at least."""
    import pyarrow.compute as pc

    length = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(False)
    start, total = 0, 0
    for i, n in enumerate(length):
        if i > start and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _map_column(df: DataFrame, source: str, outputs: list[T.StructField],
                make: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """Add output columns that a per-task function computes from one column; other columns pass through."""
    names = {f.name for f in outputs}
    kept = [f for f in df.schema.fields if f.name not in names]
    plain = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in _slices(whole, source, 1_000_000):
                values = batch.column(batch.schema.get_field_index(source)).to_pylist()
                columns = [batch.column(batch.schema.get_field_index(n)) for n in plain]
                yield pa.RecordBatch.from_arrays(columns + work(values), names=plain + [f.name for f in outputs])

    return df.mapInArrow(run, T.StructType(kept + outputs))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit integers) to each row."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))  # a fixed vocabulary file

    def make():
        encoder = Encoder(ranks.value, pattern)

        def work(values: list) -> list[pa.Array]:
            ids = encoder.encode([v or "" for v in values])
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

        return work

    return _map_column(df, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())],
                       make)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes that the packed ids stand for (null ids: no bytes)."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def make():
        token = {i: b for b, i in ranks.value.items()}.__getitem__

        def work(values: list) -> list[pa.Array]:
            return [pa.array([b"".join(map(token, np.frombuffer(v or b"", "<u4").tolist())) for v in values],
                             pa.binary())]

        return work

    return _map_column(df, ids, [T.StructField("decoded", T.BinaryType())], make)

