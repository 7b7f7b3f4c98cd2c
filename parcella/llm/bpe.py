"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut into pieces by the vocabulary's pattern. Pieces of a batch that aren't known yet are bucketed by length and
laid out as rows of a padded matrix of token ids. In every round each row finds its minimum-rank adjacent pair (the
leftmost of equals) through a hash table from pairs to ranks, merges it, and closes the gap; rows without a pair leave
the matrix. Decoding gathers the bytes of the ids from one blob.

Pieces longer than LONG bytes, for which a matrix takes a time that grows with the square of the length, take the same
merges in the same order from a heap, in n log n.

Cases: null and empty texts have no tokens. Any text is encoded whole. The pieces' cache is bounded and only saves time.
Extra columns pass through unless a result column has their name, which then holds the result.
Repeated rows are encoded each, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcella.llm.common import with_arrow_batches

NONE = np.int64(1 << 40)  # the rank of what is no pair
LONG = 256
#: Pieces that the cache of a worker holds at most.
CACHED = 400_000


class PairTable:
    """(left id, right id) -> merged id, in open addressing with linear probing; whole arrays are looked up at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(left) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int64)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == -1
            # of keys that want one free slot, the last one written has it
            self.keys[slots[todo[free]]] = keys[todo[free]]
            placed = self.keys[slots[todo]] == keys[todo]
            self.values[slots[todo[placed]]] = merged[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & (size - 1)
        self.mask = size - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, which are the ranks; NONE where there is no such pair or an id is negative."""
        shape = left.shape
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left.astype(np.int64) << 32 | right).ravel()
        out = np.full(len(keys), NONE, np.int64)
        todo = np.nonzero(keys >= 0)[0]
        slots = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slots]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (there != -1)
            todo, slots = todo[on], (slots[on] + 1) & self.mask
        return out.reshape(shape)


class Vocabulary:
    """Ranks of byte strings, as read from a .tiktoken file, and the pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.bytes_of = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(triples, np.int64).reshape(-1, 3).T)
        top = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * top
        for t, r in ranks.items():
            self.tokens[r] = t
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.forget()

    def merge_rows(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of pieces of similar length: positions of finished rows, how many ids each has, and these ids in one array."""
        width = max(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows = np.full((len(pieces), width), -1, np.int64)
        rows[np.arange(width) < sizes[:, None]] = self.bytes_of[np.frombuffer(b"".join(pieces), np.uint8)]
        names = np.arange(len(pieces))
        ranks = self.pairs(rows[:, :-1], rows[:, 1:])
        while len(names):
            if rows.shape[1] > 1:
                at = ranks.argmin(axis=1)  # the leftmost of equals
                best = ranks[np.arange(len(names)), at]
            else:
                at, best = np.zeros(len(names), np.int64), np.full(len(names), NONE)
            done = best == NONE
            if done.any():
                yield names[done], sizes[done], rows[done][np.arange(rows.shape[1]) < sizes[done, None]]
                go = ~done
                names, rows, ranks, sizes, at, best = names[go], rows[go], ranks[go], sizes[go], at[go], best[go]
                if not len(names):
                    return
                cut = int(sizes.max())
                rows, ranks = rows[:, :cut], ranks[:, : cut - 1]
            each, w = np.arange(len(names)), rows.shape[1]
            rows[each, at] = best
            gap = np.arange(w - 1) + (np.arange(w - 1) > at[:, None])
            rows = np.take_along_axis(rows, gap, axis=1)
            sizes = sizes - 1
            ranks = np.take_along_axis(ranks, gap[:, : w - 2], axis=1)
            if w == 2:
                continue
            # new pairs on both sides of the merged id
            right, before = np.minimum(at, w - 3), np.maximum(at - 1, 0)
            ranks[each, right] = np.where(at <= w - 3, self.pairs(rows[each, right], rows[each, right + 1]), ranks[each, right])
            ranks[each, before] = np.where(at > 0, self.pairs(rows[each, before], rows[each, before + 1]), ranks[each, before])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece, by the same merges from a heap."""
        ids = self.bytes_of[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        heap = [(int(first[k]), int(k)) for k in np.nonzero(first != NONE)[0]]
        heapq.heapify(heap)
        live = first.tolist() + [int(NONE)]
        tokens, ranks = self.tokens, self.ranks
        while heap:
            rank, k = heapq.heappop(heap)
            if live[k] != rank:
                continue
            gone = after[k]
            ids[k], live[gone] = rank, -1
            after[k] = after[gone]
            if after[k] < n:
                ahead[after[k]] = k
            for left, right in ((k, after[k]), (ahead[k], k)):
                if left >= 0:
                    live[left] = ranks.get(tokens[ids[left]] + tokens[ids[right]], int(NONE)) if right < n else int(NONE)
                    if live[left] != NONE:
                        heapq.heappush(heap, (live[left], left))
            ids[gone] = -1
        return np.array([i for i in ids if i >= 0], np.int32)

    def forget(self) -> None:
        """An empty cache: known pieces, and where in the pool the ids of each lie."""
        self.known: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.at, self.sizes = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _keep(self, names: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.sizes[names] = sizes
        self.at[names] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def learn(self, pieces: list[str]) -> None:
        """Puts the ids of pieces into the cache."""
        base, ranks = len(self.known), self.ranks
        self.known.update(zip(pieces, range(base, base + len(pieces))))
        while len(self.known) > len(self.at):
            self.at, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.sizes))
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = np.array([ranks.get(r, -1) for r in raws], np.int64)
        one = np.nonzero(whole >= 0)[0]
        self._keep(base + one, np.ones(len(one), np.int64), whole[one])
        rest = np.nonzero(whole < 0)[0]
        lengths = np.fromiter((len(raws[k]) for k in rest), np.int64, len(rest))
        for k in rest[lengths > LONG]:
            ids = self.merge_long(raws[k])
            self._keep(np.array([base + k]), np.array([len(ids)]), ids)
        rest, lengths = rest[lengths <= LONG], lengths[lengths <= LONG]
        rest = rest[np.argsort(lengths, kind="stable")]
        lengths = np.sort(lengths)
        start = 0
        while start < len(rest):
            # a bucket: rows whose lengths are at most a quarter apart
            end = min(start + 4096, int(np.searchsorted(lengths, lengths[start] * 5 // 4 + 1, side="right")))
            part = rest[start:end]
            for names, sizes, ids in self.merge_rows([raws[k] for k in part]):
                self._keep(base + part[names], sizes, ids)
            start = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.split.findall(t) if t else [] for t in texts]
        flat = [p for pieces in cut for p in pieces]
        new = set(flat).difference(self.known)
        if new and len(self.known) + len(new) > CACHED:
            self.forget()
            new = set(flat)
        if new:
            self.learn(list(new))
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.at[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([len(pieces) for pieces in cut], dtype=np.int64)]
        return np.split(ids, bounds[:-1]) if len(cut) else []

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.blob[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}, pattern)


def _into_batch(b: pa.RecordBatch, more: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([more[n] if n in more else b.column(n) for n in names], names=names)


def _ragged(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def _with(schema: T.StructType, more: list[T.StructField]) -> T.StructType:
    names = {f.name for f in more}
    return T.StructType([f for f in schema.fields if f.name not in names] + more)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns named in keep) with the token ids of text_col in ids_col; with decoded_col, also the bytes that these ids decode to."""
    with_arrow_batches(df.sparkSession)
    out = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded_col, T.BinaryType(), False)] if decoded_col else [])
    schema = _with(T.StructType([f for f in df.schema.fields if keep is None or f.name in keep]), out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_path, pattern)
        for b in batches:
            ids = vocab.encode(b.column(text_col).to_pylist())
            more: dict[str, pa.Array] = {ids_col: _ragged(ids)}
            if decoded_col:
                more[decoded_col] = pa.array([vocab.decode(x) for x in ids], pa.binary())
            yield _into_batch(b, more, schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with the bytes of ids_col in decoded_col; null ids decode to no bytes."""
    with_arrow_batches(df.sparkSession)
    schema = _with(df.schema, [T.StructField(decoded_col, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_path, pattern)
        for b in batches:
            rows = [vocab.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in b.column(ids_col)]
            yield _into_batch(b, {decoded_col: pa.array(rows, pa.binary())}, schema.names)

    return df.mapInArrow(run, schema)


def ids_digest(ids):
    """SHA-256, in hex, of decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)
