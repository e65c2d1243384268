"""Byte-level BPE encoding and decoding with numpy matrices.

Distinct pieces of a batch are put in matrices of one row each, padded to a power of two. In each round every row
merges its leftmost pair of minimum rank; pairs are looked up in an open-addressing hash table held in two numpy
arrays, rows without a pair left the matrix, and the rest is compacted by one column, for each has lost one symbol.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import added_schema, gather, small_batches, with_column

NONE = np.int64(1 << 40)
#: Pieces of more bytes than this are merged with a heap, for the matrix takes a round for each merge.
LONG = 1024
#: Cells of one matrix, and pieces that a worker remembers, at most.
CELLS, REMEMBERED = 1 << 20, 250_000


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PairTable:
    """rank of the token that two neighbouring tokens merge into, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        bits = max(4, (len(pairs) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slots = self._slot(keys)
        while len(keys):  # each free slot goes to one of those that want it; the others try the next
            free = self.keys[slots] == -1
            self.keys[slots[free]], self.values[slots[free]] = keys[free], values[free]
            left = self.keys[slots] != keys
            fixed = ~left & (self.values[slots] != values)
            self.values[slots[fixed]] = values[fixed]
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        wait = np.flatnonzero((found != keys) & (found != -1))
        while len(wait):
            slots[wait] = (slots[wait] + 1) & self.mask
            found = self.keys[slots[wait]]
            hit = found == keys[wait]
            out[wait[hit]] = self.values[slots[wait[hit]]]
            wait = wait[~hit & (found != -1)]
        return out


class ByteBpe:
    """Encoder and decoder of one vocabulary; raw: the lines of a .tiktoken file."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line)}
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(self.ranks)
        self.byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    # -- merging

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                out[i] = np.array([rank], np.int64)
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            else:
                buckets.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._merge_matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = self.byte[raw]
        cols = np.arange(width)
        ids[cols >= size[:, None]] = -1
        rank = np.full((len(pieces), width - 1), NONE, np.int64)
        real = cols[1:] < size[:, None]
        rank[real] = self.pairs(ids[:, :-1][real], ids[:, 1:][real])
        row = np.arange(len(pieces))
        while len(row):
            best = rank.argmin(1)  # the leftmost of equals
            at = np.arange(len(row))
            low = rank[at, best]
            done = low == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k, : size[k]]
                live = ~done
                ids, rank, row, size, best, low = ids[live], rank[live], row[live], size[live], best[live], low[live]
                at = np.arange(len(row))
                if not len(row):
                    break
            ids[at, best] = low
            size = size - 1
            n = ids.shape[1] - 1
            c = np.arange(n)
            ids = np.take_along_axis(ids, c + (c > best[:, None]), 1)
            if n == 1:
                for k in at:
                    out[row[k]] = ids[k, :1]
                break
            c = np.arange(n - 1)
            rank = np.take_along_axis(rank, c + (c > best[:, None]), 1)
            # the merged symbol's pairs: with its left neighbour, and with its right one
            left = best > 0
            rank[at[left], best[left] - 1] = self.pairs(ids[at[left], best[left] - 1], low[left])
            right = best + 1 < size
            rank[at[right], best[right]] = self.pairs(low[right], ids[at[right], best[right] + 1])
            last = ~right & (best < n - 1)
            rank[at[last], best[last]] = NONE
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        heap = [(int(r), i, int(ids[i]), int(ids[i + 1])) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        sym, nxt, prv = ids.tolist(), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        one = lambda a, b: int(self.pairs(np.array([a], np.int64), np.array([b], np.int64))[0])
        seen: dict[tuple[int, int], int] = {}
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] is not None else len(sym)
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i] = r, None, nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right < len(sym):
                    pair = sym[left], sym[right]
                    if pair not in seen:
                        seen[pair] = one(*pair)
                    if seen[pair] != NONE:
                        heapq.heappush(heap, (seen[pair], left, *pair))
        return np.array([s for s in sym if s is not None], np.int64)

    # -- whole texts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        split = self.split
        parts = [split(t) if t else [] for t in texts]
        pieces = [p for part in parts for p in part]
        new = list({p for p in pieces if p not in self.known})
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.forget()
            new = list(set(pieces))
        if new:
            got = self.merge([p.encode() for p in new])
            sizes = np.array([len(g) for g in got], np.int64)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.lens = np.concatenate([self.lens, sizes])
            self.flat = np.concatenate([self.flat, np.concatenate(got).astype(np.int32)])
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        lens = self.lens[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ends[bounds], gather(self.flat, self.starts[at], lens)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, bytes) of the lists of ids."""
        lens = self.token_len[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return ends[offsets], gather(self.token_bytes, self.token_at[ids], lens)


_codecs: dict[tuple[int, str], ByteBpe] = {}


def _codec(raw: bytes, pattern: str) -> ByteBpe:
    key = hash(raw), pattern
    if key not in _codecs:
        _codecs[key] = ByteBpe(raw, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array<int> column of token ids, each match of the pattern encoded separately, no special tokens.

    Null and empty texts get an empty array; every other column, duplicates of rows included, passes unchanged. A
    column that has the output's name is replaced. Bytes that no match covers are not encoded, as in the library.
    """
    small_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        codec = _codec(raw.value, pattern)
        for b in batches:
            offsets, flat = codec.encode(b.column(text).to_pylist())
            yield with_column(b, ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))

    return docs.mapInArrow(run, added_schema(docs, (ids, "array<int>")))


def decode_documents(docs: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a binary column that holds the bytes of its token ids. A null array decodes to no bytes."""
    small_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        codec = _codec(raw.value, r"(?!)")
        for b in batches:
            col = b.column(ids)
            if col.null_count:
                col = pa.array([x or [] for x in col.to_pylist()], pa.list_(pa.int32()))
            at = col.offsets.to_numpy().astype(np.int64)
            flat = col.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            offsets, data = codec.decode(at - at[0], flat)
            buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
            yield with_column(b, out, pa.BinaryArray.from_buffers(pa.binary(), len(col), buffers))

    return docs.mapInArrow(run, added_schema(docs, (out, "binary")))
