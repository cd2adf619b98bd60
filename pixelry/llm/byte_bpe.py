"""Byte-level BPE encoding and decoding of text columns.

Lookup has two tiers.  A minimal perfect hash over the vocabulary resolves each pre-token that is a
vocabulary entry as a whole; every other pre-token is merged with a heap of candidate pairs over a
linked list of its bytes.  Texts are cut before white space that follows a non-space character (the
pre-token pattern never crosses such a place), so both tiers run once for each distinct piece that a
worker meets; the ids of a batch are then gathered from arrays.

Defined cases: a null or empty text has no ids (empty binary); lone bytes, very long words and runs of
white space are encoded like any other text; ids are little-endian unsigned 32-bit integers in a
binary column.  Columns of the input that have the name of an output column are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelry.llm.textbuf import SPACES, SpanCache, binary_array, buffers, with_columns


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: hash and displace, n slots for n keys.

    Keys fall into buckets of about four; for each bucket, largest first, the least displacement is
    stored that sends its keys to free slots.  A lookup compares the key held in the slot, so strings
    outside the set are recognised.
    """

    def __init__(self, keys: dict[bytes, int]):
        import xxhash

        self.n = max(1, len(keys))
        self.n_buckets = max(1, self.n // 4)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.n_buckets)]
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            buckets[h % self.n_buckets].append((h, k))
        self.shift = [0] * self.n_buckets
        self.slots: list[tuple[bytes, int] | None] = [None] * self.n
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            if not buckets[b]:
                break
            d = 0
            while True:
                places = [self._place(h, d) for h, _ in buckets[b]]
                if len(set(places)) == len(places) and all(self.slots[p] is None for p in places):
                    break
                d += 1
            self.shift[b] = d
            for p, (_, k) in zip(places, buckets[b], strict=True):
                self.slots[p] = (k, keys[k])

    def _place(self, h: int, d: int) -> int:
        x = ((h >> 17) + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 >> 20) % self.n

    def get(self, key: bytes, h: int) -> int | None:
        """The value of key, whose 64-bit hash is h."""
        held = self.slots[self._place(h, self.shift[h % self.n_buckets])]
        return held[1] if held is not None and held[0] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merge the pair of least rank, the leftmost of equals.

    `right[i]` and `left[i]` link the start bytes of the parts that remain; heap entries whose part
    was merged or changed meanwhile are recognised by their rank and skipped.
    """
    n = len(piece)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at: list[int | None] = [ranks.get(piece[i : i + 2]) for i in range(n - 1)] + [None]
    heap = [(r, i) for i, r in enumerate(rank_at) if r is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if rank_at[i] != r:
            continue
        j = right[i]
        end = right[i] = right[j]
        rank_at[j] = None
        if end < n:
            left[end] = i
            rank_at[i] = s = ranks.get(piece[i : right[end]])
            if s is not None:
                heapq.heappush(heap, (s, i))
        else:
            rank_at[i] = None
        h = left[i]
        if h >= 0:
            rank_at[h] = s = ranks.get(piece[h:end])
            if s is not None:
                heapq.heappush(heap, (s, h))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        import regex
        import xxhash

        self.ranks, self.find, self.hash = ranks, regex.compile(pattern).findall, xxhash.xxh3_64_intdigest
        self.whole = (table or PerfectHash(ranks)).get

    def piece(self, text: str) -> list[int]:
        out: list[int] = []
        for token in self.find(text):
            raw = token.encode()
            found = self.whole(raw, self.hash(raw))
            if found is None:
                out += merge_bytes(raw, self.ranks)
            else:
                out.append(found)
        return out


def cut_places(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted starts of pieces: text starts, and spaces or line feeds after a character that is no white space."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    cut = np.zeros(n, bool)
    cut[1:] = SPACES[buf[1:]] & ~SPACES[buf[:-1]]
    at = np.flatnonzero(cut)
    b1 = buf[at - 1]
    wide = b1 >= 0x80
    if wide.any():  # the last bytes of U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F and 3000
        b2 = np.where(at >= 2, buf[at - 2], 0)
        space = wide & (((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | (b2 == 0x80) | (b2 == 0x81) | (b2 == 0x9A))
        at = at[~space]
        b1 = b1[~space]
    at = at[(b1 < 0x1C) | (b1 > 0x1F)]
    starts = offs[:-1][offs[:-1] < offs[1:]]
    return np.union1d(at, starts)


def _encoding(ranks_of, pattern: str, dtype) -> Callable:
    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        encoder = _worker_encoder(ranks_of, pattern)
        cache = encoder.cache

        def encode(part: pa.RecordBatch) -> list[pa.Array]:
            buf, offs = buffers(part.column(part.schema.get_field_index(make.text)))
            starts = cut_places(buf, offs)
            ends = np.append(starts[1:], len(buf))
            flat, lens = cache.ids(buf, starts, ends, lambda texts: [encoder.piece(x) for x in texts])
            sums = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(lens, out=sums[1:])
            return [binary_array(flat.astype("<u4").view(np.uint8), 4 * sums[np.searchsorted(starts, offs)])]

        return encode

    return make


_encoders: dict[tuple, Encoder] = {}


def _worker_encoder(shared, pattern: str) -> Encoder:
    """One encoder and cache for each vocabulary and Python worker, kept across tasks."""
    ranks, table = shared.value
    key = (hash(frozenset(list(ranks.items())[:4096])), len(ranks), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = e = Encoder(ranks, pattern, table)
        e.cache = SpanCache(dtype=np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32)
    return _encoders[key]


def encode(df: DataFrame, text: str, ranks_path: str, pattern: str, out: str = "ids") -> DataFrame:
    """df and the column `out`: the ids of each whole text (binary, 4 little-endian bytes an id).

    The vocabulary file is read on the driver and broadcast (its size does not depend on the data).
    """
    ranks = load_ranks(ranks_path)
    shared = df.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    make = _encoding(shared, pattern, np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32)
    make.text = text
    return with_columns(df, text, [T.StructField(out, T.BinaryType())], make)


def decode(df: DataFrame, ids: str, ranks_path: str, out: str = "decoded") -> DataFrame:
    """df and the column `out`: the bytes of the ids in the binary column `ids` (null: empty)."""
    ranks = load_ranks(ranks_path)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        ranks = shared.value
        token = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            token[v] = k
        lens = np.array([len(t) for t in token], np.int64)
        begins = np.cumsum(lens) - lens
        pool = np.frombuffer(b"".join(token), np.uint8)

        def f(part: pa.RecordBatch) -> list[pa.Array]:
            buf, offs = buffers(part.column(part.schema.get_field_index(ids)))
            got = np.frombuffer(buf.tobytes(), "<u4")
            size = lens[got]
            sums = np.zeros(len(got) + 1, np.int64)
            np.cumsum(size, out=sums[1:])
            raw = pool[np.repeat(begins[got] - sums[:-1], size) + np.arange(sums[-1])]
            return [binary_array(raw, sums[offs // 4])]

        return f

    return with_columns(df, ids, [T.StructField(out, T.BinaryType())], make)
