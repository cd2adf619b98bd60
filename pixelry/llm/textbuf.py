"""Arrow text batches as flat byte buffers, and the small numpy helpers that the text operators share.

A batch of texts is one byte buffer plus offsets, so words, spans and their 64-bit hashes come from a
few vector operations instead of a Python loop over words.  Buffers are handled in slices of a few
MiB, so a task's memory does not depend on the size of its partition (one longer text forms a slice
of its own).
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
#: Slices after which a worker gives unused memory back.
TIDY_SLICES = 16

#: Modulus of the two span hashes, a Mersenne prime, and their bases (powers of the primitive root 7 with exponents prime to the group's order).
_PRIME = (1 << 31) - 1
_BASES = (pow(7, 1_000_003, _PRIME), pow(7, 2_000_003, _PRIME))
_VALUES = np.random.default_rng(20240607).integers(1, _PRIME, (2, 256)).astype(np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint32) for _ in range(4)]

#: Space and \t \n \v \f \r: the white space that ends a word `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime but for a multiple of it, in few bits."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the two bases and of their inverses."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for i, base in enumerate((*_BASES, *(pow(b, -1, _PRIME) for b in _BASES))):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, _reduced(p * np.uint64(pow(base, len(p), _PRIME)))])[:size]
            _powers[i] = p.astype(np.uint32)
    return [p[:n] for p in _powers]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHasher:
    """Hashes of any number of spans of one buffer of bytes or 64-bit values; a span's hash depends on its items alone.

    Two polynomial hashes modulo 2^31 - 1 with different bases and random item values, which no fixed pair
    of texts is known to defeat; the difference of two prefix sums gives a span's.
    """

    def __init__(self, items: np.ndarray):
        *p, self.inverse_1, self.inverse_2 = powers(len(items) + 1)
        if items.dtype == np.uint8:
            values = [v[items] for v in _VALUES]
        else:
            mixed = mix(items.astype(np.uint64))
            values = [mixed & np.uint64(_PRIME), mixed >> np.uint64(33)]
        self.sums = [np.zeros(len(items) + 1, np.uint64) for _ in range(2)]
        for out, v, q in zip(self.sums, values, p, strict=True):
            np.cumsum(_fold(v * q[:-1]), out=out[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = (_reduced(_fold(_fold(s[ends] - s[starts])) * q[starts]) for s, q in zip(self.sums, (self.inverse_1, self.inverse_2), strict=True))
        return mix(mix((one << np.uint64(31)) | two) + (ends - starts).astype(np.uint64))


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether the spans of two byte buffers are equal, span by span (of equal lengths)."""
    if not len(lens):
        return np.zeros(0, bool)
    ends = np.cumsum(lens)
    inside = np.arange(ends[-1]) - np.repeat(ends - lens, lens)
    differs = a[np.repeat(a_starts, lens) + inside] != b[np.repeat(b_starts, lens) + inside]
    if not differs.any():
        return np.ones(len(lens), bool)
    count = np.zeros(len(differs) + 1, np.int64)
    np.cumsum(differs, out=count[1:])
    return count[ends] == count[ends - lens]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def tidy() -> None:
    """Give memory that the allocators keep back to the system, for the other processes of the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts sum to at most `most` bytes, or single rows beyond that."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at, n = 0, 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, stop - at)
        at, n = stop, n + 1
        if n % TIDY_SLICES == 0 or at == len(sizes):
            tidy()


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts sum to at most `most` bytes, each of as many of the given ones as that allows; larger ones stay as they are."""
    held, size = [], 0
    for batch in batches:
        more = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + more > most:
            whole, held, size = pa.concat_batches(held), [], 0
            yield whole
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def binary_array(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over one buffer (offsets in bytes, below 2 GiB)."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words `[^\\x20\\x09-\\x0D]+`; no word crosses two texts."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    space = SPACES[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True  # also at n
    first = ~space
    first[1:] &= space[:-1] | edge[1:-1]
    last = ~space
    last[:-1] &= space[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def code_points(buf: np.ndarray) -> np.ndarray:
    """Running count of code points (length + 1): spans' lengths in characters are differences."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def per_text(values: np.ndarray, text_no: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text_no, weights=values, minlength=n).astype(np.int64) if len(text_no) else np.zeros(n, np.int64)


def span_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span: up to 7 bytes are the key itself, with their number; longer spans have a hash, whose first byte is 255."""
    size = ends - starts
    key = size.astype(np.uint64) << np.uint64(56)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    for i in range(7):
        key |= np.where(size > i, padded[starts + i], 0).astype(np.uint64) << np.uint64(8 * i)
    long = np.flatnonzero(size > 7)
    if len(long):
        key[long] = SpanHasher(buf)(starts[long], ends[long]) | np.uint64(0xFF << 56)
    return key


class SpanCache:
    """Id sequences of distinct spans, found by a 64-bit key and held with their bytes, in flat arrays.

    A span takes ids from the cache only if its bytes are those of the entry; spans that share a key with
    another text are encoded by themselves.  The cache holds at most `most` spans and starts afresh beyond
    that, which bounds a worker's memory.
    """

    #: Entries of the sorted list that takes the new keys, before it is merged with the long one.
    RECENT = 1 << 16

    def __init__(self, most: int = 500_000, dtype=np.uint16):
        self.most, self.dtype = most, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int32)] * 2  # the long list and the recent one
        self.places, self.n = np.zeros((1 << 12, 4), np.int32), 0  # start and number of ids, start and number of bytes
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _room(pool: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(pool):
            return pool
        return np.concatenate([pool[:used], np.zeros((max(used + more, used + (used >> 1)) - used, *pool.shape[1:]), pool.dtype)])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not held."""
        out = np.full(len(keys), -1, np.int64)
        for held, rows in zip(self.keys, self.rows, strict=True):
            if len(held):
                at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                out = np.where(held[at] == keys, rows[at], out)
        return out

    def _add(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        """keys: sorted and not held."""
        size, k = ends - starts, len(keys)
        self.pool, self.text, self.places = self._room(self.pool, self.used, len(flat)), self._room(self.text, self.text_used, int(size.sum())), self._room(self.places, self.n, k)
        self.pool[self.used : self.used + len(flat)] = flat
        text_starts = self.text_used + np.cumsum(size) - size
        self.text[self.text_used : self.text_used + size.sum()] = buf[np.repeat(starts - text_starts, size) + np.arange(self.text_used, self.text_used + size.sum())]
        self.places[self.n : self.n + k] = np.stack([self.used + np.cumsum(lens) - lens, lens, text_starts, size], 1)
        self._insert(1, keys, np.arange(self.n, self.n + k, dtype=np.int32))
        if len(self.keys[1]) > self.RECENT:
            self._insert(0, self.keys[1], self.rows[1])
            self.keys[1], self.rows[1] = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.n, self.used, self.text_used = self.n + k, self.used + len(flat), self.text_used + int(size.sum())

    def _insert(self, which: int, keys: np.ndarray, rows: np.ndarray) -> None:
        at = np.searchsorted(self.keys[which], keys)
        self.keys[which], self.rows[which] = np.insert(self.keys[which], at, keys), np.insert(self.rows[which], at, rows)

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans, one after the other, and the number of ids of each; encode is given the texts of spans that are not held."""

        def fresh(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = memoryview(buf)
            found = encode([str(raw[a:b], "utf-8") for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            lens = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((x for y in found for x in y), self.dtype, int(lens.sum())), lens

        buf = np.ascontiguousarray(buf)
        keys, first, back = distinct(span_keys(buf, starts, ends))
        if self.n + len(keys) > self.most:
            self.clear()
        row = self._find(keys)
        new = np.flatnonzero(row < 0)
        if len(new):
            which = first[new]
            row[new] = np.arange(self.n, self.n + len(new))
            self._add(keys[new], buf, starts[which], ends[which], *fresh(which))
        place = self.places[row][back].astype(np.int64)
        begin, lens, pool = place[:, 0].copy(), place[:, 1].copy(), self.pool
        long = np.flatnonzero(ends - starts > 7)  # shorter ones have their bytes as key
        alike = place[long, 3] == (ends - starts)[long]
        some = long[alike]
        alike[alike] = same_bytes(buf, starts[some], self.text, place[some, 2], place[some, 3])
        odd = long[~alike]
        if len(odd):
            flat, n = fresh(odd)
            begin[odd], lens[odd], pool = self.used + np.cumsum(n) - n, n, np.concatenate([self.pool[: self.used], flat])
        stop = np.cumsum(lens)
        return pool[np.repeat(begin - stop + lens, lens) + np.arange(stop[-1] if len(stop) else 0)], lens


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a position of each, and each key's place among them."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    back = np.empty(len(s), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], order[new], back


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], most: int = SLICE_BYTES, gather: bool = False) -> DataFrame:
    """df and new columns computed from slices of its rows.

    `make` is called once in each task and returns the function from a slice to the new columns'
    arrays.  A column of df that has the name of a new one is replaced.  With gather, a slice may hold rows
    of several Arrow batches.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in gathered(batches, text, most) if gather else batches:
            for part in slices(batch, text, most):
                cols = [part.column(c) for c in kept] + list(f(part))
                yield pa.RecordBatch.from_arrays(cols, names=kept + [x.name for x in fields])

    return df.mapInArrow(run, schema)


def free_name(columns: list[str], name: str) -> str:
    """A column name like `name` that none of `columns` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows up to which `small` broadcasts a table (under 100 bytes a row).
BROADCAST_ROWS = 400_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most `most` rows (BROADCAST_ROWS where none is given), else as it is."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def checkpoint_dir(spark) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode and an error on a cluster."""
    from pyspark.errors import PySparkException

    try:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    except PySparkException:
        found = None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends at a replicated copy."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables made by `saved` that no result depends on any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
