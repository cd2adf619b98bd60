"""Token-id output: one wavelet matrix per shard of documents.

A shard holds the ids of a range of documents, in ascending document order, as one self-contained
compressed blob: bit-planes of a wavelet matrix (most significant bit first, each plane stably
partitioned by the planes above it), a rank directory per plane, and the documents' ids and lengths.
It answers `access`, `rank` (occurrences of a token before a position) and `select` (place of the
k-th occurrence) from the few compressed pieces of each plane that hold what it asks for, and `tokens()`
restores all of it.

Shards are rows of a Parquet table (shard, n_docs, n_tokens, blob), one file per task, so any store
that Spark can write serves, and a lost executor only repeats its own shards.

Defined cases: a null or empty text is a document that holds the end token alone; rows without a
document id come first, rows of one id go by a hash of their text; many rows of one id, or without one,
are dealt over several shards by that hash; repeated rows are all kept; an empty table writes an empty
set of shards.  Columns beside the id and the text are not stored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelry.llm.textbuf import SpanCache, binary_array, buffers, slices

MAGIC = b"WVM1"
#: Bits between two entries of a plane's rank directory.
BLOCK = 2048
#: Bytes of a plane that are compressed together, a multiple of BLOCK bits.
PIECE = 1 << 15
#: Distinct pieces of text that a worker keeps with their ids (about 40 bytes each).
CACHED = 1_500_000
#: Tokens after which a task begins a new shard.
SHARD_TOKENS = 1 << 22
#: Ranges of documents at most; their bounds (8 bytes each) go through the driver and with every task.
MAX_RANGES = 16_384
#: Shards up to which their starts (24 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000
SHARD_SCHEMA = "shard long, part long, n_docs long, n_tokens long, blob binary"


class Plane:
    """The bits of a plane, in compressed pieces that are opened when they are read; the last one stays open."""

    def __init__(self, size: int, pieces: list[bytes]):
        self.size, self.pieces, self.last = size, pieces, (-1, np.zeros(0, np.uint8))

    @classmethod
    def of(cls, plane: np.ndarray) -> Plane:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        return cls(len(plane), [squeeze(plane[i : i + PIECE].tobytes()) for i in range(0, len(plane), PIECE)])

    def _piece(self, i: int) -> np.ndarray:
        import zstandard

        if self.last[0] != i:
            self.last = i, np.frombuffer(zstandard.ZstdDecompressor().decompress(self.pieces[i]), np.uint8)
        return self.last[1]

    def bytes(self, begin: int, end: int) -> np.ndarray:
        """Bytes begin up to end (or the plane's end), which must not cross a border of pieces."""
        end = min(end, self.size)
        if begin >= end:
            return np.zeros(0, np.uint8)
        start = begin // PIECE * PIECE
        return self._piece(begin // PIECE)[begin - start : end - start]

    def all(self) -> np.ndarray:
        return np.concatenate([self._piece(i) for i in range(len(self.pieces))]) if self.pieces else np.zeros(0, np.uint8)


class WaveletMatrix:
    def __init__(self, n: int, bits: int, planes: list[Plane], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros
        self.ranks = [r.astype(np.int64) for r in ranks]

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        now, planes, zeros, ranks = tokens, [], [], []
        for level in range(bits - 1, -1, -1):
            one = (now & tokens.dtype.type(1 << level)) != 0
            plane = np.packbits(one, bitorder="little")
            planes.append(Plane.of(plane))
            ranks.append(cls._directory(plane))
            low, high = now[~one], now[one]
            zeros.append(len(low))
            now = np.concatenate([low, high])
        return cls(len(tokens), bits, planes, zeros, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Set bits before each block of BLOCK bits."""
        step = BLOCK // 8
        padded = np.zeros(-(-max(1, len(plane)) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        sums = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)])

    def ones(self, level: int, at: int) -> int:
        """Set bits of a plane before position `at`."""
        block = at // BLOCK
        held = self.planes[level].bytes(block * BLOCK // 8, (at + 7) // 8)
        inside = at - block * BLOCK
        count = int(self.ranks[level][block]) + int(np.bitwise_count(held[: inside // 8]).sum())
        return count + (int(held[inside // 8]) & ((1 << (inside & 7)) - 1)).bit_count() if inside & 7 else count

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level].bytes(at >> 3, (at >> 3) + 1)[0]) >> (at & 7) & 1

    def _places_of_bits(self, level: int, bit: int, ks: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) bits of that value in a plane, for ascending ks."""
        before = self.ranks[level] if bit else np.arange(len(self.ranks[level])) * BLOCK - self.ranks[level]
        blocks = np.searchsorted(before, ks, "right") - 1
        out = np.empty(len(ks), np.int64)
        edges = np.flatnonzero(np.diff(blocks, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(ks)], strict=True):  # the hits of a block at once
            block = int(blocks[a])
            span = np.unpackbits(self.planes[level].bytes(block * BLOCK // 8, (block + 1) * BLOCK // 8), bitorder="little")
            out[a:b] = block * BLOCK + np.flatnonzero(span == bit)[ks[a:b] - before[block]]
        return out

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self.ones(level, at)
            value, at = value << 1 | bit, self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, token: int, at: int) -> tuple[int, int]:
        lo, hi = 0, at
        for level in range(self.bits):
            a, b = self.ones(level, lo), self.ones(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, at: int | None = None) -> int:
        """Occurrences of token before position `at` (default: in all)."""
        if token < 0 or token >> self.bits:
            return 0
        lo, hi = self._range(token, self.n if at is None else at)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of token, -1 if there are fewer."""
        if not 0 <= k < self.rank(token):
            return -1
        return int(self._positions(token, np.array([k]))[0])

    def positions(self, token: int) -> np.ndarray:
        """Positions of all occurrences of token."""
        return self._positions(token, np.arange(self.rank(token)))

    def _positions(self, token: int, ks: np.ndarray) -> np.ndarray:
        if not len(ks):
            return ks
        at = self._range(token, self.n)[0] + ks
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._places_of_bits(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """The whole sequence, by undoing the partitions from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level].all(), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[~one] = values[: self.zeros[level]]
            above[one] = values[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            values = above
        return values


def pack(doc_ids: list[int | None], lens: np.ndarray, tokens: np.ndarray) -> bytes:
    """Blob of one shard."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    m = WaveletMatrix.build(tokens)
    known = np.array([x is not None for x in doc_ids], bool)
    parts = [squeeze(np.array([x or 0 for x in doc_ids], "<i8").tobytes()), squeeze(np.packbits(known).tobytes()), squeeze(lens.astype("<u4").tobytes())]
    parts += [squeeze(np.diff(r).astype("<u2").tobytes()) for r in m.ranks] + [piece for p in m.planes for piece in p.pieces]
    head = json.dumps({"docs": len(doc_ids), "tokens": m.n, "bits": m.bits, "zeros": m.zeros, "sizes": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    import zstandard

    if blob[:4] != MAGIC:
        raise ValueError("not a token shard")
    size = struct.unpack("<I", blob[4:8])[0]
    head, at, parts, loosen = json.loads(blob[8 : 8 + size]), 8 + size, [], zstandard.ZstdDecompressor().decompress
    for n in head["sizes"]:
        parts.append(blob[at : at + n])
        at += n
    known = np.unpackbits(np.frombuffer(loosen(parts[1]), np.uint8), count=head["docs"]).tolist()
    ids = [x if k else None for x, k in zip(np.frombuffer(loosen(parts[0]), "<i8").tolist(), known, strict=True)]
    bits, plane = head["bits"], -(-head["tokens"] // 8)
    ranks = [np.concatenate([np.zeros(1, np.int64), np.cumsum(np.frombuffer(loosen(p), "<u2"), dtype=np.int64)]) for p in parts[3 : 3 + bits]]
    each = -(-plane // PIECE)
    planes = [Plane(plane, parts[3 + bits + k * each : 3 + bits + (k + 1) * each]) for k in range(bits)]
    return ids, np.frombuffer(loosen(parts[2]), "<u4"), WaveletMatrix(head["tokens"], bits, planes, head["zeros"], ranks)


def range_bounds(ids: DataFrame, per_range: int) -> list[int]:
    """Approximate quantiles of the long column `d`, one for every `per_range` rows but the last, at most MAX_RANGES - 1; a value that holds several ranges stands there as often."""
    ranges = min(MAX_RANGES, max(1, -(-ids.count() // per_range)))
    return sorted(int(x) for x in ids.approxQuantile("d", [i / ranges for i in range(1, ranges)], 0.1 / ranges)) if ranges > 1 else []


def range_of(bounds: np.ndarray, values: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Range of each value; the rows of a value that stands in the bounds several times are dealt out by their hashes, in the order of these."""
    low, high = np.searchsorted(bounds, values, "left"), np.searchsorted(bounds, values, "right")
    several = high - low > 1
    if several.any():
        share = (hashes[several].astype(np.float64) / 2.0**64 + 0.5) % 1  # ascending with the signed hash
        high[several] = low[several] + 1 + np.minimum((share * (high - low)[several]).astype(np.int64), (high - low)[several] - 1)
    return high


def _pieces(buf: np.ndarray, offs: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that the tokenizer handles one by one: runs without space or line feed, cut between an
    ASCII letter and a following mark of `.,!?;:*#$%&|` (the pre-tokenizer always cuts there).

    fold: also the buffer with A-Z lowered in spans of ASCII alone (elsewhere a combining mark could
    make lowering before composition differ from lowering after it).  Without it, which is for texts
    that may name special tokens, there are no cuts but at spaces and line feeds.
    """
    n = len(buf)
    gap = (buf == 0x20) | (buf == 0x0A)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    mark = _MARKS[buf] & fold
    cut = edge[:-1].copy()
    cut[1:] |= gap[:-1] | (mark[1:] & _LETTERS[buf[:-1]])
    starts = np.flatnonzero(cut & ~gap)
    stop = edge[1:].copy()
    stop[:-1] |= gap[1:] | (mark[1:] & _LETTERS[buf[:-1]])
    ends = np.flatnonzero(stop & ~gap) + 1
    if fold and n and len(starts):
        wide = np.zeros(n + 1, np.int64)
        np.cumsum(buf >= 0x80, out=wide[1:])
        upper = (buf >= 0x41) & (buf <= 0x5A)
        plain = np.zeros(n, bool)
        ok = wide[ends] == wide[starts]
        size = ends - starts
        plain[np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(ok, size)
        buf = buf + (upper & plain).astype(np.uint8) * np.uint8(32)
    return buf, starts, ends


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,!?;:*#$%&|")] = True

_NO_ID = -(1 << 63)
_workers: dict[int, tuple] = {}


def _tokenizer(shared, kind):
    """Tokenizer and cache of this Python worker."""
    text, special = shared.value
    key = hash((text, kind))
    if key not in _workers:
        from tokenizers import Tokenizer

        _workers.clear()
        _workers[key] = Tokenizer.from_str(text), SpanCache(CACHED, np.dtype(kind)), special
    return _workers[key]


def _id_type(content: str, end_id: int = 0) -> str:
    """numpy name of the least unsigned type that holds all ids of a tokenizer file."""
    found = json.loads(content)
    vocab = found["model"]["vocab"]
    ids = [*(vocab.values() if isinstance(vocab, dict) else [len(vocab)]), *(t["id"] for t in found.get("added_tokens", [])), end_id]
    return "<u2" if max(ids) < 1 << 16 else "<u4"


def encode(docs: DataFrame, doc_id: str, text: str, tokenizer_path: str, bounds: list[int], end_id: int = 0) -> DataFrame:
    """shard, doc_id, h (a hash of the text) and ids (binary, 2 or 4 bytes an id) of each text, without the end token.

    Only for tokenizers that drop white space between pre-tokens, fold case and read ASCII marks after
    a letter as pre-tokens of their own.  Each distinct piece is encoded by the tokenizers library once
    in a worker.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    kind = _id_type(content, end_id)
    special = [t["content"] for t in json.loads(content).get("added_tokens", [])]
    shared = docs.sparkSession.sparkContext.broadcast((content, special))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache, special = _tokenizer(shared, kind)
        limits = np.array(bounds, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = buffers(part.column(1))
                raw = buf.tobytes()
                fold = not any(s.encode().lower() in raw.lower() for s in special)
                buf, starts, ends = _pieces(buf, offs, fold)
                flat, lens = cache.ids(buf, starts, ends, lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)])  # noqa: B023
                sums = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(lens, out=sums[1:])
                width = flat.dtype.itemsize
                place = part.column(0)
                shard = range_of(limits, place.fill_null(_NO_ID).to_numpy(), part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), place, part.column(2), binary_array(flat.view(np.uint8), width * sums[np.searchsorted(starts, offs)])], names=["shard", "doc_id", "h", "ids"])

    body = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("h")).mapInArrow(run, "shard long, doc_id long, h long, ids binary")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", docs_per_range: int = 2048) -> None:
    """Encode all texts and write the shards under `path`.

    Documents are dealt out by ranges of doc_id between approximate quantiles, in one shuffle of ids;
    a range that exceeds SHARD_TOKENS is written as several parts.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("d")), docs_per_range)
    with open(tokenizer_path, encoding="utf-8") as f:
        kind = np.dtype(_id_type(f.read(), end_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, ids, lens, flat, held = None, 0, [], [], [], 0

        def done():
            nonlocal ids, lens, flat, held, part
            if ids:
                tokens = np.concatenate(flat)
                blob = pack(ids, np.array(lens, np.int64), tokens)
                row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int64()), (part, pa.int64()), (len(ids), pa.int64()), (len(tokens), pa.int64()), (blob, pa.binary()))], names=["shard", "part", "n_docs", "n_tokens", "blob"])
                ids, lens, flat, held = [], [], [], 0
                part += 1
                yield row

        end = np.array([end_id], kind)
        for batch in batches:
            raw, offs = buffers(batch.column(3))
            tokens = np.frombuffer(raw.tobytes(), kind)
            marks = offs // kind.itemsize
            for s, d, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                if s != shard or held >= SHARD_TOKENS:
                    yield from done()
                    if s != shard:
                        shard, part = s, 0
                ids.append(d)
                lens.append(b - a + 1)
                flat += [tokens[a:b], end]
                held += b - a + 1
        yield from done()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = encode(docs, doc_id, text, tokenizer_path, bounds, end_id).repartition(min(len(bounds) + 1, 4 * tasks), "shard")
    dealt.sortWithinPartitions("shard", "doc_id", "h", "ids").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "none").mode("overwrite").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(spark: SparkSession, path: str, per_group: int = 4096) -> DataFrame:
    """shard, part and start: the ids of all shards before, by a two-level running sum; the upper level has at most MAX_RANGES / per_group rows."""
    sizes = shards(spark, path).select("shard", "part", "n_tokens").withColumn("g", F.expr(f"shard div {per_group}"))
    inner = F.sum("n_tokens").over(Window.partitionBy("g").orderBy("shard", "part")) - F.col("n_tokens")
    groups = sizes.groupBy("g").agg(F.sum("n_tokens").alias("t"))
    before = groups.select("g", (F.sum("t").over(Window.orderBy("g")) - F.col("t")).alias("before"))
    return sizes.withColumn("inner", inner).join(before, "g").select("shard", "part", (F.col("inner") + F.col("before")).alias("start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit, with the end token) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lens, matrix = unpack(batch.column(3)[i].as_py())
                flat, ends = matrix.tokens().astype("<u4"), np.cumsum(lens.astype(np.int64))
                step = 512
                for a in range(0, len(ids), step):
                    b = min(len(ids), a + step)
                    at = np.concatenate([ends[a : a + 1] - lens[a : a + 1], ends[a:b]])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(at[:-1] + batch.column(2)[i].as_py(), pa.int64()), pa.array(lens[a:b].astype(np.int64)), binary_array(flat[at[0] : at[-1]].view(np.uint8), 4 * (at - at[0]))], names=["doc_id", "start", "n_tokens", "ids"])

    starts = shard_starts(spark, path)
    if shards(spark, path).count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    joined = shards(spark, path).join(starts, ["shard", "part"]).select("shard", "part", "start", "blob")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and count over all shards, by rank queries on the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                m = unpack(blob.as_py())[2]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.rank(t) for t in tokens], pa.int64())], names=["token", "n"])

    return shards(spark, path).select("blob").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id and position (from 0, in the document) of every occurrence of a token, by select queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                ids, lens, m = unpack(blob.as_py())
                ends = np.cumsum(lens.astype(np.int64))
                at = m.positions(token)
                doc = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], pa.int64()), pa.array(at - (ends[doc] - lens[doc]), pa.int64())], names=["doc_id", "position"])

    return shards(spark, path).select("blob").mapInArrow(run, "doc_id long, position long")
