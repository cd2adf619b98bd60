"""Exact set-similarity join on word shingles, with both kinds of set-relation skipping.

Two documents link when the Jaccard similarity of their distinct 5-word shingles is 0.75 or more.

* Index-level skipping.  Shingles are ordered from rare to frequent (by a counting sketch of fixed
  size; any order gives right results, this one keeps lists short), and only the prefix of a set that
  every partner must meet is indexed.  Inverted lists are kept by position in blocks, and a block is
  skipped when the sizes and positions in it rule out enough overlap.
* Answer-level skipping.  Sets of equal shingles form one node.  Nodes that share a min-hash with many
  others are first compared with a few leaders, those made of the family's commonest shingles; the
  links found there join highly similar sets into parts.  What one set of a part finds holds for the
  part: lists carry the part of each entry, blocks of one part are skipped against each other, and only
  pairs across parts are checked.  Inside a part the answers of all its sets are derived from one set, its
  root: a set is held as what it adds to the root and what it lacks, and the overlap of two sets is that of
  the root less what either lacks, plus what both lack or both add.

All steps are Spark shuffles of packed blocks.  Copies are never expanded into pairs, and no list, group or
component is gathered on the driver; tables are broadcast only when counted small, else joined.

Defined cases: a null or empty text, or white space alone, has an empty set, links with nothing and is its
own component; a text of fewer than 5 words has its word sequence as one shingle; repeated rows and
equal ids are kept and share their nodes; rows without an id keep a null component unless a linked row
has an id; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelry.llm import textbuf
from pixelry.llm.components import connected_components
from pixelry.llm.textbuf import SpanHasher, binary_array, buffers, dropped, mix, saved, slices, small, word_spans

SHINGLE = 5
#: Least similarity, as NUMERATOR / DENOMINATOR: overlap * (N + D) >= N * (size + size).
NUMERATOR, DENOMINATOR = 3, 4
#: Slots of the frequency sketch (bytes to broadcast).
SKETCH_BITS = 22
#: Nodes that share a min-hash from which on leaders are sought; nodes compared in one run; leaders of a run; min-hashes.
FAMILY, RUN, LEADERS, MIN_HASHES = 8, 512, 6, 3
#: Index entries that one partition is to hold, and the buckets into which it is cut; occurrences of a shingle from which on its list is dealt out in pairs of groups.
ENTRIES, BUCKETS, LONG_LIST = 1_000_000, 8, 50_000
BLOCK = 32
#: Nodes that a task remembers, not to count or send them again; bytes of sets that a task indexes at once.
SEEN, INDEX_BYTES = 200_000, 2 << 20
#: Sets of a part whose links are counted together.
PART_BLOCK = 1024

_SALTS = [np.uint64(x) for x in (0x8A5CD789635D2DFF, 0x121FD2155C472F96, 0x51ED270B7F1E2C33)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and offsets."""
    n = len(offs) - 1
    lower = buf + ((buf >= 0x41) & (buf <= 0x5A)).astype(np.uint8) * np.uint8(32)
    starts, ends, text = word_spans(lower, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    words = SpanHasher(lower)(starts, ends)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    size = np.where(count == 0, 0, np.maximum(count - SHINGLE + 1, 1))
    owner = np.repeat(np.arange(n), size)
    begin = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    length = np.minimum(count, SHINGLE)[owner]
    h = np.full(len(begin), 0x9E37, np.uint64) + length.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(k < length, padded[begin + k], np.uint64(k)))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner[new], minlength=n), out=out[1:])
    return h[new], out


def _reduce(f, values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """f over each set; 0 for empty sets."""
    out = np.zeros(len(offs) - 1, np.uint64)
    full = offs[1:] > offs[:-1]
    if full.any():
        out[full] = f.reduceat(values, offs[:-1][full])
    return out


def _node(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64-bit name of each set: sums and exclusive-ors of its mixed shingles and its size."""
    size = (offs[1:] - offs[:-1]).astype(np.uint64)
    return mix(_reduce(np.add, mix(h ^ _SALTS[0]), offs) * np.uint64(0x9E3779B97F4A7C15) + _reduce(np.bitwise_xor, mix(h ^ _SALTS[1]), offs) + size)


def _signatures(h: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    return [_reduce(np.minimum, mix(h ^ salt), offs) for salt in _SALTS[:MIN_HASHES]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _info(docs: DataFrame, sketch_bits: int) -> DataFrame:
    """Rows of kind 0: doc_id, node, n, sigs and text_hash of each document; of kind 1: a task's part of the sketch."""
    chunk = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts, seen = np.zeros(1 << sketch_bits, np.uint32), set()
        names = ["kind", "doc_id", "node", "n", *(f"sig{i}" for i in range(MIN_HASHES)), "text_hash", "blob"]
        for batch in batches:
            for part in slices(batch, "text"):
                h, offs = shingle_sets(*buffers(part.column(1)))
                node, k = _node(h, offs), part.num_rows
                fresh = np.array([x not in seen for x in node.tolist()], bool)
                seen.update(node.tolist())
                if len(seen) > SEEN:
                    seen.clear()
                np.add.at(counts, (h[np.repeat(fresh, np.diff(offs))] >> np.uint64(64 - sketch_bits)).astype(np.int64), np.uint32(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), part.column(0), _signed(node), pa.array(np.diff(offs)), *map(_signed, _signatures(h, offs)), part.column(2), pa.nulls(k, pa.binary())], names=names)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        rows = [(i, squeeze(counts[i * chunk : (i + 1) * chunk].tobytes())) for i in range(-(-len(counts) // chunk))] if counts.any() else []
        if rows:
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array([i for i, _ in rows], pa.int64()), *[pa.array(np.zeros(k, np.int64))] * (2 + MIN_HASHES), pa.array([b for _, b in rows], pa.binary())], names=names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "kind int, doc_id long, node long, n long, " + "".join(f"sig{i} long, " for i in range(MIN_HASHES)) + "text_hash long, blob binary")


def _sketch(info: DataFrame, sketch_bits: int) -> np.ndarray:
    """Quarter-logarithms of the summed counts: 2^sketch_bits bytes, whatever the size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32).astype(np.uint64)
                sums[i] = sums[i] + c if i in sums else c
        for i, c in sums.items():
            level = np.floor(4 * np.log2(c.astype(np.float64) + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([level.tobytes()], pa.binary())], names=["i", "level"])

    rows = info.where("kind = 1").select(F.col("node").alias("i"), "blob").repartition(16, "i").mapInArrow(run, "i long, level binary").collect()
    out = np.zeros(1 << sketch_bits, np.uint8)
    for r in rows:
        out[r.i << 16 : (r.i << 16) + len(r.level)] = np.frombuffer(bytes(r.level), np.uint8)
    return out


def _rareness(level: np.ndarray, h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """1 less the mean level of each set's shingles in the sketch."""
    known = level[(h >> np.uint64(64 - (len(level).bit_length() - 1))).astype(np.int64)]
    sums = np.zeros(len(known) + 1, np.int64)
    np.cumsum(known, out=sums[1:])
    return 1 - (sums[offs[1:]] - sums[offs[:-1]]) / (256 * np.maximum(np.diff(offs), 1))


def _sets(docs: DataFrame, sketch=None) -> DataFrame:
    """node, n, sigs and set (its sorted hashes as bytes), once for each node in a task; rare is its rareness by the sketch, if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                h, offs = shingle_sets(*buffers(part.column(0)))
                node = _node(h, offs)
                keep = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if offs[i + 1] > offs[i] and x not in seen:
                        seen.add(x)
                        keep[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                size = np.diff(offs)
                at = np.zeros(keep.sum() + 1, np.int64)
                np.cumsum(8 * size[keep], out=at[1:])
                yield pa.RecordBatch.from_arrays([_signed(node[keep]), pa.array(size[keep]), pa.array(np.stack([x[keep].view(np.int64) for x in _signatures(h, offs)], 1).tolist(), pa.list_(pa.int64())), binary_array(h[np.repeat(keep, size)].view(np.uint8), at), pa.array(_rareness(sketch.value, h, offs)[keep] if sketch is not None else np.zeros(keep.sum()))], names=["node", "n", "sigs", "set", "rare"])

    return docs.select("text").mapInArrow(run, "node long, n long, sigs array<long>, set binary, rare double")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(o, n, m):
    return (NUMERATOR + DENOMINATOR) * o >= NUMERATOR * (n + m)


def _attach(docs: DataFrame, info: DataFrame, sketch) -> DataFrame:
    """node and leader: links that nodes of large families have with leaders of their family.

    A family (the nodes of one min-hash) is dealt into runs of about RUN nodes with leaders of their own;
    the leaders of a family's runs then form a family in the same way, until each has one run.
    """
    distinct = info.where("n > 0").select("node", *(f"sig{i}" for i in range(MIN_HASHES))).distinct()
    sigs = distinct.select("node", F.explode(F.array(*(F.col(f"sig{i}") for i in range(MIN_HASHES)))).alias("sig"))
    count_runs = lambda members: members.groupBy("sig").count().select("sig", "count", F.expr(f"cast(ceil(count / {RUN}.0) as int)").alias("runs"))
    hot = saved(count_runs(sigs).where(F.col("count") >= FAMILY), "families")
    links = None
    if not hot.take(1):
        dropped(hot)
        return docs.sparkSession.createDataFrame([], "node long, leader long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links to a leader; and the leaders of families of several runs, with their sets."""
        group, leaders, last = None, [], None
        for batch in batches:
            links: list[tuple[int, int]] = []
            tops: list[tuple[int, int, bytes, float]] = []
            for sig, salt, runs, node, raw, rare in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (sig, salt) != group:
                    group, leaders, last = (sig, salt), [], None
                if node == last:
                    continue
                last, own = node, np.frombuffer(raw, np.uint64)
                for leader, other in leaders:
                    if similar(overlap(own, other), len(own), len(other)):
                        links.append((node, leader))
                        break
                else:
                    if len(leaders) < LEADERS:
                        leaders.append((node, own))
                        if runs > 1:
                            tops.append((sig, node, raw, rare))
            if links:
                node, leader = (pa.array(c, pa.int64()) for c in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([node, leader, pa.nulls(len(links), pa.int64()), pa.nulls(len(links), pa.binary()), pa.nulls(len(links), pa.float64())], names=["node", "leader", "sig", "set", "rare"])
            if tops:
                sig, node, raw, rare = zip(*tops, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.nulls(len(tops), pa.int64()), pa.array(sig, pa.int64()), pa.array(raw, pa.binary()), pa.array(rare, pa.float64())], names=["node", "leader", "sig", "set", "rare"])

    members, used = _sets(docs, sketch).select(F.explode("sigs").alias("sig"), "node", "set", "rare"), []
    while True:
        rows = members.join(small(hot), "sig").withColumn("salt", F.expr("pmod(xxhash64(node), runs)"))
        dealt = rows.select("sig", "salt", "runs", "node", "set", "rare").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "rare", "node")
        level = saved(dealt.mapInArrow(run, "node long, leader long, sig long, set binary, rare double"), "leaders")
        found = level.where("leader is not null").select("node", "leader")
        links = found if links is None else links.unionByName(found)
        members = level.where("leader is null").select("sig", "node", "set", "rare")
        used += [hot, level]
        hot = saved(count_runs(members), "families")  # LEADERS of each run: a few hundredths of the level before
        if not hot.take(1):
            break
    out = saved(links.distinct(), "members")
    dropped(*used, hot)
    return out


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Elements of a set of size n to index, so that every partner with enough overlap meets one."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def _named_parts(info: DataFrame, parts: DataFrame) -> DataFrame:
    """text_hash, node and part of the texts whose sets are in a part."""
    return saved(info.where("n > 0").join(small(parts), "node").groupBy("text_hash").agg(F.min(F.struct("node", "part")).alias("named")).select("text_hash", "named.node", "named.part"), "named-parts")


def _entries(docs: DataFrame, named: DataFrame, parts: DataFrame, sketch, buckets: int) -> DataFrame:
    """Index entries in packed blocks: bucket; node, part and size of the sets; hash, set number and position.

    The list of a shingle that the sketch holds for longer than LONG_LIST is dealt out: its entries fall
    into groups by node, and each pair of groups is a list of its own, with a derived hash.  Parts are
    joined to the texts by a hash, and used where they name the node that the text then has; so a text
    passes one worker only.  Too many for a broadcast, they are joined to the sets by node.
    """
    groups = np.ceil(np.exp2((np.arange(256) + 1) / 4) / LONG_LIST).astype(np.int64)  # by level

    def blocks(node: np.ndarray, group: np.ndarray, h: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        level = sketch.value
        bits = np.uint64(64 - (len(level).bit_length() - 1))
        n = np.diff(offs)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, level[(h >> bits).astype(np.int64)], owner))
        position = np.arange(len(h)) - np.repeat(offs[:-1], n)
        take = position < np.repeat(prefix_length(n), n)
        h, owner, position = h[order][take], owner[take], position[take]
        spread = groups[level[(h >> bits).astype(np.int64)]]
        if (spread > 1).any():
            place = np.repeat(np.arange(len(h)), spread)
            other = np.arange(len(place)) - np.repeat(np.cumsum(spread) - spread, spread)
            h, owner, position, spread = h[place], owner[place], position[place], spread[place]
            mine = (mix(node[owner].view(np.uint64)) % spread.astype(np.uint64)).astype(np.int64)
            code = np.minimum(mine, other) * spread + np.maximum(mine, other)
            h = np.where(spread > 1, mix(h + code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((h, bucket))
        h, owner, position, bucket = h[order], owner[order], position[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
            own, short = np.unique(owner[a:b], return_inverse=True)
            blobs = [node[own], group[own], n[own].astype(np.int32), h[a:b], short.astype(np.int32 if len(own) > 65535 else np.uint16), position[a:b].astype(np.int32 if n.max() > 65535 else np.uint16)]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([b - a], pa.int32()), pa.array([b"".join(x.tobytes() for x in blobs)], pa.binary())], names=["bucket", "sets", "entries", "blob"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in slices(batch, "text"):
                h, offs = shingle_sets(*buffers(piece.column(0)))
                node = _node(h, offs)
                keep = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if offs[i + 1] > offs[i] and x not in seen:
                        seen.add(x)
                        keep[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                if keep.any():
                    own = node.view(np.int64)
                    named, part = (piece.column(k).fill_null(0).to_numpy() for k in (1, 2))
                    group = np.where((named == own) & np.asarray(piece.column(1).is_valid()), part, own)
                    size = np.diff(offs)
                    yield from blocks(own[keep], group[keep], h[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]))

    def of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "set", INDEX_BYTES):
                raw, at = buffers(piece.column(2))
                yield from blocks(piece.column(0).to_numpy(), piece.column(1).to_numpy(), np.frombuffer(raw.tobytes(), np.uint64), at // 8)

    schema = "bucket long, sets int, entries int, blob binary"
    if named.limit(textbuf.BROADCAST_ROWS + 1).count() <= textbuf.BROADCAST_ROWS:
        return docs.select("text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(named), "text_hash", "left").select("text", "node", "part").mapInArrow(of_texts, schema)
    indexed = _sets(docs).join(small(parts), "node", "left").withColumn("part", F.coalesce("part", "node"))
    return indexed.select("node", "part", "set").mapInArrow(of_sets, schema)


def _unpack(sets: int, entries: int, blob: bytes) -> tuple[np.ndarray, ...]:
    node, group, n = np.frombuffer(blob, np.int64, sets), np.frombuffer(blob, np.int64, sets, 8 * sets), np.frombuffer(blob, np.int32, sets, 16 * sets)
    at = 20 * sets
    h = np.frombuffer(blob, np.uint64, entries, at)
    at += 8 * entries
    kind = np.int32 if sets > 65535 else np.uint16
    own = np.frombuffer(blob, kind, entries, at).astype(np.int64)
    at += entries * kind().itemsize
    position = np.frombuffer(blob, np.int32 if (len(blob) - at) // max(entries, 1) == 4 else np.uint16, entries, at).astype(np.int64)
    return node[own], group[own], n[own].astype(np.int64), h, position


def list_pairs(node: np.ndarray, group: np.ndarray, n: np.ndarray, h: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry pairs (i, j) of different parts that share a hash and may reach the needed overlap.

    Entries are sorted by hash, part and position.  A block of a list is skipped as a whole when no
    entry of it can fit, or when it is of the same part.
    """

    def fits(i, j):
        return ((NUMERATOR + DENOMINATOR) * np.minimum(n[i] - position[i], n[j] - position[j]) >= NUMERATOR * (n[i] + n[j])) & (group[i] != group[j])

    edges = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1)) != 0)
    size = np.diff(np.append(edges, len(h)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    short = (size > 1) & (size <= 2 * BLOCK)
    for k in range(1, int(size[short].max()) if short.any() else 0):
        span = short & (size > k)
        count = size[span] - k
        i = np.repeat(edges[span] - np.cumsum(count) + count, count) + np.arange(count.sum())
        ok = fits(i, i + k)
        found.append((i[ok], i[ok] + k))
    for a, m in zip(edges[size > 2 * BLOCK].tolist(), size[size > 2 * BLOCK].tolist(), strict=True):
        if group[a] == group[a + m - 1]:
            continue
        starts = np.arange(a, a + m, BLOCK)
        stops = np.minimum(starts + BLOCK, a + m)
        least, most = np.minimum.reduceat(n[: a + m], starts), np.maximum.reduceat(n[: a + m], starts)
        rest = np.maximum.reduceat((n - position)[: a + m], starts)
        for s, block in enumerate(starts.tolist()):
            reach = np.minimum(np.minimum(rest[s], rest[s:]), np.minimum(most[s], most[s:]))
            can = ((NUMERATOR + DENOMINATOR) * reach >= NUMERATOR * (least[s] + least[s:])) & (group[block] != group[stops[s:] - 1])
            i = np.arange(block, stops[s])
            for t in (s + np.flatnonzero(can)).tolist():
                j = np.arange(starts[t], stops[t])
                x, y = np.repeat(i, len(j)), np.tile(j, len(i))
                ok = (x < y) & fits(x, y)
                found.append((x[ok], y[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _candidates(entries: DataFrame, tasks: int) -> DataFrame:
    """a, b (a < b): distinct node pairs that share an indexed shingle and pass the filters."""

    def pairs(blocks: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        node, group, n, h, position = (np.concatenate(c) for c in zip(*(_unpack(*x) for x in blocks), strict=True))
        order = np.argsort(h, kind="stable")
        new = np.diff(h[order], prepend=h[order][:1] ^ np.uint64(1)) != 0
        alone = new & np.append(new[1:], True)  # a shingle that only one entry has
        order = order[~alone]
        node, group, n, h, position = node[order], group[order], n[order], h[order], position[order]
        order = np.lexsort((node, position, group, h))
        node, group, n, h, position = node[order], group[order], n[order], h[order], position[order]
        keep = np.ones(len(h), bool)  # a node may come from several tasks
        keep[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        node, group, n, h, position = node[keep], group[keep], n[keep], h[keep], position[keep]
        i, j = list_pairs(node, group, n, h, position)
        if not len(i):
            return None
        both = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks = None, []
        for batch in batches:
            for b, *block in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket and blocks:
                    if (out := pairs(blocks)) is not None:
                        yield out
                    blocks = []
                bucket = b
                blocks.append(tuple(block))
        if blocks and (out := pairs(blocks)) is not None:
            yield out

    return entries.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b of the node pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, n, m = [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                o.append(overlap(x, y))
                n.append(len(x))
                m.append(len(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (o, n, m))], names=["a", "b", "o", "n_a", "n_b"])

    nodes = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidates")
    sets = _sets(docs).select("node", "set").join(small(nodes), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))  # one exchange serves both joins
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    overlaps = joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, o long, n_a long, n_b long")
    out = saved(overlaps.where(f"{NUMERATOR + DENOMINATOR} * o >= {NUMERATOR} * (n_a + n_b)").select("a", "b"), "links")
    dropped(nodes)
    return out


def _part_links(docs: DataFrame, parts: DataFrame, copies: DataFrame) -> DataFrame:
    """node and links: the documents that a set of a part links with in the part, its own copies left out.

    The sets of a part are dealt into blocks, each with the root; the blocks hold differences to it, and
    each pair of blocks meets in one task.  Only sums leave a task.
    """
    blocks = parts.groupBy("part").count().select("part", F.expr(f"cast(ceil(count / {PART_BLOCK}.0) as int)").alias("blocks"))
    own = parts.join(small(copies), "node").join(small(blocks), "part").withColumn("block", F.expr("array(cast(pmod(xxhash64(node), blocks) as int))"))
    roots = blocks.select("part", F.col("part").alias("node"), F.lit(0).cast("long").alias("n_copies"), "blocks", F.expr("sequence(0, blocks - 1)").alias("block"))
    dealt = saved(own.select("part", "node", "n_copies", "blocks", "block").unionByName(roots), "part-members")
    sets = _sets(docs).join(small(dealt), "node").select("part", "node", "n_copies", "blocks", F.explode("block").alias("block"), "set")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, root, last, rows = None, None, None, []

        def packed() -> pa.RecordBatch:
            part, block, blocks = group
            node, n_copies, lacks, adds = zip(*rows, strict=True)
            arrays = [np.array([len(root), len(node)], np.int64), np.array(node, np.int64), np.array(n_copies, np.int64), np.array([len(x) for x in lacks], np.int64), np.array([len(x) for x in adds], np.int64), np.concatenate(lacks), np.concatenate(adds)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int32()), pa.array([blocks], pa.int32()), pa.array([b"".join(x.tobytes() for x in arrays)], pa.binary())], names=["part", "block", "blocks", "blob"])

        for batch in batches:
            for part, block, blocks, is_member, node, n_copies, raw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (part, block, blocks) != group:
                    if rows:
                        yield packed()
                    group, root, last, rows = (part, block, blocks), None, None, []
                v = np.frombuffer(raw, np.uint64)
                if not is_member:
                    root = v
                elif node != last:  # a set may come from several tasks
                    rows.append((node, n_copies, root[~np.isin(root, v, assume_unique=True)], v[~np.isin(v, root, assume_unique=True)]))
                    last = node
        if rows:
            yield packed()

    def unpacked(blob: bytes) -> tuple:
        v = np.frombuffer(blob, np.int64)
        size, m = int(v[0]), int(v[1])
        node, n_copies, lacks, adds = (v[2 + k * m : 2 + (k + 1) * m] for k in range(4))
        rest, at = v[2 + 4 * m :].view(np.uint64), int(lacks.sum())
        return size, node, n_copies, lacks, adds, rest[:at], rest[at:]

    def shared(both: np.ndarray, a: tuple, b: tuple, k: int) -> None:
        """Add to the matrix `both` the common elements of the k-th lists of all sets of two blocks."""
        x, y = a[k + 2], b[k + 2]
        of_x, of_y = np.repeat(np.arange(len(a[1])), a[k]), np.repeat(np.arange(len(b[1])), b[k])
        order_x, order_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
        x, of_x, y, of_y = x[order_x], of_x[order_x], y[order_y], of_y[order_y]
        low, high = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        count = high - low
        for begin in range(0, len(x), 4096):  # a bounded number of pairs at once
            c = count[begin : begin + 4096]
            i = np.repeat(of_x[begin : begin + 4096], c)
            j = of_y[np.repeat(low[begin : begin + 4096] - np.cumsum(c) + c, c) + np.arange(c.sum())]
            both += np.bincount(i * both.shape[1] + j, minlength=both.size).reshape(both.shape)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for part, i, j, block, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                found = unpacked(blob)
                if i != j and (part, i, j) not in held:
                    held = {(part, i, j): (block, found)}
                    continue
                a = found if i == j else held.pop((part, i, j))[1]
                both = np.zeros((len(a[1]), len(found[1])), np.int64)
                shared(both, a, found, 3)
                shared(both, a, found, 4)
                n, m = a[0] - a[3] + a[4], found[0] - found[3] + found[4]
                linked = similar(a[0] - a[3][:, None] - found[3][None, :] + both, n[:, None], m[None, :])
                if i == j:
                    np.fill_diagonal(linked, False)
                rows = [(a[1], linked @ found[2])] + ([(found[1], linked.T @ a[2])] if i != j else [])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in (0, 1)], names=["node", "links"])

    keyed = sets.select("part", "block", "blocks", (F.col("n_copies") > 0).alias("member"), "node", "n_copies", "set")
    packed = saved(keyed.repartition("part", "block").sortWithinPartitions("part", "block", "blocks", "member", "node").mapInArrow(differences, "part long, block int, blocks int, blob binary"), "part-blocks")
    pairs = packed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blob")
    out = saved(pairs.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "block").mapInArrow(links, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")), "part-links")
    dropped(dealt, packed)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sketch_bits: int = SKETCH_BITS, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), n_copies (rows with an equal set) and n_links (other rows that it links with) of every row.

    links: whether n_links is counted, which compares all sets of a part with one another; components do not need it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = saved(_info(docs, sketch_bits), "sets-info")
    info = found.where("kind = 0").drop("kind", "blob")
    sketch = spark.sparkContext.broadcast(_sketch(found, sketch_bits))
    attached = _attach(docs, info, sketch)
    joined = connected_components(attached, "node", "leader")
    parts = joined.withColumnRenamed("component", "part")
    total = info.agg(F.sum("n")).collect()[0][0] or 0
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (DENOMINATOR - NUMERATOR) / DENOMINATOR / ENTRIES))  # grows with the index
    named = _named_parts(info, parts)
    pairs = saved(_candidates(_entries(docs, named, parts, sketch, BUCKETS * tasks), tasks), "pairs")
    dropped(named)
    edges = _linked(pairs, docs)
    dropped(pairs)
    components = connected_components(edges.unionByName(parts.select(F.col("node").alias("a"), F.col("part").alias("b"))))
    classes_of = saved(info.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "classes")
    counted = _link_counts(docs, parts, edges, classes_of.select("node", "n_copies")) if links else None
    dropped(edges, joined)
    classes = classes_of.join(small(components), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component")
    if links:
        classes = classes.join(small(counted), "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1)
    columns = ["component_id", "n_copies", *(["n_links"] if links else [])]
    out = info.where("n > 0").join(classes.select("node", *columns), "node").select("doc_id", F.col("n").alias("n_shingles"), *columns)
    none = info.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    result = saved(out.unionByName(none.select(out.columns)), "near-duplicates")
    dropped(found, classes_of, components, *([counted] if links else []))
    return result


def _link_counts(docs: DataFrame, parts: DataFrame, edges: DataFrame, copies: DataFrame) -> DataFrame:
    """node and links: the documents that a set links with, its own copies left out."""
    across = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(small(copies.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n_copies").alias("links"))
    inside = _part_links(docs, parts, copies)
    out = saved(across.unionByName(inside).groupBy("node").agg(F.sum("links").alias("links")), "link-counts")
    dropped(inside)
    return out
