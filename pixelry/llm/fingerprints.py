"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into longer phrases, and so on.  At each level runs of
one symbol are joined, then deterministic coin tossing names every symbol by the lowest bit in which
it differs from its left neighbour, four times over, which leaves at most six labels; phrases begin at
local minima of the labels.  A boundary thus depends on a few neighbours only, so equal substrings get
equal phrases inside, wherever they stand.  A phrase's name is the hash of what it holds.  The
fingerprint is the WIDTH least of the hashed names of levels FIRST_LEVEL and up, the k-th occurrence of
a name counting as a name of its own, and the likeness of two fingerprints estimates the Jaccard
similarity of their bags of names.

Defined cases: a null text counts as empty; the empty text has the empty fingerprint; two empty
fingerprints have likeness 1, an empty and another one 0; texts too short for higher levels use the
highest level they have; in a table's order rows without an id come last and equal ids go by a hash of
their text, over several ranges if they are many; the only row of a table is its own next document.  Result columns replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelry.llm.textbuf import SpanHasher, buffers, mix, slices, with_columns
from pixelry.llm.token_shards import range_bounds, range_of

#: Names kept in a fingerprint; hexadecimal digits of each.
WIDTH, DIGITS = 64, 8
#: Levels used: phrases of level 2 hold about 12 bytes, of level 3 about 40.
FIRST_LEVEL, LAST_LEVEL = 2, 4
ROUNDS = 4
#: Bytes of the texts that are parsed at once; a longer text is parsed by itself.
BLOCK_BYTES = 1 << 17
_NULL_ID = -(1 << 63)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 that differ between neighbours; first: where sequences begin."""
    one = x.dtype.type(1)
    for _ in range(ROUNDS):
        low = x.copy()
        low[1:] ^= x[:-1]
        low[first] = 1  # compare bit 0 alone
        low &= ~low + one
        at = np.bitwise_count(low - one)
        bit = (x & low) != 0
        x = (at << 1) + bit
        one = x.dtype.type(1)
    return x


class PhraseCache:
    """Hashes of phrases of bytes met before, each in the place that its key has in a table of fixed size.

    Texts repeat few short phrases, so most hashes are found.  A key is a phrase's bytes, up to seven, and their number, so
    a hash found is the one that SpanHasher gives; a phrase that is not held, or longer, is hashed by it.
    """

    BITS = 16

    def __init__(self):
        self.keys, self.hashes = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.uint64)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Hashes of the phrases; starts: of the runs in buf, begin: of the phrases among the runs."""
        at = starts[begin]
        size = np.diff(at, append=len(buf))
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(buf), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        kept = np.minimum(size, 8)
        key = (eight[at] & _MASKS[kept]) | (kept.astype(np.uint64) << np.uint64(56))
        slot = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)
        slot = slot.astype(np.int64)
        out = self.hashes[slot]
        new = np.flatnonzero((self.keys[slot] != key) | (size > 7))
        if len(new):
            lens = np.diff(begin, append=len(starts))[new]
            ends = np.cumsum(lens)
            item = np.repeat(begin[new] - (ends - lens), lens) + np.arange(ends[-1])
            run = np.diff(starts, append=len(buf))[item]
            out[new] = SpanHasher(buf[starts[item]] + (run.astype(np.uint64) << np.uint64(8)))(ends - lens, ends)
            short = new[size[new] < 8]
            self.keys[slot[short]], self.hashes[slot[short]] = key[short], out[short]
        return out


_MASKS = np.array([(1 << 8 * min(n, 7)) - 1 for n in range(9)], np.uint64)
_known = PhraseCache()


def parse(x: np.ndarray, offs: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and offsets of the phrases of the sequences in x (bytes at level 1, else names) that offs bounds."""
    some = offs[:-1][offs[1:] > offs[:-1]]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[some] = True
    starts = np.flatnonzero(new)
    symbol = x[new]
    first = np.searchsorted(starts, some)
    if level > 1 and len(symbol) < len(x):
        run = np.diff(starts, append=len(x))
        long = np.flatnonzero(run > 1)
        symbol[long] = mix(symbol[long] + run[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    label = _labels(symbol, first)
    least = np.zeros(len(label), bool)
    less = label[1:] < label[:-1]
    least[1:-1] = less[:-1] & (label[1:-1] < label[2:])
    least[np.append(first[1:], len(label)) - 1] = False
    least[first] = True
    begin = np.flatnonzero(least)
    names = _known(x, starts, begin) if level == 1 else SpanHasher(symbol)(begin, np.append(begin[1:], len(symbol)))
    return names, np.searchsorted(starts[begin], offs)


def _grouped(names: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names sorted within their texts, 0 to n - 1."""
    bits = np.uint64(max(n - 1, 1).bit_length())
    key = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (names >> bits)
    order = np.argsort(key)
    key, got = key[order], names[order]
    if ((key[1:] == key[:-1]) & (got[1:] != got[:-1])).any():  # names that differ in their last bits only
        order = np.lexsort((names, owner))
        got = names[order]
    return got, owner[order]


def phrase_names(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and text numbers of all phrases that count for the fingerprints."""
    n = len(offs) - 1
    x, kept, whose = buf, [], []
    have = np.zeros(n, bool)
    below: tuple[np.ndarray, np.ndarray] | None = None
    for level in range(1, LAST_LEVEL + 1):
        if not len(x):
            break
        x, offs = parse(x, offs, level)
        if level < FIRST_LEVEL:
            below = x, offs
            continue
        if not kept:
            have = np.diff(offs) >= 4
        kept.append(mix(x + np.uint64(level)))
        whose.append(np.repeat(np.arange(n), np.diff(offs)))
    if below is not None and not have.all():  # short texts: the phrases of the level before count too
        count = np.diff(below[1])
        few = np.repeat(~have, count)
        kept.append(mix(below[0][few] + np.uint64(FIRST_LEVEL - 1)))
        whose.append(np.repeat(np.flatnonzero(~have), count[~have]))
    if not kept:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    names, owner = _grouped(np.concatenate(kept), np.concatenate(whose), n)
    again = np.flatnonzero((names[1:] == names[:-1]) & (owner[1:] == owner[:-1])) + 1
    if len(again):
        leads = np.append(True, np.diff(again) > 1)
        k = np.arange(len(again)) - np.flatnonzero(leads)[np.cumsum(leads) - 1] + 1
        names[again] = mix(names[again] + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return names, owner


def _prints(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    names, owner = phrase_names(buf, offs)
    value = names >> np.uint64(64 - 4 * DIGITS)
    both = np.sort((owner.astype(np.uint64) << np.uint64(4 * DIGITS)) | value)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    owner = (both >> np.uint64(4 * DIGITS)).astype(np.int64)
    count = np.bincount(owner, minlength=len(offs) - 1)
    first = np.cumsum(count) - count
    rank = np.arange(len(both)) - np.repeat(first, count)
    both = both[rank < WIDTH].astype(">u4")
    text = both.tobytes().hex()
    ends = np.cumsum(np.minimum(count, WIDTH)) * DIGITS
    return [text[b - DIGITS * min(c, WIDTH) : b] for b, c in zip(ends.tolist(), count.tolist(), strict=True)]


def fingerprints(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    """Fingerprints of all texts, taken in blocks whose arrays stay in a core's cache."""
    out: list[str] = []
    at, n = 0, len(offs) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK_BYTES, "right")) - 1)
        out += _prints(buf[offs[at] : offs[stop]], offs[at : stop + 1] - offs[at])
        at = stop
    return out


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity: of the WIDTH least names of both, those that both have."""
    x, y = ({v[i : i + DIGITS] for i in range(0, len(v), DIGITS)} for v in (a, b))
    if not x and not y:
        return 1.0
    union = sorted(x | y)[:WIDTH]
    return sum(1 for v in union if v in x and v in y) / len(union)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df and the column `out`."""

    def make():
        return lambda part: [pa.array(fingerprints(*buffers(part.column(part.schema.get_field_index(text)))), pa.string())]

    return with_columns(df, text, [T.StructField(out, T.StringType())], make)


def compare(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df and the likeness of two fingerprint columns."""

    def make():
        return lambda part: [pa.array([likeness(x or "", y or "") for x, y in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in (a, b)), strict=True)], pa.float64())]

    return with_columns(df, a, [T.StructField(out, T.DoubleType())], make)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", docs_per_range: int = 2048) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint: each document and the next in descending doc_id (after the last: the first).

    Documents are dealt out by a bounded number of ranges of doc_id; the first document of a range is also
    sent to the range before it, so that no range needs another one's rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(body).alias("h"), body.alias("text"))
    inner = range_bounds(source.select("d"), docs_per_range)
    bounds, ranges = np.array(inner, np.int64), len(inner) + 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = range_of(bounds, batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), batch.column(0), batch.column(1)], names=["range", "d", "h"])

    keys = source.select("d", "h") if len(set(inner)) < len(inner) else source.select("d", F.lit(0).cast("long").alias("h"))  # the hash only where it decides
    exact = len(set(inner)) < len(inner)
    heads = {r.range: (r["head"].d, r["head"].h) for r in keys.mapInArrow(dealt, "range long, d long, h long").groupBy("range").agg(F.max(F.struct("d", "h")).alias("head")).collect()}
    order = sorted(heads, reverse=True)  # ranges in the order of the documents
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}  # the first range's head follows the last range

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "guest", "d", "h", "text", "fingerprint"]
        known = np.array(sorted({d for d, _ in before}), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                place, h, text_of = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2)
                made = [pa.array(range_of(bounds, place, h).astype(np.int64)), pa.array(np.zeros(len(place), bool)), part.column(0), part.column(1), text_of, pa.array(fingerprints(*buffers(text_of)), pa.string())]
                out = pa.RecordBatch.from_arrays(made, names=names)
                yield out
                at = np.minimum(np.searchsorted(known, place), max(len(known) - 1, 0))
                head = [i for i in (np.flatnonzero(known[at] == place) if len(known) else []) if (int(place[i]), int(h[i]) if exact else 0) in before]
                if head:
                    took = out.take(pa.array(head, pa.int64()))
                    to = [before[int(place[i]), int(h[i]) if exact else 0] for i in head]
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.ones(len(head), bool)), *(took.column(i) for i in (2, 3, 4, 5))], names=names)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "fingerprint", "next_text", "next_fingerprint"]
        last = None
        for batch in batches:
            for part in slices(batch, "text"):
                got = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                chain = ([last] if last else []) + got
                pairs = [(a[2] if a[2] != _NULL_ID else None, a[4], a[5], b[4], b[5]) for a, b in zip(chain, chain[1:], strict=False) if a[0] == b[0] and not a[1]]
                last = chain[-1]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs, strict=True), (pa.int64(), *[pa.string()] * 4), strict=True)], names=names)

    tasks = min(ranges, 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = source.mapInArrow(rows, "range long, guest boolean, d long, h long, text string, fingerprint string").repartition(tasks, "range").sortWithinPartitions("range", "guest", F.desc("d"), F.desc("h"), "text")
    return ordered.mapInArrow(paired, "doc_id long, text string, fingerprint string, next_text string, next_fingerprint string")
