"""Quality rules: counts within a document, and the frequency of its lines across the documents of its host.

A line, normalised to its words in lower case (A-Z) with single spaces, is hashed; for each host the
distinct documents that hold it are counted.  Copies of one text count as one document: otherwise every
line of a page that a host repeats would count as boilerplate, and all its copies would be rejected
before a later stage can keep one.  A line held by more than `max_docs` documents is removed, whatever
the size of the host, and a document that loses more than `depleted_percent` % of its words is
rejected, as is one that fails the base rules: fewer than 50 words, or more than half of its words in
repeated three-word windows.

Up to BROADCAST_LINES removable lines of BROADCAST_HOSTS hosts are broadcast; more are joined with the
lines of the documents, so a document meets those that it holds, never the list of its host.

Defined cases: a null or empty text has zero counts and fails the base rules; rows without a host
share one host; repeated rows, and documents with the same text, are judged alike and count as one
document; an empty table gives an empty result.  Result columns replace columns of the input that have
their names; all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelry.llm.textbuf import SpanHasher, buffers, code_points, dropped, free_name, mix, per_text, same_bytes, saved, slices, with_columns, word_spans

MAX_DOCS, DEPLETED_PERCENT = 10, 50
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Hosts with removable lines, and such lines (8 bytes each), up to which they are broadcast.
BROADCAST_HOSTS = 20_000
BROADCAST_LINES = 400_000

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NO_HOST = "\x00"


class Lines:
    """Words and \\n-split lines of a buffer of texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1
        self.starts, self.ends, self.text = word_spans(buf, offs)
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        if len(buf):
            edge[1:] |= buf == 0x0A
        self.begin = np.flatnonzero(edge[:-1]) if len(buf) else np.zeros(0, np.int64)
        stop = np.append(self.begin[1:], len(buf)) if len(self.begin) else self.begin
        self.end = stop - (buf[stop - 1] == 0x0A) if len(buf) else stop
        # words of line i: first[i] up to first[i + 1]
        self.first = np.append(np.searchsorted(self.starts, self.begin), len(self.starts))
        self.words = np.diff(self.first)
        self.owner = np.searchsorted(offs, self.begin, "right") - 1

    def normal_hashes(self) -> np.ndarray:
        """Hash of each line's words in lower case."""
        lower = self.buf + ((self.buf >= 0x41) & (self.buf <= 0x5A)).astype(np.uint8) * np.uint8(32)
        return SpanHasher(SpanHasher(lower)(self.starts, self.ends))(self.first[:-1], self.first[1:])


def base_counts(lines: Lines) -> dict[str, np.ndarray]:
    buf, n = lines.buf, lines.n
    count = np.bincount(lines.text, minlength=n)
    points = code_points(buf)
    hashes = SpanHasher(buf)
    words = hashes(lines.starts, lines.ends)
    symbols = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SYMBOLS[buf], out=symbols[1:])

    # lines equal to an earlier line of their text: found by a hash, then compared byte by byte
    full = np.flatnonzero(lines.words > 0)
    owner, size = lines.owner[full], (lines.end - lines.begin)[full]
    _, first, back = np.unique(mix(hashes(lines.begin, lines.end) ^ mix(lines.owner.astype(np.uint64)))[full], return_index=True, return_inverse=True)
    later = np.flatnonzero(first[back] != np.arange(len(full)))
    equal = (size[later] == size[first[back[later]]]) & (owner[later] == owner[first[back[later]]])
    equal[equal] = same_bytes(buf, lines.begin[full[later[equal]]], buf, lines.begin[full[first[back[later[equal]]]]], size[later[equal]])
    repeated = np.bincount(owner[later], minlength=n)
    for t in np.unique(owner[later[~equal]]).tolist():  # two lines of one hash
        own = [buf[lines.begin[i] : lines.end[i]].tobytes() for i in full[owner == t].tolist()]
        repeated[t] = len(own) - len(set(own))

    # windows of three words that the text holds twice or more
    covered = np.zeros(n, np.int64)
    if len(words) >= WINDOW:
        at = np.flatnonzero(lines.text[WINDOW - 1 :] == lines.text[: len(words) - WINDOW + 1])
        h = mix(lines.text[at].astype(np.uint64))
        for k in range(WINDOW):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        marks = np.zeros(len(words) + WINDOW, np.int64)
        hit = at[order[twice]]
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + WINDOW, -1)
        covered = per_text(np.cumsum(marks)[: len(words)] > 0, lines.text, n)
    return {
        "n_words": count.astype(np.int64),
        "word_chars": per_text(points[lines.ends] - points[lines.starts], lines.text, n),
        "n_symbols": symbols[lines.offs[1:]] - symbols[lines.offs[:-1]],
        "n_dup_lines": repeated.astype(np.int64),
        "n_repeat_words": covered,
    }


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(_NO_HOST))


def held_lines(docs: DataFrame, host: str, text: str) -> DataFrame:
    """host, line, digest: the distinct lines of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = buffers(part.column(1))
                lines = Lines(buf, offs)
                digest = SpanHasher(buf)(offs[:-1], offs[1:])
                full = lines.words > 0
                line, owner = lines.normal_hashes()[full], lines.owner[full]
                order = np.lexsort((line, owner))
                line, owner = line[order], owner[order]
                new = np.ones(len(line), bool)
                new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
                line, owner = line[new], owner[new]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(line.view(np.int64)), pa.array(digest[owner].view(np.int64))], names=["host", "line", "digest"])

    return docs.select(_host(host).alias("host"), F.col(text).cast("string").alias("text")).mapInArrow(run, "host string, line long, digest long")


def line_counts(docs: DataFrame, host: str, text: str) -> DataFrame:
    """host, line, docs: distinct texts of a host that hold a line."""
    return held_lines(docs, host, text).groupBy("host", "line").agg(F.countDistinct("digest").alias("docs"))


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """host and line of the lines to remove."""
    return saved(line_counts(docs, host, text).where(F.col("docs") > max_docs).select("host", "line"), "frequent-lines")


def apply_rules(docs: DataFrame, host: str = "source", text: str = "text", max_docs: int = MAX_DOCS, depleted_percent: float = DEPLETED_PERCENT) -> DataFrame:
    """docs with the base counts, base_failed, n_removed_lines, n_removed_words, clean_text and kept."""
    often = frequent_lines(docs, host, text, max_docs)
    few = often.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES and often.select("host").distinct().limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("n_removed_lines", T.LongType()), T.StructField("n_removed_words", T.LongType()), T.StructField("clean_text", T.StringType()), T.StructField("kept", T.BooleanType())]

    def make():
        def judge(part: pa.RecordBatch) -> list[pa.Array]:
            column = part.column(part.schema.get_field_index(text))
            buf, offs = buffers(column)
            lines = Lines(buf, offs)
            counts = base_counts(lines)
            words = counts["n_words"]
            failed = (words < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
            listed = part.column(part.schema.get_field_index(removable)).to_pylist()  # the host, or the row's own lines
            if shared is not None:
                listed = [x if x in shared.value else None for x in listed]
            gone = np.zeros(len(lines.begin), bool)
            known: dict[str | bytes, list[int]] = {}
            for i, x in enumerate(listed):
                if x is not None:
                    known.setdefault(x, []).append(i)
            if known:
                hashes, full = lines.normal_hashes(), lines.words > 0
                for x, rows in known.items():
                    own = full & np.isin(lines.owner, rows)
                    gone[own] = np.isin(hashes[own], np.frombuffer(x if shared is None else shared.value[x], np.uint64))
            removed_lines, removed_words = np.bincount(lines.owner[gone], minlength=lines.n), per_text(lines.words[gone], lines.owner[gone], lines.n)
            kept = ~failed & (100 * removed_words <= depleted_percent * words)
            clean = column
            if gone.any():
                texts, raw = column.to_pylist(), buf.tobytes()
                for i in np.flatnonzero(removed_lines).tolist():
                    a, b = np.searchsorted(lines.owner, [i, i + 1])
                    left = [raw[lines.begin[k] : lines.end[k]] for k in range(a, b) if not gone[k]]
                    texts[i] = b"\n".join(left + [b""] * (texts[i][-1] == "\n")).decode()
                clean = pa.array(texts, pa.string())
            return [*(pa.array(counts[f.name]) for f in fields[:5]), pa.array(failed), pa.array(removed_lines.astype(np.int64)), pa.array(removed_words), clean.cast(pa.string()), pa.array(kept)]

        return judge

    names = {f.name for f in fields}
    held = docs.select(*(F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in docs.columns if c.lower() not in names or c in (text, host)))
    removable = free_name(held.columns, "removable")
    if few:
        shared = docs.sparkSession.sparkContext.broadcast(_by_host(often))
        listed = held.withColumn(removable, _host(host))
        dropped(often)
    else:
        shared = None
        listed = _with_own_lines(held, often, host, text, removable)
    return with_columns(listed, text, fields, make).drop(removable)


def _by_host(often: DataFrame) -> dict[str, bytes]:
    """The removable lines of each host, sorted 64-bit values."""
    found: dict[str, list[int]] = {}
    for r in often.toLocalIterator():
        found.setdefault(r.host, []).append(r.line)
    return {x: np.sort(np.array(v, np.int64).view(np.uint64)).tobytes() for x, v in found.items()}


def _with_own_lines(docs: DataFrame, often: DataFrame, host: str, text: str, out: str = "removable") -> DataFrame:
    """docs and `out`: those lines of the row's text that its host removes, packed; null without any."""
    of_host, of_text, digest = (free_name([*docs.columns, out], x) for x in ("removable_host", "removable_digest", "text_digest"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(x.as_py(), np.int64).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=[of_host, of_text, out])

    def make():
        def f(part: pa.RecordBatch) -> list[pa.Array]:
            buf, offs = buffers(part.column(part.schema.get_field_index(text)))
            return [pa.array(SpanHasher(buf)(offs[:-1], offs[1:]).view(np.int64))]

        return f

    # copies of a text share its digest and lines
    lines = held_lines(docs, host, text).join(often, ["host", "line"])
    own = lines.groupBy("host", "digest").agg(F.collect_set("line").alias("lines")).mapInArrow(pack, f"{of_host} string, {of_text} long, {out} binary")
    keyed = with_columns(docs, text, [T.StructField(digest, T.LongType())], make)
    same = (_host(host) == F.col(of_host)) & (F.col(digest) == F.col(of_text))
    return keyed.join(own, same, "left").drop(of_host, of_text, digest)
