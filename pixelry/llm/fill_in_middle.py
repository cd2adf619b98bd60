"""Fill-in-the-middle transformation, with cuts found through a sparse checkpoint index.

A text is counted in units once, in windows; only every EVERY-th unit leaves a checkpoint of its byte and
code-point offsets.  A cut after any number of units is found by binary search among the checkpoints and a
short rescan from there, so the index of a text of any length is a small fraction of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelry.llm.textbuf import buffers, free_name, with_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints, and bytes of a counting window.
EVERY, WINDOW = 256, 1 << 17

LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _unit_starts(buf: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Whether a unit `[A-Za-z]+|[^A-Za-z]` starts at each byte of a window, but for the starts of texts."""
    part = buf[begin:end]
    letter = LETTERS[part]
    before = np.empty(len(part), bool)
    before[1:], before[:1] = letter[:-1], begin > 0 and LETTERS[buf[begin - 1]]
    return ((part & 0xC0) != 0x80) & ~(letter & before)


class Checkpoints:
    """Units of the texts of one buffer, numbered through, and offsets of every EVERY-th of them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, every: int = EVERY, window: int = WINDOW):
        self.buf, self.offs = buf, offs
        edges = np.unique(offs)  # no unit crosses two texts
        seen, points = 0, 0
        at_edge = np.zeros((len(edges), 2), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        for begin in range(0, len(buf), window):
            end = min(len(buf), begin + window)
            starts = _unit_starts(buf, begin, end)
            lo, hi = np.searchsorted(edges, [begin, end])
            inside = edges[lo:hi] - begin
            starts[inside] = True
            chars = (buf[begin:end] & 0xC0) != 0x80
            units_before, chars_before = np.cumsum(starts) - starts, np.cumsum(chars) - chars
            at_edge[lo:hi] = np.stack([seen + units_before[inside], points + chars_before[inside]], 1)
            here = np.flatnonzero(starts & ((seen + units_before) % every == 0))
            found.append((seen + units_before[here], begin + here, points + chars_before[here]))
            seen, points = seen + int(starts.sum()), points + int(chars.sum())
        at_edge[edges == len(buf)] = seen, points
        self.units, self.bytes, self.chars = (np.concatenate(x) for x in zip(*found, strict=True))
        self.first_unit, self.first_char = at_edge[np.searchsorted(edges, offs)].T
        #: Units of each text.
        self.n = np.diff(self.first_unit)

    def find(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset in the buffer, and code points from the text's start, of the places after `units` units of `texts`."""
        to_byte, to_char = self.offs[texts + 1].copy(), self.first_char[texts + 1].copy()
        open_ = np.flatnonzero(units < self.n[texts])
        wanted = self.first_unit[texts[open_]] + units[open_]
        near = np.searchsorted(self.units, wanted, "right") - 1
        own = self.units[near] < self.first_unit[texts[open_]]  # the text has no checkpoint before the cut: its start is one
        from_start = self.first_unit[texts[open_]], self.offs[texts[open_]], self.first_char[texts[open_]]
        unit, at, chars = (np.where(own, a, b[near]) for a, b in zip(from_start, (self.units, self.bytes, self.chars), strict=True))
        left, begins = wanted - unit, self.offs[texts[open_]]
        step = 4 * EVERY
        while len(open_):
            # starts of the next bytes of each open cut; a cut is at the start that follows `left` others
            index = at[:, None] + np.arange(step + 1)
            inside = index[:, :-1] < len(self.buf)
            index = np.minimum(index, len(self.buf) - 1)
            some = self.buf[index]
            before = np.concatenate([np.where(at > 0, self.buf[np.maximum(at - 1, 0)], 0)[:, None], some[:, :-2]], 1)
            some = some[:, :-1]
            point = ((some & 0xC0) != 0x80) & inside
            starts = point & ~(LETTERS[some] & LETTERS[before])
            starts[:, 0] |= at == begins
            count = np.cumsum(starts, 1)
            hit = starts & (count == left[:, None] + 1)
            done, place = hit.any(1), hit.argmax(1)
            points = np.cumsum(point, 1) - point
            rows = np.flatnonzero(done)
            to_byte[open_[rows]] = at[rows] + place[rows]
            to_char[open_[rows]] = chars[rows] + points[rows, place[rows]]
            rest = ~done
            open_, begins, left, chars, at = open_[rest], begins[rest], (left - count[:, -1])[rest], (chars + point.sum(1))[rest], at[rest] + step
        return to_byte, to_char - self.first_char[texts]


def choices(doc_id: Column) -> list[Column]:
    """Four numbers from 0 to 2^32 - 1 that depend on the id alone."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
]


def transform(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output; columns of these names are replaced.

    Cuts and form follow from the id alone; rows of one id and text have one result.  A null text is empty, and
    empty texts and those that hold a marker stay plain.  A row without an id has choices of its own.
    """
    h = [free_name(docs.columns, f"_h{i}") for i in range(4)]
    given = docs.withColumns(dict(zip(h, choices(F.col("doc_id")), strict=True)))

    def make():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            buf, offs = buffers(part.column("text"))
            index = Checkpoints(buf, offs)
            h1, h2, h3, h4 = (np.asarray(part.column(c)) for c in h)
            raw = buf.tobytes()
            marked = np.array([any(m.encode() in raw[a:b] for m in (PREFIX, SUFFIX, MIDDLE)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], bool)
            plain = (offs[1:] == offs[:-1]) | marked | (h3 % 100 >= 100 - plain_percent)
            spm = h4 % 100 < spm_percent
            texts = np.arange(len(index.n))
            one, two = h1 % (index.n + 1), h2 % (index.n + 1)
            cut, cut_char = index.find(texts, np.minimum(one, two))
            stop, stop_char = index.find(texts, np.maximum(one, two))
            out = []
            for t, (a, b, c, d) in enumerate(zip(offs[:-1].tolist(), cut.tolist(), stop.tolist(), offs[1:].tolist(), strict=True)):
                if plain[t]:
                    out.append(raw[a:d])
                elif spm[t]:
                    out.append(b"".join([b"<S>", raw[c:d], b"<P>", raw[a:b], b"<M>", raw[b:c]]))
                else:
                    out.append(b"".join([b"<P>", raw[a:b], b"<S>", raw[c:d], b"<M>", raw[b:c]]))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            return [pa.array(index.n), pa.array(form, pa.string()), pa.array(cut_char, mask=plain), pa.array(stop_char - cut_char, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]

        return run

    return with_columns(given, "text", FIELDS, make).drop(*h)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of: transformed texts hold no marker, so the three in an output are the added ones."""
    parts = F.split(output, "<[PSM]>", -1)
    one, two, middle = (parts[i] for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
