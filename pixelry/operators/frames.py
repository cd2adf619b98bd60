"""Animations: a relation of frames, delays, and the composition of frames on a canvas.

`frames` has a row for each frame: picture_id, frame_no (from 0), w, h (the canvas), left, top, width,
height (its region), dispose ("keep", "background" or "previous"), blend ("source" or "over") and delay.
`pixels` has the frames' own pixels: picture_id, frame_no, x, y (within the frame) and c0..c3.

Composition goes over the tiles of a canvas: the frames' pixels are packed by tile and sorted by frame in
one exchange, and a task holds what a tile shows now, so time and memory do not grow with the number of
frames beyond reading them.  Frame numbers of a picture are distinct; of several pixels of one place in a
frame one stays, and pixels outside of their frame or the canvas are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelry.plans import tiles

_U32 = (1 << 32) - 1
_NAMES = ("c0", "c1", "c2", "c3")


def delay(numerator: Column, denominator: Column) -> Column:
    """A delay as a ratio of milliseconds, kept as it is given."""
    return F.struct(numerator.cast("long").alias("numer"), denominator.cast("long").alias("denom"))


def milliseconds(d: Column) -> Column:
    return d["numer"] / F.nullif(d["denom"], F.lit(0))


def hundredths(d: Column) -> Column:
    """Whole hundredths of a second, at most 65535."""
    return F.least(F.lit(65535), F.expr("1") * F.floor(F.floor(d["numer"] / d["denom"]) / 10)).cast("int")


def apng_delay(numerator: Column, denominator: Column) -> Column:
    """The delay of a frame that is given in parts of a second; a denominator of 0 stands for 100."""
    return delay(numerator.cast("long") * 1000, F.when(denominator == 0, 100).otherwise(denominator))


def saturating_delay(nanoseconds: Column) -> Column:
    """The delay nearest to a duration with numerator and denominator of 32 bits; longer ones are cut.  Null and negative ones give null."""

    @F.pandas_udf("numer long, denom long")
    def nearest(values: pd.Series) -> pd.DataFrame:
        rows = []
        for n in values:
            millis = min(int(n) // 1_000_000, _U32)
            part = Fraction(int(n) % 1_000_000, 1_000_000).limit_denominator((_U32 + 1) // (millis + 1) if millis else _U32)
            rows.append((part.numerator + part.denominator * millis, part.denominator))
        return pd.DataFrame(rows, columns=["numer", "denom"])

    whole = nanoseconds.cast("long")
    return F.when(whole >= 0, nearest(F.greatest(F.coalesce(whole, F.lit(0)), F.lit(0))))


@dataclass
class Canvas:
    """What a tile of a canvas shows, and what the next frame may have to go back to."""

    now: np.ndarray
    before: np.ndarray
    region: np.ndarray
    dispose: str | None = "background"


def _blend(under: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Source-over compositing of Rgba samples of 8 bits."""
    ua, oa = under[..., 3:] / 255.0, over[..., 3:] / 255.0
    alpha = ua + oa - ua * oa
    mixed = np.divide(over[..., :3] / 255.0 * oa + under[..., :3] / 255.0 * ua * (1 - oa), alpha, out=np.zeros(over[..., :3].shape), where=alpha > 0)
    out = np.concatenate([tiles.rounded(mixed * 255, "u8"), tiles.rounded(alpha * 255, "u8")], -1)
    return np.where(over[..., 3:] == 0, under, np.where(over[..., 3:] == 255, over, out))


def _transparent(c: Canvas, colour: np.ndarray, inside: np.ndarray, dispose: str | None, blend: str | None) -> np.ndarray:
    shown = np.where((inside & (colour[..., 3] > 0))[..., None], colour, c.now)
    if dispose == "background":
        c.now = np.where(inside[..., None], 0, c.now).astype(np.uint8)
    elif dispose != "previous":
        c.now = shown
    return shown


def _blended(c: Canvas, colour: np.ndarray, inside: np.ndarray, dispose: str | None, blend: str | None) -> np.ndarray:
    undone = c.now
    if c.dispose in ("previous", "background"):
        undone = np.where(c.region[..., None], c.before if c.dispose == "previous" else 0, c.now).astype(np.uint8)
    if c.dispose != "previous":
        c.before = c.now
    c.now = np.where(inside[..., None], _blend(undone, colour) if blend == "over" else colour, undone).astype(np.uint8)
    c.region, c.dispose = inside, dispose
    return c.now


def _composed(frames: DataFrame, pixels: DataFrame, step: Callable) -> DataFrame:
    size, key = tiles.TILE, ["picture_id", "w", "h", "tx", "ty"]
    shape = ("left", "top", "width", "height", "dispose", "blend")
    at = pixels.select("picture_id", "frame_no", "x", "y", *_NAMES).join(frames.select("picture_id", "frame_no", "w", "h", "left", "top"), ["picture_id", "frame_no"])
    at = at.withColumns({"x": (F.col("x") + F.col("left")).cast("int"), "y": (F.col("y") + F.col("top")).cast("int"), **{c: F.col(c).cast("int") for c in ("w", "h", "frame_no")}})
    drawn = tiles.pieces(at.where("x between 0 and w - 1 and y between 0 and h - 1"), list(_NAMES), "u1", size, ("frame_no",))
    across = lambda n: F.explode(F.sequence(F.lit(0), F.expr(f"cast(({n} - 1) div {size} as int)")))
    ints = [F.col(c).cast("int").alias(c) for c in ("w", "h", "frame_no", *shape[:4])]
    every = frames.where("w > 0 and h > 0").select("picture_id", *ints, *shape[4:]).withColumn("tx", across("w")).withColumn("ty", across("h"))
    rows = every.select(*key, "frame_no", F.lit(0).alias("kind"), *shape, F.lit(None).cast("binary").alias("place"), F.lit(None).cast("binary").alias("v"))
    nothing = [F.lit(None).cast("string" if c in shape[4:] else "int").alias(c) for c in shape]
    both = rows.unionByName(drawn.select(*key, "frame_no", F.lit(1).alias("kind"), *nothing, "place", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, canvas, frame, colour = None, None, None, None

        def shown() -> pa.RecordBatch:
            x0, y0, x1, y1 = tiles.edges(*now[1:], size)
            x, y = np.arange(x0, x1), np.arange(y0, y1)[:, None]
            inside = (x >= frame["left"]) & (y >= frame["top"]) & (x < frame["left"] + frame["width"]) & (y < frame["top"] + frame["height"])
            out = step(canvas, colour, inside, frame["dispose"], frame["blend"]).reshape(-1, 4).astype(np.int32)
            n = len(out)
            same = lambda v: pa.array(np.full(n, v, np.int32))
            ids = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([now[0]], pa.string())).cast(pa.string())
            places = [np.broadcast_to(c, (y1 - y0, x1 - x0)).reshape(-1).astype(np.int32) for c in (x, y)]
            return pa.RecordBatch.from_arrays([ids, same(frame["frame_no"]), same(now[1]), same(now[2]), *map(pa.array, places), *(pa.array(out[:, i]) for i in range(4))], names=["picture_id", "frame_no", "w", "h", "x", "y", *_NAMES])

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[c] for c in key)
                if frame is not None and (own != now or row["kind"] == 0):
                    yield shown()
                    frame = None
                if own != now:
                    x0, y0, x1, y1 = tiles.edges(*own[1:], size)
                    clear = np.zeros((y1 - y0, x1 - x0, 4), np.uint8)
                    now, canvas = own, Canvas(clear, clear, np.zeros(clear.shape[:2], bool))
                if row["kind"] == 0:
                    frame, colour = row, np.zeros(canvas.now.shape, np.uint8)
                elif frame is not None and frame["frame_no"] == row["frame_no"]:
                    y, x, v = tiles.unpacked(row, "u1", 4, size)
                    colour[y, x] = v
        if frame is not None:
            yield shown()

    dealt = both.repartition(*key).sortWithinPartitions(*key, "frame_no", "kind")
    return dealt.mapInArrow(run, "picture_id string, frame_no int, w int, h int, x int, y int, " + ", ".join(f"{c} int" for c in _NAMES))


def compose_transparent(frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """Canvas pixels of each frame where transparent pixels show the picture below (the rule of GIF).

    After a frame its region keeps what is shown, is cleared ("background"), or goes back to what was there
    ("previous"); outside of its region a frame changes nothing.
    """
    return _composed(frames, pixels, _transparent)


def compose_blended(frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """Canvas pixels of each frame where a frame replaces what is there or is blended over it (the rule of APNG).

    Before a frame, the region of the one before is left, cleared, or set back to what was there before it.
    """
    return _composed(frames, pixels, _blended)


def within_budget(frames: DataFrame, max_alloc: int, bytes_per_pixel: int = 4, held: int = 2, free: bool = False) -> DataFrame:
    """frames with reserved (bytes taken up to and with a frame), fits, and error for the first frame that does not fit.

    A reader takes `held` canvases of a picture first, then each frame's own region; free: a frame's region
    is given back before the next one.  From the first frame on that exceeds the budget no frame of the
    picture fits; null sizes do not fit.
    """
    in_order = Window.partitionBy("picture_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    area = lambda w, h: F.col(w).cast("decimal(20,0)") * F.col(h).cast("decimal(10,0)") * bytes_per_pixel
    own = area("width", "height")
    taken = area("w", "h") * held + (own if free else F.sum(own).over(in_order))
    rows = frames.withColumn("reserved", taken.cast("decimal(38,0)"))
    rows = rows.withColumn("_over", F.sum(F.when(F.coalesce(F.col("reserved") <= max_alloc, F.lit(False)), 0).otherwise(1)).over(in_order))
    late = F.col("_over") > 0
    first = late & (F.coalesce(F.lag("_over").over(Window.partitionBy("picture_id").orderBy("frame_no")), F.lit(0)) == 0)
    return rows.withColumn("fits", ~late).withColumn("error", F.when(first, F.lit("limits"))).drop("_over")


def collect(frames: DataFrame) -> DataFrame:
    """picture_id and its frames in order, as an array of rows."""
    rest = [c for c in frames.columns if c not in ("picture_id", "frame_no")]
    return frames.groupBy("picture_id").agg(F.array_sort(F.collect_list(F.struct("frame_no", *rest))).alias("frames"))


def skip(frames: DataFrame, n: int) -> DataFrame:
    """Frames without the first n of each picture."""
    return frames.where(F.col("frame_no") >= n)
