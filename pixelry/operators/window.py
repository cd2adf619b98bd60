"""Neighbourhood operators: convolutions, blurs, sharpening and error diffusion.

Pixels are dealt once by tiles of TILE by TILE places; a pixel near a tile's border goes to its
neighbours too, as far as the passes of the operator reach, so all passes run on arrays inside the tile
and one exchange serves them.  A tile and its border bound a task's memory, whatever the picture's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from math import exp, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelry.functions import samples as S
from pixelry.plans import shared, tiles
from pixelry.plans.raster import KEY, Raster

TILE = 256


class Patch:
    """Samples (line, column, channel) of a tile with its surroundings, and how far these reach on each side; None: the picture ends there."""

    def __init__(self, v: np.ndarray, left: int | None, right: int | None, top: int | None, bottom: int | None):
        self.v, self.reach = v, {"x": [left, right], "y": [top, bottom]}

    def widened(self, axis: str, radius: int) -> np.ndarray:
        """The samples with the picture's edge repeated `radius` times along an axis; surroundings shrink by the radius."""
        pad = [(0, 0)] * 3
        pad[1 if axis == "x" else 0] = tuple(radius if r is None else 0 for r in self.reach[axis])
        self.reach[axis] = [r if r is None else r - radius for r in self.reach[axis]]
        return np.pad(self.v, pad, mode="edge")

    def neighbours(self, axis: str, radius: int) -> list[np.ndarray]:
        """The samples shifted by -radius up to radius along an axis."""
        k, wide = 1 if axis == "x" else 0, self.widened(axis, radius)
        n = wide.shape[k] - 2 * radius
        return [wide[:, i : i + n] if k else wide[i : i + n] for i in range(2 * radius + 1)]

    def inside(self, w: int, h: int) -> np.ndarray:
        """The samples of the tile itself, of w by h places."""
        left, top = self.reach["x"][0] or 0, self.reach["y"][0] or 0
        return self.v[top : top + h, left : left + w]


def _on_tile(v: np.ndarray, x0: int, y0: int, x1: int, y1: int, w: int, h: int, halo: int, f: Callable) -> np.ndarray:
    """f's samples of the places x0..x1, y0..y1, from these with their surroundings."""
    left, top, right, bottom = min(halo, x0), min(halo, y0), min(halo, w - x1), min(halo, h - y1)
    ends = x0 - left == 0, x1 + right == w, y0 - top == 0, y1 + bottom == h
    patch = Patch(v, *(None if end else reach for end, reach in zip(ends, (left, right, top, bottom), strict=True)))
    f(patch, (x0 - left, y0 - top, w, h))
    # where the surroundings end at the picture's edge they are part of the patch, and are cut off here
    cut_x, cut_y = (left if ends[0] else 0), (top if ends[2] else 0)
    return patch.inside(patch.v.shape[1], patch.v.shape[0])[cut_y : cut_y + y1 - y0, cut_x : cut_x + x1 - x0]


def stencil_tiles(t: tiles.Tiles, halo: int, f: Callable[[Patch, tuple[int, int, int, int]], None]) -> tiles.Tiles:
    """stencil on the tile relation, whose tiles get their surroundings from one another; a halo is at most a tile wide."""
    dtype, n, size, real = tiles.DTYPES[t.kind], t.n, t.size, t.kind == "f32"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                w, h = row["w"], row["h"]
                x0, y0, x1, y1 = tiles.edges(w, h, row["tx"], row["ty"], size)
                wide, tall = min(w, x1 + halo) - max(0, x0 - halo), min(h, y1 + halo) - max(0, y0 - halo)
                v = np.frombuffer(row["samples"], dtype).reshape(tall, wide, n).astype(np.float64 if real else np.int64)
                out.append(np.ascontiguousarray(_on_tile(v, x0, y0, x1, y1, w, h, halo, f).astype(dtype)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("picture_id", "w", "h", "tx", "ty")), pa.array(out, pa.binary())], names=["picture_id", "w", "h", "tx", "ty", "samples"])

    return t.over(tiles.with_halo(t, halo, halo, halo, halo).mapInArrow(run, tiles.ROW))


def stencil(r: Raster | tiles.Tiles, halo: int, f: Callable[[Patch, tuple[int, int, int, int]], None]) -> Raster | tiles.Tiles:
    """Apply f to every tile with surroundings of `halo` places; f is given (x, y, w, h): the tile's place and its picture's size.

    What comes as tiles stays tiles, so operators of this module can follow one another, and a resize, without
    going back to pixels.
    """
    if isinstance(r, tiles.Tiles):
        return stencil_tiles(r, halo, f)
    around = lambda at, size: F.sequence(F.greatest(F.lit(0), F.expr(f"({at} - {halo}) div {TILE}")).cast("int"), F.least(F.expr(f"({size} - 1) div {TILE}"), F.expr(f"({at} + {halo}) div {TILE}")).cast("int"))
    dealt = r.pixels.select(*KEY, *r.names, F.explode(around("x", "w")).alias("tx")).withColumn("ty", F.explode(around("y", "h")))
    names, real = list(r.names), r.kind == "f32"
    sample = pa.float32() if real else pa.int32()

    def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        picture, w, h, tx, ty = (k.as_py() for k in key)
        x0, y0 = tx * TILE, ty * TILE
        x1, y1 = min(w, x0 + TILE), min(h, y0 + TILE)
        left, top, right, bottom = min(halo, x0), min(halo, y0), min(halo, w - x1), min(halo, h - y1)
        v = np.zeros((y1 - y0 + top + bottom, x1 - x0 + left + right, len(names)), np.float64 if real else np.int64)
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        v[y - (y0 - top), x - (x0 - left)] = np.stack([rows.column(n).to_numpy() for n in names], 1)
        out = _on_tile(v, x0, y0, x1, y1, w, h, halo, f)
        inner = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
        x, y = x[inner], y[inner]
        got = out[y - y0, x - x0]
        n = len(x)
        return pa.table([pa.array([picture] * n, pa.string()), pa.array(np.full(n, w), pa.int32()), pa.array(np.full(n, h), pa.int32()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), *(pa.array(got[:, i].astype(np.float32 if real else np.int32), sample) for i in range(len(names)))], names=[*KEY, *names])

    schema = "picture_id string, w int, h int, x int, y int, " + ", ".join(f"{n} {'float' if real else 'int'}" for n in names)
    return r.over(dealt.groupBy("picture_id", "w", "h", "tx", "ty").applyInArrow(one, schema))


def filter3x3(r: Raster, kernel: list[float]) -> Raster:
    """3 by 3 convolution over the kernel's sum (1 if that is 0), clamped and truncated; border pixels become zero."""
    total, real, top = sum(kernel) or 1.0, r.kind == "f32", float(S.MAX[r.kind])

    def f(patch: Patch, place: tuple[int, int, int, int]) -> None:
        x, y, w, h = place
        shape = patch.v.shape
        lines, out = [p.copy() for p in patch.neighbours("y", 1)], 0.0
        columns = dict(patch.reach)
        for dy, line in enumerate(lines):
            side = Patch(line, *columns["x"], None, None)
            for dx, v in enumerate(side.neighbours("x", 1)):
                if kernel[3 * dy + dx]:
                    out = out + v * (kernel[3 * dy + dx] / total)
        patch.reach["x"] = side.reach["x"]
        first_x, first_y = x + (columns["x"][0] is not None), y + (patch.reach["y"][0] is not None)
        height, width = shape[0] - sum(v is not None for v in patch.reach["y"]), shape[1] - sum(v is not None for v in columns["x"])
        out = np.zeros((height, width, shape[2])) + out
        out = np.clip(np.round(out, 6), 0.0, top)
        out = out if real else np.floor(out).astype(np.int64)
        ys, xs = np.arange(first_y, first_y + height), np.arange(first_x, first_x + width)
        border = ((ys == 0) | (ys == h - 1))[:, None] | ((xs == 0) | (xs == w - 1))[None, :]
        patch.v = np.where(border[:, :, None], 0, out)

    return stencil(r, 1, f)


def _mean(patch: Patch, axis: str, radius: int, real: bool) -> None:
    wide, n = patch.widened(axis, radius), 2 * radius + 1
    k = 1 if axis == "x" else 0
    sums = np.cumsum(np.insert(wide, 0, 0, axis=k), axis=k)
    total = np.take(sums, range(n, sums.shape[k]), k) - np.take(sums, range(sums.shape[k] - n), k)
    patch.v = (total / n).astype(np.float32).astype(np.float64) if real else (total + n // 2) // n


def box_pass(r: Raster, axis: str, radius: int) -> Raster:
    """Mean of 2 radius + 1 pixels along one axis, edge pixels repeated; integers rounded half up."""
    real = r.kind == "f32"
    return stencil(r, radius, lambda patch, place: _mean(patch, axis, radius, real)) if radius > 0 else r


def box_radii(sigma: float, passes: int = 3) -> list[int]:
    """Radii of box filters that together come near a Gaussian; the formula and its rounding are fixed values."""
    ideal = sqrt(12 * sigma * sigma / passes + 1)
    low = floor(ideal)
    low -= low % 2 == 0
    few = round(0.25 * passes * (low + 3) - 3 * sigma * sigma / (low + 1))
    halves = [max((low if i < few else low + 2) - 1, 0) // 2 for i in range(passes)]
    return [v if v % 2 else v + 1 for v in halves]


def fast_blur(r: Raster, sigma: float) -> Raster:
    """Three box blurs in place of a Gaussian, all in one exchange."""
    radii, real = [radius for radius in box_radii(sigma) if radius > 0], r.kind == "f32"

    def f(patch: Patch, place: tuple[int, int, int, int]) -> None:
        for radius in radii:
            _mean(patch, "x", radius, real)
            _mean(patch, "y", radius, real)

    return stencil(r, sum(radii), f) if radii else r


def gaussian_taps(size: int, sigma: float) -> list[float]:
    middle = size // 2
    raw = [exp(-0.5 * ((i - middle) / sigma) ** 2) for i in range(size)]
    return [v / sum(raw) for v in raw]


def kernel_size(sigma: float) -> int:
    """Odd number of taps for a sigma; 1, the identity, below 0.16986436."""
    return 1 if sigma < 0.16986436 else int(max(6.66666 * sigma - 2.3333333, 3)) | 1


def sigma_of(size: float) -> float:
    return 0.3 * ((size - 1) * 0.5 - 1) + 0.8


def _convolve(patch: Patch, axis: str, taps: list, kind: str) -> None:
    parts = patch.neighbours(axis, len(taps) // 2)
    total = sum(p * t for p, t in zip(parts, taps, strict=True) if t)
    if kind == "u8":
        patch.v = np.minimum(255, (total + (1 << 14)) >> 15)
    else:
        patch.v = np.clip(np.floor(np.round(total, 6) + 0.5), 0, 65535).astype(np.int64) if kind == "u16" else total.astype(np.float32).astype(np.float64)


def _gaussian_passes(kind: str, sigma_x: float, sigma_y: float | None, size_x: int | None, size_y: int | None) -> list[tuple[str, list]]:
    out = []
    for axis, sigma, size in (("x", sigma_x, size_x), ("y", sigma_y or sigma_x, size_y or size_x)):
        size = size or kernel_size(sigma)
        if size > 1:
            taps = gaussian_taps(size, sigma)
            out.append((axis, [int(max(0.0, min(t * (1 << 15), (1 << 15) - 1))) for t in taps] if kind == "u8" else taps))
    return out


def gaussian_blur(r: Raster, sigma_x: float, sigma_y: float | None = None, size_x: int | None = None, size_y: int | None = None) -> Raster:
    """Separable Gaussian with repeated edges; 8-bit samples in 15-bit fixed point."""
    kind, passes = r.kind, _gaussian_passes(r.kind, sigma_x, sigma_y, size_x, size_y)

    def f(patch: Patch, place: tuple[int, int, int, int]) -> None:
        for axis, taps in passes:
            _convolve(patch, axis, taps, kind)

    return stencil(r, max(len(t) // 2 for _, t in passes), f) if passes else r


def blur(r: Raster, radius: float) -> Raster:
    size = 2 * radius + 1
    odd = max(1, int(size) if int(size) % 2 else int(size) + 1)
    return gaussian_blur(r, sigma_of(size), size_x=odd) if odd > 1 else r


def unsharpen(r: Raster, sigma: float, threshold: int) -> Raster:
    """Add the difference from the blurred picture where it exceeds the threshold (integer samples; alpha too)."""
    kind, passes, top = r.kind, _gaussian_passes(r.kind, sigma, None, None, None), int(S.MAX[r.kind])

    def f(patch: Patch, place: tuple[int, int, int, int]) -> None:
        sharp = Patch(patch.v, *patch.reach["x"], *patch.reach["y"])
        for axis, taps in passes:
            _convolve(patch, axis, taps, kind)
            sharp.v = sharp.neighbours(axis, len(taps) // 2)[len(taps) // 2]
        d = sharp.v - patch.v
        patch.v = np.where(np.abs(d) > threshold, np.clip(sharp.v + d, 0, top), sharp.v)

    return stencil(r, max(len(t) // 2 for _, t in passes), f) if passes else r


#: Places of a block of error diffusion along each axis.
DITHER_BLOCK = 512


def _diffused(v: np.ndarray, left: np.ndarray, above: np.ndarray, w: int, y0: int, u0: int) -> tuple[np.ndarray, np.ndarray]:
    """Results and errors of a block of lines y0.. and skewed columns u0.. (u = x + y).

    left: errors of the two columns before the block, from the line before it on; above: those of the line
    before, from the block's first column on.  Errors are zero where there is no pixel.
    """
    h, n = v.shape
    error = np.zeros((h + 1, n + 2), np.int64)
    error[:, :2], error[0, 2:] = left, above
    out = np.zeros((h, n), np.int64)
    lines = np.arange(h)
    for d in range(n + h - 1):  # pixels of one u + y depend on earlier ones alone
        y = lines[max(0, d - n + 1) : min(h, d + 1)]
        u = d - y
        x = u0 + u - (y0 + y)
        inside = (x >= 0) & (x < w)
        y, u = y[inside], u[inside]
        if not len(y):
            continue
        now = v[y, u].astype(np.int64)
        # a pixel's sources in raster order: before it in the line above, above, after it above, and before it
        for du, dy, part in ((2, 1, 1), (1, 1, 5), (0, 1, 3), (1, 0, 7)):
            now = np.clip(now + np.trunc(error[y + 1 - dy, u + 2 - du] * part / 16).astype(np.int64), 0, 255)
        out[y, u] = np.where(now > 127, 255, 0)
        error[y + 1, u + 2] = now - out[y, u]
    return out, error


def dither_bilevel(r: Raster, block: int = DITHER_BLOCK) -> Raster:
    """Floyd-Steinberg diffusion of grey pictures to 0 and 255.

    The error of each pixel moves to its right and to the next line.  In columns skewed by the line, u = x + y,
    a block of pixels depends on the blocks to its left and above alone: blocks go in rounds, all of one
    diagonal of all pictures at once, and hand their border's errors on in the shared folder.  So a task
    holds one block, whatever the size of a picture; a picture of one block needs one round.
    """
    spark = r.pixels.sparkSession
    skewed = r.select([r.channels[0]], layout="L", x=F.col("x") + F.col("y"), w=F.col("w") + F.col("h"))
    path = shared.path(spark, "dither")
    blocks = tiles.from_raster(skewed, block)
    blocks.rows.withColumn("round", F.col("tx") + F.col("ty")).write.partitionBy("round").parquet(f"{path}/blocks")
    given = spark.read.schema(f"{tiles.ROW}, round int").parquet(f"{path}/blocks")
    rounds = given.agg(F.max("round")).collect()[0][0]
    border = "picture_id string, w int, h int, tx int, ty int, side string, samples binary"

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        picture, w, h, tx, ty = (k.as_py() for k in key)
        u0, y0, u1, y1 = tiles.edges(w, h, tx, ty, block)
        own = {row["side"]: np.frombuffer(row["samples"], np.uint8 if row["side"] == "own" else np.int64) for row in rows.to_pylist()}
        if "own" not in own:  # no pixel of the picture is in this block
            return rows.slice(0, 0)
        left, above = np.zeros((y1 - y0 + 1, 2), np.int64), np.zeros(u1 - u0, np.int64)
        if "left" in own:
            left[1:] = own["left"].reshape(-1, 2)
        if "above" in own:
            above[:] = own["above"]
        if "corner" in own:
            left[0] = own["corner"]
        out, error = _diffused(own["own"].reshape(y1 - y0, u1 - u0), left, above, w - h, y0, u0)
        made = [(tx, ty, "done", out.astype(np.uint8)), (tx + 1, ty, "left", error[1:, -2:]), (tx, ty + 1, "above", error[-1, 2:]), (tx + 1, ty + 1, "corner", error[-1, -2:])]
        made = [m for m in made if m[0] * block < w and m[1] * block < h]
        n = len(made)
        return pa.table([pa.array([picture] * n, pa.string()), pa.array([w] * n, pa.int32()), pa.array([h] * n, pa.int32()), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made]), pa.array([np.ascontiguousarray(m[3]).tobytes() for m in made], pa.binary())], names=["picture_id", "w", "h", "tx", "ty", "side", "samples"])

    key, sides = ["picture_id", "w", "h", "tx", "ty"], []
    for k in range(rounds + 1 if rounds is not None else 0):
        now = given.where(F.col("round") == k).select(*key, F.lit("own").alias("side"), "samples")
        for i in sides[-2:]:  # what comes from the left and above is of the last round, a corner of the one before
            now = now.unionByName(spark.read.schema(border).parquet(i).where((F.col("side") != "done") & (F.col("tx") + F.col("ty") == k)))
        sides.append(f"{path}/rounds/round={k}")
        now.groupBy(*key).applyInArrow(run, border).write.parquet(sides[-1])
    rows = spark.read.schema(border).parquet(*sides).where("side = 'done'").drop("side") if sides else given.drop("round")
    done = tiles.to_raster(blocks.over(rows))
    inside = done.where((F.col("x") >= F.col("y")) & (F.col("x") - F.col("y") < F.col("w") - F.col("h")))
    return replace(r, pixels=inside.select(x=F.col("x") - F.col("y"), w=F.col("w") - F.col("h")).pixels, layout="L", kind="u8")
