"""Crops, turns and mirrors: filters and coordinate projections, without shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelry.plans.raster import Raster, sizes


def _cols() -> tuple[Column, Column, Column, Column]:
    return F.col("x"), F.col("y"), F.col("w"), F.col("h")


def crop(r: Raster, x: int, y: int, width: int, height: int) -> Raster:
    """The part of a rectangle that lies within the picture."""
    px, py, w, h = _cols()
    new_w = F.greatest(F.lit(0), F.least(F.lit(width), w - x))
    new_h = F.greatest(F.lit(0), F.least(F.lit(height), h - y))
    return r.where((px >= x) & (px < x + width) & (py >= y) & (py < y + height)).select(x=px - x, y=py - y, w=new_w, h=new_h)


def view(r: Raster, x: int, y: int, width: int, height: int) -> Raster:
    """Like crop, but a rectangle that exceeds a picture is an error."""
    _, _, w, h = _cols()
    fits = (F.lit(x).cast("bigint") + width <= w) & (F.lit(y).cast("bigint") + height <= h) & F.lit(x >= 0 and y >= 0)
    checked = r.over(r.pixels.withColumn("w", F.when(fits, w).otherwise(F.raise_error(F.lit("rectangle exceeds the picture")).cast("int"))))
    return crop(checked, x, y, width, height)


def rect(x: range, y: range) -> tuple[int, int, int, int]:
    """x, y, width and height of a rectangle given by ranges."""
    return x.start, y.start, max(0, x.stop - x.start), max(0, y.stop - y.start)


def try_view(r: Raster, x: int, y: int, width: int, height: int) -> tuple[Raster, DataFrame]:
    """The crop of the pictures that hold the whole rectangle; and picture_id and error of those that do not."""
    _, _, w, h = _cols()
    fits = (F.lit(x).cast("bigint") + width <= w) & (F.lit(y).cast("bigint") + height <= h) & F.lit(x >= 0 and y >= 0)
    failed = sizes(r.where(~fits)).select("picture_id", F.lit("rectangle exceeds the picture").alias("error"))
    return crop(r.where(fits), x, y, width, height), failed


class View:
    """A rectangle of a raster that can be moved; `raster()` is the crop at hand."""

    def __init__(self, r: Raster, x: int, y: int, width: int, height: int):
        self.source, self.bounds = r, (x, y, width, height)

    def change_bounds(self, x: int, y: int, width: int, height: int) -> View:
        return View(self.source, x, y, width, height)

    def raster(self) -> Raster:
        return view(self.source, *self.bounds)


def rotate90(r: Raster) -> Raster:
    """Clockwise."""
    x, y, w, h = _cols()
    return r.select(x=h - 1 - y, y=x, w=h, h=w)


def rotate180(r: Raster) -> Raster:
    x, y, w, h = _cols()
    return r.select(x=w - 1 - x, y=h - 1 - y)


def rotate270(r: Raster) -> Raster:
    x, y, w, h = _cols()
    return r.select(x=y, y=w - 1 - x, w=h, h=w)


def flip_horizontal(r: Raster) -> Raster:
    x, _, w, _ = _cols()
    return r.select(x=w - 1 - x)


def flip_vertical(r: Raster) -> Raster:
    _, y, _, h = _cols()
    return r.select(y=h - 1 - y)


def turned(orientation: Column) -> dict[str, Column]:
    """Place and size of a pixel after its picture is turned by an EXIF orientation."""
    x, y, w, h = _cols()
    o = orientation
    right, bottom = w - 1 - x, h - 1 - y
    across = o.isin(5, 6, 7, 8)
    new_x = F.when(o.isin(2, 3), right).when(o.isin(5, 8), y).when(o.isin(6, 7), bottom).otherwise(x)
    new_y = F.when(o.isin(3, 4), bottom).when(o.isin(5, 6), x).when(o.isin(7, 8), right).otherwise(y)
    return {"x": new_x, "y": new_y, "w": F.when(across, h).otherwise(w), "h": F.when(across, w).otherwise(h)}


def orient(r: Raster, orientation: Column) -> Raster:
    """Apply an EXIF orientation (1 to 8) that may differ between pictures; others leave a picture as it is."""
    return r.select(**turned(orientation))


def get_pixel(r: Raster, x: int, y: int) -> Raster:
    """The pixel at a place, none if it is outside."""
    return r.where((F.col("x") == x) & (F.col("y") == y))


def put_pixel(r: Raster, x: int, y: int, pixel: list) -> Raster:
    here = (F.col("x") == x) & (F.col("y") == y)
    return r.select([F.when(here, F.lit(v)).otherwise(c).cast("float" if r.kind == "f32" else "int") for c, v in zip(r.channels, pixel, strict=True)])


def in_bounds(x: Column, y: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x < F.col("w")) & (y < F.col("h"))


def resize_dimensions(w: Column, h: Column, new_w: int, new_h: int, fill: bool = False) -> tuple[Column, Column]:
    """Size that fits into (or fills) a box with the aspect kept, at least 1."""
    ratios = F.lit(float(new_w)) / w, F.lit(float(new_h)) / h
    ratio = F.greatest(*ratios) if fill else F.least(*ratios)
    return tuple(F.greatest(F.lit(1), F.floor(v * ratio + 0.5)).cast("int") for v in (w, h))
