"""Thumbnails, separable resizing and point sampling.

Sizes come from the pixels' rows, and targets may be columns, so one plan serves pictures of mixed sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelry.functions import samples as S
from pixelry.operators import geometry, point
from pixelry.plans import tiles
from pixelry.plans.raster import Raster, sizes

FILTERS = ("nearest", "triangle", "catmull_rom", "gaussian", "lanczos3")


Size = int | Column


def _column(v: Size) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def nearest_places(at: Column, size: Column, new_size: Column) -> Column:
    """Output places of an axis that show the pixel at a place: floor((o + 0.5) * size / new_size) is that place.  In whole numbers of 64 bits, so exact at any size; null where no place does."""
    at, size, new_size = (c.cast("bigint") for c in (at, size, new_size))
    first = lambda i: F.call_function("div", i * new_size * 2 + size - 1, size * 2).cast("int")  # noqa: E731  the first place that shows pixel i or a later one
    return F.when((at < size) & (first(at) < first(at + 1)), F.sequence(first(at), first(at + 1) - 1))


def resize_exact(r: Raster, new_w: Size, new_h: Size, filter_name: str = "triangle") -> Raster:
    """Pictures of any sizes to a size (numbers, or columns of w and h): the vertical, then the horizontal pass, in doubles, rounded once.

    A pass that leaves the length of an axis as it is copies it.
    """
    if filter_name == "nearest":
        held = r.pixels.withColumn("_to_w", _column(new_w).cast("int")).withColumn("_to_h", _column(new_h).cast("int"))
        placed = held.withColumn("_x", F.explode(nearest_places(F.col("x"), F.col("w"), F.col("_to_w")))).withColumn("_y", F.explode(nearest_places(F.col("y"), F.col("h"), F.col("_to_h"))))
        return r.over(placed).select(x=F.col("_x"), y=F.col("_y"), w=F.col("_to_w"), h=F.col("_to_h"))
    return tiles.to_raster(tiles.resize(tiles.from_raster(r), new_w, new_h, filter_name))


def resize(r: Raster, new_w: int, new_h: int, filter_name: str = "triangle") -> Raster:
    """Each picture to the largest size within the box that keeps its aspect."""
    return resize_to(r, *geometry.resize_dimensions(F.col("w"), F.col("h"), new_w, new_h), filter_name)


def resize_to_fill(r: Raster, new_w: int, new_h: int, filter_name: str = "triangle") -> Raster:
    """Each picture to the least size that covers the box, then its centre."""
    covered = resize_to(r, *geometry.resize_dimensions(F.col("w"), F.col("h"), new_w, new_h, True), filter_name)
    left, top = (F.floor((F.col(c) - n) / 2).cast("int") for c, n in (("w", new_w), ("h", new_h)))
    inside = (F.col("x") >= left) & (F.col("x") < left + new_w) & (F.col("y") >= top) & (F.col("y") < top + new_h)
    return covered.where(inside).select(x=F.col("x") - left, y=F.col("y") - top, w=F.least(F.col("w"), F.lit(new_w)), h=F.least(F.col("h"), F.lit(new_h)))


def resize_to(r: Raster, new_w: Size, new_h: Size, filter_name: str = "triangle") -> Raster:
    """resize_exact with colours weighted by their alpha."""
    if not r.has_alpha or filter_name == "nearest":
        return resize_exact(r, new_w, new_h, filter_name)
    return point.unpremultiply(resize_exact(point.premultiply(r), new_w, new_h, filter_name))


def has_constant_alpha(r: Raster) -> DataFrame:
    """picture_id and whether all alphas of the picture are equal."""
    alpha = r.channels[-1] if r.has_alpha else F.lit(S.MAX[r.kind])
    return r.pixels.groupBy("picture_id").agg((F.min(alpha) == F.max(alpha)).alias("constant"))


def thumbnail_exact(r: Raster, new_w: Size, new_h: Size) -> Raster:
    """Box means: integers rounded half up.  Where a window holds no whole pixel, its two neighbours are mixed."""
    held = r.over(r.pixels.withColumns({"_n": _column(new_w).cast("bigint"), "_m": _column(new_h).cast("bigint")}))
    grows = (F.col("w") < F.col("_n")) | (F.col("h") < F.col("_m"))
    return r.over(_shrunk(held.where(~grows)).pixels.unionByName(_mixed(held.where(grows)).pixels))


def _shrunk(r: Raster) -> Raster:
    # window o of an axis covers ceil(o * s / n) up to ceil((o + 1) * s / n)
    grouped = r.pixels.groupBy("picture_id", "w", "h", "_n", "_m", F.expr("cast(x * _n div w as int)").alias("x"), F.expr("cast(y * _m div h as int)").alias("y"))
    if r.kind == "f32":
        means = [F.avg(c).cast("float").alias(n) for c, n in zip(r.channels, r.names, strict=True)]
    else:
        n = F.count(F.lit(1))
        means = [F.floor((F.sum(c) + F.floor(n / 2)) / n).cast("int").alias(name) for c, name in zip(r.channels, r.names, strict=True)]
    return r.over(grouped.agg(*means)).select(w=F.col("_n"), h=F.col("_m"))


def _window_shares(at: str, s: str, n: str) -> Column:
    """(o, share) of the windows of one axis that use the pixel: those with whole pixels share alike, others mix the two around their middle."""
    low, high = f"(o * {s} + {n} - 1) div {n}", f"((o + 1) * {s} + {n} - 1) div {n}"
    first = f"least({low}, {s} - 1L)"
    last = f"greatest({first}, least({high}, {s}))"
    middle = f"((o * {s}) % {n} + ((o + 1) * {s}) % {n}) / (2.0D * {n})"
    share = f"case when {first} < {last} then if({at} >= {first} and {at} < {last}, 1.0D / ({last} - {first}), 0.0D) when {at} = {last} - 1 then 1 - {middle} when {at} = {last} then {middle} else 0.0D end"
    near = f"sequence(greatest(0L, ({at} - 1) * {n} div {s} - 1), least({n} - 1, ({at} + 1) * {n} div {s} + 1))"
    return F.expr(f"filter(transform({near}, o -> struct(cast(o as int) as o, {share} as share)), t -> t.share > 0)")


def _mixed(r: Raster) -> Raster:
    """The same where an axis grows: a pixel goes to each window that it is part of."""
    wide = r.pixels.withColumns({f"_{c}": F.col(c).cast("bigint") for c in "whxy"})
    spread = wide.withColumn("to_x", F.explode(_window_shares("_x", "_w", "_n"))).withColumn("to_y", F.explode(_window_shares("_y", "_h", "_m")))
    sums = [F.sum(c * F.col("to_x.share") * F.col("to_y.share")).alias(n) for c, n in zip(r.channels, r.names, strict=True)]
    done = r.over(spread.groupBy("picture_id", "w", "h", "_n", "_m", F.col("to_x.o").alias("x"), F.col("to_y.o").alias("y")).agg(*sums))
    return done.select([S.as_float(c) if r.kind == "f32" else S.round_to(c, r.kind) for c in done.channels], w=F.col("_n"), h=F.col("_m"))


def thumbnail(r: Raster, new_w: int, new_h: int) -> Raster:
    """Each picture's largest thumbnail within the box that keeps its aspect."""
    return thumbnail_exact(r, *geometry.resize_dimensions(F.col("w"), F.col("h"), new_w, new_h))


def interpolate_nearest(points: DataFrame, r: Raster, x: Column, y: Column) -> DataFrame:
    """points (with picture_id; repeated rows stay apart) and the channels of the nearest pixel; null outside 0..w-1, 0..h-1."""
    return tiles.sample(tiles.from_raster(r), points, x, y, False)


def interpolate_bilinear(points: DataFrame, r: Raster, x: Column, y: Column) -> DataFrame:
    """points (with picture_id; repeated rows stay apart) and channels mixed from the four pixels around; null outside."""
    return tiles.sample(tiles.from_raster(r), points, x, y, True)


def _placed(points: DataFrame, r: Raster, u: Column, v: Column) -> tuple[DataFrame, Column, Column]:
    """points and their places among the pixels of their picture, from places in 0..1; null outside."""
    at = points.join(sizes(r, "_w", "_h"), "picture_id", "left")
    inside = (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)
    place = lambda q, n: F.when(inside, F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, q * F.col(n) - 0.5)))
    return at, place(u, "_w"), place(v, "_h")


def sample_bilinear(points: DataFrame, r: Raster, u: Column, v: Column) -> DataFrame:
    """Bilinear at normalised places in 0..1; null outside."""
    return interpolate_bilinear(*(lambda at, x, y: (at, r, x, y))(*_placed(points, r, u, v))).drop("_w", "_h")


def sample_nearest(points: DataFrame, r: Raster, u: Column, v: Column) -> DataFrame:
    """The nearest pixel at normalised places in 0..1; null outside."""
    return interpolate_nearest(*(lambda at, x, y: (at, r, x, y))(*_placed(points, r, u, v))).drop("_w", "_h")
