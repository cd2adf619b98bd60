"""Operators on two pictures: equi-joins on picture and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelry.functions import samples as S
from pixelry.operators import point
from pixelry.plans.raster import KEY, Raster, sizes, small


def _paired(bottom: Raster, top: Raster, x: Column, y: Column, same_picture: bool = True, counted: bool = True) -> Raster:
    """bottom left-joined with top's channels t0.. and `hit` at places x, y of the top relation.

    counted: top may be much smaller than bottom, so its pixels are counted first, and broadcast if they are few.
    """
    moved = top.pixels.select("picture_id", x.cast("int").alias("x"), y.cast("int").alias("y"), *(c.alias(f"t{i}") for i, c in enumerate(top.channels)), F.lit(True).alias("hit"))
    on = ["picture_id", "x", "y"] if same_picture else ["x", "y"]
    if not same_picture:
        moved = moved.drop("picture_id")
    return bottom.over(bottom.pixels.join(small(moved) if counted else moved, on, "left"))


def _top(bottom: Raster) -> list[Column]:
    return [F.col(f"t{i}") for i in range(len(bottom.channels))]


def _chosen(joined: Raster, values: list[Column]) -> Raster:
    return joined.select([F.when(F.col("hit"), v).otherwise(c) for v, c in zip(values, joined.channels, strict=True)])


def overlay(bottom: Raster, top: Raster, x: int = 0, y: int = 0, same_picture: bool = True) -> Raster:
    """top blended over bottom at an offset, clipped.  same_picture: pair pictures by id, else top (one picture) goes on all."""
    joined = _paired(bottom, top, F.col("x") + x, F.col("y") + y, same_picture)
    return _chosen(joined, S.blend(joined.channels, _top(bottom), bottom.kind))


def replace(bottom: Raster, top: Raster, x: int = 0, y: int = 0, same_picture: bool = True) -> Raster:
    """top's pixels instead of bottom's at an offset, clipped."""
    return _chosen(_paired(bottom, top, F.col("x") + x, F.col("y") + y, same_picture), _top(bottom))


def tile(bottom: Raster, top: Raster, tile_w: int, tile_h: int) -> Raster:
    """Repetitions of one small picture blended over bottom; the tile is broadcast if it is counted to be small."""
    if tile_w < 1 or tile_h < 1:
        raise ValueError("empty tile")
    held = top.pixels.select(F.col("x").alias("tx"), F.col("y").alias("ty"), *(c.alias(f"t{i}") for i, c in enumerate(top.channels)), F.lit(True).alias("hit"))
    on = (F.col("x") % tile_w == F.col("tx")) & (F.col("y") % tile_h == F.col("ty"))
    joined = bottom.over(bottom.pixels.join(small(held), on, "left"))
    return _chosen(joined, S.blend(joined.channels, _top(bottom), bottom.kind))


def overlay_bounds(bottom: tuple[Column, Column], top: tuple[Column, Column], x: int, y: int) -> tuple[Column, Column]:
    """Size of the part of top that lies on bottom at an offset."""
    return tuple(F.greatest(F.lit(0), F.least(t, b - o)) for b, t, o in zip(bottom, top, (x, y), strict=True))


def copy_from(target: Raster, source: Raster, x: int, y: int) -> Raster:
    """replace, where a source that does not fit is an error."""
    fits = (F.col("sw") + x <= F.col("w")) & (F.col("sh") + y <= F.col("h")) & F.lit(x >= 0 and y >= 0)
    checked = target.pixels.join(sizes(source, "sw", "sh"), "picture_id", "left").withColumn("w", F.when(F.col("sw").isNull() | fits, F.col("w")).otherwise(F.raise_error(F.lit("source exceeds the target")).cast("int")))
    return replace(target.over(checked.select(*KEY, *target.names)), source, x, y)


def copy_from_color_space(target: Raster, source: Raster, x: int = 0, y: int = 0) -> Raster:
    """copy_from of a source that is brought into the target's colour space, layout and sample type first."""
    return copy_from(target, point.convert(point.apply_color_space(source, target.space), target.layout, target.kind), x, y)


def copy_within(r: Raster, sx: int, sy: int, width: int, height: int, x: int, y: int) -> Raster:
    """Copy a rectangle to another place of the same picture; overlaps read the old pixels."""
    part = r.where((F.col("x") >= sx) & (F.col("x") < sx + width) & (F.col("y") >= sy) & (F.col("y") < sy + height))
    return _chosen(_paired(r, part, F.col("x") + (x - sx), F.col("y") + (y - sy)), _top(r))


def try_copy_within(r: Raster, sx: int, sy: int, width: int, height: int, x: int, y: int) -> tuple[Raster, DataFrame]:
    """copy_within where both rectangles lie inside, other pictures as they are; and picture_id and error of the latter."""
    inside = lambda a, b: (F.lit(a).cast("bigint") + width <= F.col("w")) & (F.lit(b).cast("bigint") + height <= F.col("h")) & F.lit(min(a, b, width, height) >= 0)
    fits = inside(sx, sy) & inside(x, y)
    done = copy_within(r.where(fits), sx, sy, width, height, x, y)
    failed = sizes(r.where(~fits)).select("picture_id", F.lit("rectangle exceeds the picture").alias("error"))
    return done.over(done.pixels.unionByName(r.where(~fits).pixels.select(done.pixels.columns))), failed


def set_alpha_channel(r: Raster, mask: Raster) -> Raster:
    """Alpha := the mask's grey value; pixels the mask lacks keep theirs."""
    if not r.has_alpha:
        raise ValueError("no alpha channel")
    joined = _paired(r, mask, F.col("x"), F.col("y"), counted=False)
    return joined.select([*joined.colour, F.coalesce(S.convert(F.col("t0"), mask.kind, r.kind), joined.channels[-1])])


def combine(a: Raster, b: Raster, f) -> Raster:
    """f(sample of a, sample of b) for each channel where both have a pixel."""
    joined = _paired(a, b, F.col("x"), F.col("y"), counted=False).where("hit")
    return joined.select([f(c, t) for c, t in zip(joined.channels, _top(a), strict=True)])


def beside(left: Raster, right: Raster) -> Raster:
    """Two pictures of one id side by side; free places are not filled."""
    both = sizes(left, "lw", "lh").join(sizes(right, "rw", "rh"), "picture_id")
    total, tall = F.col("lw") + F.col("rw"), F.greatest("lh", "rh")
    l, r = (p.over(p.pixels.join(both, "picture_id")) for p in (left, right))  # noqa: E741
    return left.over(l.select(w=total, h=tall).pixels.unionByName(r.select(w=total, h=tall, x=F.col("x") + F.col("lw")).pixels))
