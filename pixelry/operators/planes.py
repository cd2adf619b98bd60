"""Luma and chroma planes of different resolution, joined to pixels and split from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelry.functions import colour
from pixelry.plans.raster import KEY, Raster

#: Columns and lines of the picture, as powers of two, that share a chroma sample.
SUBSAMPLING = {"4:4:4": (0, 0), "4:2:2": (1, 0), "4:2:0": (1, 1), "4:0:0": None}


def to_rgb(y: Raster, u: Raster | None = None, v: Raster | None = None, subsampling: str = "4:2:0", bias: str = "bt601", full: bool = True) -> Raster:
    """Pictures of 8-bit planes (L rasters that share picture ids) as Rgb; chroma planes of odd pictures have the half rounded up.

    The chroma planes meet at their own resolution first, and each pixel then takes the sample at (x >> sx,
    y >> sy) in an equi-join.  4:0:0 has luma alone.  A pixel whose chroma is missing is an error.
    """
    if SUBSAMPLING[subsampling] is None:
        neutral = F.lit(128)
        return y.select(colour.yuv_to_rgb(y.channels[0], neutral, neutral, bias, full), layout="Rgb")
    sx, sy = SUBSAMPLING[subsampling]
    place = ["picture_id", "_x", "_y"]
    one, two = (p.pixels.select("picture_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("c0").alias(n)) for p, n in ((u, "_u"), (v, "_v")))
    held = y.pixels.select(*KEY, "c0").withColumns({"_x": F.shiftright("x", sx), "_y": F.shiftright("y", sy)})
    joined = y.over(held.join(one.join(two, place), place, "left"))
    chroma = [F.coalesce(c, F.raise_error(F.lit("a chroma plane is too small")).cast("int")) for c in (F.col("_u"), F.col("_v"))]
    return joined.select(colour.yuv_to_rgb(joined.channels[0], *chroma, bias, full), layout="Rgb")


def from_rgb(r: Raster, subsampling: str = "4:2:0", bias: str = "bt601") -> tuple[Raster, Raster | None, Raster | None]:
    """Full-range luma and chroma planes of 8-bit Rgb pictures; a chroma sample is the mean of its pixels, rounded half up."""
    kr, kb = colour.LUMA_BIAS[bias]
    red, green, blue = (c.cast("double") for c in r.colour)
    luma = red * kr + green * (1 - kr - kb) + blue * kb
    whole = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(c, 6) + 0.5))).cast("int")
    y = r.select([whole(luma)], layout="L")
    if SUBSAMPLING[subsampling] is None:
        return y, None, None
    sx, sy = SUBSAMPLING[subsampling]
    small = lambda n, s: F.shiftright(F.col(n) + ((1 << s) - 1), s)
    means = r.pixels.select("picture_id", small("w", sx).alias("w"), small("h", sy).alias("h"), F.shiftright("x", sx).alias("x"), F.shiftright("y", sy).alias("y"), ((blue - luma) / (2 * (1 - kb))).alias("_u"), ((red - luma) / (2 * (1 - kr))).alias("_v"))
    means = means.groupBy(*KEY).agg(F.avg("_u").alias("_u"), F.avg("_v").alias("_v"))
    return y, *(y.over(means.select(*KEY, whole(F.col(c) + 128).alias("c0"))) for c in ("_u", "_v"))
