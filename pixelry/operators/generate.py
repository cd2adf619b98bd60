"""Pictures from formulas and from sample arrays, and back to arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelry.functions import samples as S
from pixelry.plans import tiles
from pixelry.plans.raster import LAYOUTS, Raster, from_table


def from_fn(spark: SparkSession, width: int, height: int, f: Callable[[Column, Column], list], layout: str = "Rgb", kind: str = "u8", picture_id: str = "picture") -> Raster:
    """Pixel = f(x, y), as column expressions over a distributed range."""
    grid = spark.range(width * height)
    x, y = (F.col("id") % max(width, 1)).cast("int"), F.floor(F.col("id") / max(width, 1)).cast("int")
    return from_table(grid, picture_id, width, height, x, y, list(f(x, y)), layout, kind)


def over(sizes: DataFrame, f: Callable[[Column, Column, Column, Column], list], layout: str = "Rgb", kind: str = "u8") -> Raster:
    """Pictures of the sizes of a table (picture_id, w, h), one for each row: pixel = f(x, y, w, h), as column expressions."""
    lines = sizes.where("w > 0 and h > 0").select("picture_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("h").cast("int") - 1)).alias("_y"))
    places = lines.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("w").cast("int") - 1)))
    return from_table(places, F.col("picture_id"), F.col("w"), F.col("h"), F.col("_x"), F.col("_y"), list(f(F.col("_x"), F.col("_y"), F.col("w"), F.col("h"))), layout, kind)


def gradient_over(sizes: DataFrame, start: list, stop: list, vertical: bool, layout: str = "Rgb", kind: str = "u8") -> Raster:
    """A gradient for each row of a table of sizes; a single line has the start colour."""

    def f(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
        at, size = (y, h) if vertical else (x, w)
        t = F.when(size > 1, at.cast("double") / (size - 1)).otherwise(0.0)
        return [S.lerp(F.lit(a), F.lit(b), t, kind) for a, b in zip(start, stop, strict=True)]

    return over(sizes, f, layout, kind)


def from_pixel(spark: SparkSession, width: int, height: int, pixel: list, layout: str = "Rgb", kind: str = "u8") -> Raster:
    return from_fn(spark, width, height, lambda x, y: pixel, layout, kind)


def new(spark: SparkSession, width: int, height: int, layout: str = "Rgb", kind: str = "u8") -> Raster:
    """All samples zero."""
    return from_pixel(spark, width, height, [0] * LAYOUTS[layout], layout, kind)


def _gradient(spark: SparkSession, width: int, height: int, start: list, stop: list, layout: str, kind: str, vertical: bool) -> Raster:
    size = height if vertical else width

    def f(x: Column, y: Column) -> list[Column]:
        at = y if vertical else x
        t = at.cast("double") / (size - 1) if size > 1 else F.lit(0.0)  # a single line has the start colour
        return [S.lerp(F.lit(a), F.lit(b), t, kind) for a, b in zip(start, stop, strict=True)]

    return from_fn(spark, width, height, f, layout, kind)


def vertical_gradient(spark: SparkSession, width: int, height: int, start: list, stop: list, layout: str = "Rgb", kind: str = "u8") -> Raster:
    return _gradient(spark, width, height, start, stop, layout, kind, True)


def horizontal_gradient(spark: SparkSession, width: int, height: int, start: list, stop: list, layout: str = "Rgb", kind: str = "u8") -> Raster:
    return _gradient(spark, width, height, start, stop, layout, kind, False)


def from_raw(pictures: DataFrame, samples: str, layout: str, kind: str = "u8") -> Raster:
    """Pictures from arrays of interleaved samples; rows of `pictures` whose array is too short are left out.

    pictures: picture_id, w, h and the array column.
    """
    n = LAYOUTS[layout]
    enough = pictures.where(F.size(samples) >= F.col("w").cast("bigint") * F.col("h") * n)
    pixels = enough.select("picture_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("p"), F.col(samples).alias("s")).where("w > 0 and h > 0")
    return from_table(pixels, F.col("picture_id"), F.col("w"), F.col("h"), F.expr("p % w"), F.expr("p div w"), [F.element_at("s", (F.col("p") * n + i + 1).cast("int")) for i in range(n)], layout, kind)


def into_raw(r: Raster) -> DataFrame:
    """picture_id, w, h and samples: the interleaved samples of each picture, row by row."""
    pixel = F.struct("y", "x", F.array(*r.channels).alias("v"))
    return r.pixels.groupBy("picture_id", "w", "h").agg(F.flatten(F.transform(F.array_sort(F.collect_list(pixel)), lambda p: p["v"])).alias("samples"))


def into_bytes(r: Raster) -> DataFrame:
    """picture_id, w, h and content: the samples of each picture as little-endian bytes of their type, interleaved, row by row."""
    dtype = tiles.DTYPES[r.kind]

    @F.pandas_udf("binary")
    def packed(samples: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v).astype(dtype).tobytes() for v in samples], dtype=object)

    return into_raw(r).select("picture_id", "w", "h", packed("samples").alias("content"))


def rows(r: Raster) -> DataFrame:
    """picture_id, y and samples of each line."""
    pixel = F.struct("x", F.array(*r.channels).alias("v"))
    return r.pixels.groupBy("picture_id", "y").agg(F.flatten(F.transform(F.array_sort(F.collect_list(pixel)), lambda p: p["v"])).alias("samples"))
