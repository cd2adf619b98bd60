"""Picture files as they arrive in a folder: decoded as a stream, and counted by windows of their time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelry.plans.raster import Raster
from pixelry.sources import pictures


def decoded(spark: SparkSession, path: str, guess: bool = False, max_alloc: int | None = 512 << 20) -> DataFrame:
    """A stream of pictures, a row with an error for each file that cannot be decoded."""
    return pictures.read(spark, path, guess, max_alloc, stream=True)


def pixels(stream: DataFrame, layout: str, kind: str = "u8") -> Raster:
    """The pixel relation of a stream of pictures: operators that are projections or filters work on it as on a table."""
    return pictures.rasters(stream, layout, kind)


def per_window(spark: SparkSession, path: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Number and bytes of the files of each format by windows of their time; files later than `late` are left out."""
    files = pictures.files(spark, path, stream=True).withWatermark("modificationTime", late)
    return files.groupBy(F.window("modificationTime", window).alias("at"), "format").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
