"""The pixel relation.

One row per pixel: picture_id, w, h (size of its picture), x, y (from the top left) and the channels c0..c3.
Sizes travel with the pixels, so geometric operators are projections without a join.  `Raster` adds
what holds for all rows: sample type and channel layout.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("picture_id", "w", "h", "x", "y")
LAYOUTS = {"L": 1, "La": 2, "Rgb": 3, "Rgba": 4}


@dataclass(frozen=True)
class Raster:
    pixels: DataFrame
    layout: str = "Rgb"
    kind: str = "u8"
    space: tuple[str, str] = ("srgb", "srgb")  # primaries and transfer function, a label

    @property
    def names(self) -> list[str]:
        return [f"c{i}" for i in range(LAYOUTS[self.layout])]

    @property
    def channels(self) -> list[Column]:
        return [F.col(n) for n in self.names]

    @property
    def colour(self) -> list[Column]:
        """Channels without alpha."""
        return self.channels[: LAYOUTS[self.layout] - self.has_alpha]

    @property
    def has_alpha(self) -> bool:
        return self.layout in ("La", "Rgba")

    def select(self, channels: list[Column] | None = None, layout: str | None = None, kind: str | None = None, **place: Column) -> Raster:
        """A projection: new channels, and new values of key columns by name."""
        layout, kind = layout or self.layout, kind or self.kind
        channels = self.channels if channels is None else channels
        key = [place[k].cast("string" if k == "picture_id" else "int").alias(k) if k in place else F.col(k) for k in KEY]
        pixels = self.pixels.select(*key, *(c.alias(f"c{i}") for i, c in enumerate(channels)))
        return Raster(pixels, layout, kind, self.space)

    def over(self, pixels: DataFrame) -> Raster:
        """The same layout, sample type and colour space over other pixels."""
        return replace(self, pixels=pixels)

    def where(self, condition) -> Raster:
        return self.over(self.pixels.where(condition))


def from_table(df: DataFrame, picture_id, w, h, x, y, channels: list, layout: str, kind: str = "u8") -> Raster:
    """A raster from columns (or literals) of any table."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    sample = "float" if kind == "f32" else "int"
    return Raster(df.select(col(picture_id).cast("string").alias("picture_id"), *(col(v).cast("int").alias(k) for k, v in zip(KEY[1:], (w, h, x, y), strict=True)), *(col(c).cast(sample).alias(f"c{i}") for i, c in enumerate(channels))), layout, kind)


def events_raster(spark: SparkSession, sf_dir: str, width: int = 100) -> Raster:
    """The events table as one Rgb8 picture: event ids in raster order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    height = F.floor(events.agg((F.max("event_id") + 1).alias("n")).scalar() / width)  # a subquery of the same job
    r = F.pmod(F.floor("value"), F.lit(256))
    return from_table(events, "events", width, height, F.col("event_id") % width, F.floor(F.col("event_id") / width), [r, F.col("user_id") % 256, (F.col("event_id") * 13) % 256], "Rgb")


def embeddings_raster(spark: SparkSession, sf_dir: str) -> Raster:
    """Each embedding as an 8 by 8 picture of one float channel."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return from_table(rows, F.col("vec_id"), 8, 8, F.col("pos") % 8, F.floor(F.col("pos") / 8), [F.col("v")], "L", "f32")


def sizes(raster: Raster, w: str = "w", h: str = "h") -> DataFrame:
    """picture_id and size of each picture: its first pixel's row."""
    return raster.pixels.where("x = 0 and y = 0").select("picture_id", F.col("w").alias(w), F.col("h").alias(h))


#: Pixels (about 40 bytes each) up to which `small` broadcasts a relation.
BROADCAST_PIXELS = 400_000


def small(pixels: DataFrame, most: int | None = None) -> DataFrame:
    """pixels with a broadcast hint if they are counted to be at most `most`, else as they are."""
    most = BROADCAST_PIXELS if most is None else most
    return F.broadcast(pixels) if pixels.limit(most + 1).count() <= most else pixels


def with_alpha(raster: Raster) -> Raster:
    """An alpha channel that varies over the picture, for tests of compositing."""
    return raster.select([*raster.colour, ((F.col("x") * 7 + F.col("y") * 3) % 256).cast("int")], layout="La" if len(raster.colour) == 1 else "Rgba")
