"""Layouts of sample arrays as a struct column: extents and strides, so a view is another layout of the same array.

A layout says where sample (channel, x, y) lies: channel * channel_stride + x * width_stride + y *
height_stride.  All functions are column expressions; samples are neither moved nor read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelry.plans.raster import LAYOUTS, Raster, from_table

FIELDS = ("channels", "channel_stride", "width", "width_stride", "height", "height_stride")
FORMS = ("unaliased", "pixel_packed", "image_packed", "row_major_packed", "column_major_packed")


def _column(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("bigint")


def layout(channels, channel_stride, width, width_stride, height, height_stride) -> Column:
    """From numbers or columns."""
    return F.struct(*(_column(v).alias(n) for n, v in zip(FIELDS, (channels, channel_stride, width, width_stride, height, height_stride), strict=True)))


def row_major_packed(channels, width, height) -> Column:
    """Pixels beside one another, line by line."""
    return layout(channels, 1, width, channels, height, _column(channels) * _column(width))


def column_major_packed(channels, width, height) -> Column:
    return layout(channels, 1, width, _column(channels) * _column(height), height, channels)


def planar(channels, width, height) -> Column:
    """One channel's samples after the other's."""
    return layout(channels, _column(width) * _column(height), width, 1, height, width)


def one_pixel(channels, width, height) -> Column:
    """A picture of any size in which all places show one pixel."""
    return layout(channels, 1, width, 0, height, 0)


def extents(at: Column) -> Column:
    return F.struct(at["channels"], at["width"], at["height"])


def _long(value: Column) -> Column:
    """A number of places, null if it is beyond 64 bits."""
    return F.when(value <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), value.cast("bigint"))


def _wide(v: Column) -> Column:
    return v.cast("decimal(19,0)")


def in_bounds(at: Column, channel, x, y) -> Column:
    c, x, y = map(_column, (channel, x, y))
    return (c >= 0) & (x >= 0) & (y >= 0) & (c < at["channels"]) & (x < at["width"]) & (y < at["height"])


def index_ignoring_bounds(at: Column, channel, x, y) -> Column:
    """Place of a sample in the array, also of one outside; null beyond 64 bits."""
    return _long(_wide(_column(channel)) * _wide(at["channel_stride"]) + _wide(_column(x)) * _wide(at["width_stride"]) + _wide(_column(y)) * _wide(at["height_stride"]))


def index(at: Column, channel, x, y) -> Column:
    """Place of a sample in the array; null outside."""
    return F.when(in_bounds(at, channel, x, y), index_ignoring_bounds(at, channel, x, y))


def min_length(at: Column) -> Column:
    """Samples that an array of the layout must have; null beyond 64 bits."""
    empty = (at["channels"] == 0) | (at["width"] == 0) | (at["height"] == 0)
    return F.when(empty, F.lit(0).cast("bigint")).otherwise(index_ignoring_bounds(at, at["channels"] - 1, at["width"] - 1, at["height"] - 1) + 1)


def fits(at: Column, length: Column) -> Column:
    return F.coalesce(min_length(at) <= length, F.lit(False))


def _by_stride(at: Column) -> Column:
    """The three (stride, extent), by rising stride, then extent."""
    dim = lambda n: F.struct(_wide(at[f"{'channel' if n == 'channels' else n}_stride"]).alias("stride"), _wide(at[n]).alias("extent"))
    return F.array_sort(F.array(dim("channels"), dim("width"), dim("height")))


def has_aliased_samples(at: Column) -> Column:
    """Whether two samples may share a place: each axis has to step over all of the axis below it."""
    dims = _by_stride(at)
    reach = [dims[i]["stride"] * dims[i]["extent"] for i in range(3)]
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return (reach[0] > most) | (reach[1] > most) | (reach[2] > most) | (reach[0] > dims[1]["stride"]) | (reach[1] > dims[2]["stride"])


def is_normal(at: Column, form: str) -> Column:
    """Whether a layout has one of FORMS; all of them need samples that do not alias."""
    dims = _by_stride(at)
    packed = (dims[0]["stride"] == 1) & (dims[0]["extent"] == dims[1]["stride"]) & (dims[1]["stride"] * dims[1]["extent"] == dims[2]["stride"])
    pixel = at["channel_stride"] == 1
    row = (at["width_stride"] == at["channels"]) & (_wide(at["width"]) * _wide(at["width_stride"]) == at["height_stride"])
    column = (at["height_stride"] == at["channels"]) & (_wide(at["height"]) * _wide(at["height_stride"]) == at["width_stride"])
    needs = {"unaliased": F.lit(True), "pixel_packed": pixel, "image_packed": packed, "row_major_packed": pixel & packed & row, "column_major_packed": pixel & packed & column}
    return ~has_aliased_samples(at) & needs[form]


def shrink_to(at: Column, channels, width, height) -> Column:
    """The first channels, columns and lines, at most as many as there are; strides stay."""
    return layout(F.least(at["channels"], _column(channels)), at["channel_stride"], F.least(at["width"], _column(width)), at["width_stride"], F.least(at["height"], _column(height)), at["height_stride"])


def transposed(at: Column) -> Column:
    """The same samples with lines and columns exchanged."""
    return layout(at["channels"], at["channel_stride"], at["height"], at["height_stride"], at["width"], at["width_stride"])


def one_channel(at: Column, channel) -> tuple[Column, Column]:
    """The layout of a plane of one channel, and the place in the array at which it begins."""
    return layout(1, at["channel_stride"], at["width"], at["width_stride"], at["height"], at["height_stride"]), index(at, channel, 0, 0)


def from_samples(pictures: DataFrame, samples: str, at: Column, kind_of: str, kind: str = "u8", offset: Column | int = 0) -> Raster:
    """The pixels of arrays that lie as their rows' layouts say (picture_id and the array column); kind_of: the channel layout, such as Rgb.

    offset: place in the array at which the layout begins.  Arrays that are too short, null layouts, and
    layouts of another number of channels give no pixels.
    """
    n = LAYOUTS[kind_of]
    held = pictures.select("picture_id", F.col(samples).alias("_s"), at.alias("_at"), _column(offset).alias("_from"))
    good = held.where(fits(F.col("_at"), F.size("_s") - F.col("_from")) & (F.col("_at.channels") == n) & (F.col("_from") >= 0) & (F.col("_at.width") > 0) & (F.col("_at.height") > 0))
    lines = good.withColumn("_y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_at.height") - 1)))
    places = lines.withColumn("_x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_at.width") - 1)))
    place = F.col("_from") + F.col("_x") * F.col("_at.width_stride") + F.col("_y") * F.col("_at.height_stride")
    channels = [F.get("_s", (place + c * F.col("_at.channel_stride")).cast("int")) for c in range(n)]
    return from_table(places, F.col("picture_id"), F.col("_at.width"), F.col("_at.height"), F.col("_x"), F.col("_y"), channels, kind_of, kind)
