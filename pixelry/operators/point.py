"""Point operators: each output pixel depends on one input pixel, so all of them are projections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelry.functions import colour
from pixelry.functions import samples as S
from pixelry.operators.palette import Tree
from pixelry.plans.raster import Raster


def map_channels(r: Raster, f: Callable[[Column], Column]) -> Raster:
    """f on every channel."""
    return r.select([f(c) for c in r.channels])


def map_with_alpha(r: Raster, f: Callable[[Column], Column], g: Callable[[Column], Column]) -> Raster:
    """f on colour, g on alpha."""
    return r.select([f(c) for c in r.colour] + ([g(r.channels[-1])] if r.has_alpha else []))


def map_without_alpha(r: Raster, f: Callable[[Column], Column]) -> Raster:
    return map_with_alpha(r, f, lambda a: a)


def _grey(r: Raster) -> Column:
    return r.channels[0] if len(r.colour) == 1 else S.luma(*r.colour, r.kind)


def grayscale(r: Raster) -> Raster:
    """Luma; alpha is dropped."""
    return r.select([_grey(r)], layout="L")


def grayscale_alpha(r: Raster) -> Raster:
    """Luma and alpha (opaque where there was none)."""
    return r.select([_grey(r), r.channels[-1] if r.has_alpha else F.lit(S.MAX[r.kind])], layout="La")


def grayscale_with_type(r: Raster, kind: str) -> Raster:
    return convert(grayscale(r), kind=kind)


def invert(r: Raster) -> Raster:
    return map_without_alpha(r, lambda c: S.invert(c, r.kind))


def brighten(r: Raster, value: int) -> Raster:
    return map_without_alpha(r, lambda c: S.brighten(c, value, r.kind))


def contrast(r: Raster, amount: float) -> Raster:
    """Alpha changes too."""
    return map_channels(r, lambda c: S.contrast(c, amount, r.kind))


def huerotate(r: Raster, degrees: int) -> Raster:
    """Grey pictures stay as they are; results are cut to 0..255 for every sample type."""
    if len(r.colour) < 3:
        return r
    rows = S.hue_matrix(degrees)
    turned = [S.clamp(S.mix_channels(r.colour, row), 0.0, 255.0) for row in rows]
    turned = [S.as_float(c) if r.kind == "f32" else F.floor(F.round(c, 6)).cast("int") for c in turned]
    return r.select(turned + ([r.channels[-1]] if r.has_alpha else []))


def convert(r: Raster, layout: str | None = None, kind: str | None = None) -> Raster:
    """Another channel layout and sample type: grey is replicated, colour becomes luma, alpha is added opaque or dropped."""
    layout, target = layout or r.layout, kind or r.kind
    colour = [_grey(r)] if layout in ("L", "La") else r.colour * 3 if len(r.colour) == 1 else r.colour
    alpha = [r.channels[-1] if r.has_alpha else F.lit(S.MAX[r.kind])] if layout in ("La", "Rgba") else []
    return r.select([S.convert(c, r.kind, target) for c in colour + alpha], layout=layout, kind=target)


def to_alpha_mask(r: Raster) -> Raster:
    return r.select([r.channels[-1] if r.has_alpha else F.lit(S.MAX[r.kind])], layout="L")


def swap_red_blue(r: Raster) -> Raster:
    """BGR to RGB and back."""
    c = r.channels
    return r.select([c[2], c[1], c[0], *c[3:]])


def index_bilevel(r: Raster) -> Raster:
    """Index 1 for grey values above 127."""
    return r.select([F.when(_grey(r) > 127, 1).otherwise(0)], layout="L")


def lookup_bilevel(r: Raster) -> Raster:
    return r.select([F.when(r.channels[0] == 0, 0).when(r.channels[0] == 1, 255)], layout="L")


def expand_palette(r: Raster, palette: DataFrame, transparent: int | None = None) -> Raster:
    """Indices to colours; unlisted indices become transparent black, and so does the colour of `transparent`'s alpha.

    palette: idx, c0, c1, c2; an index has 8 bits, so it has at most 256 rows and is broadcast.
    """
    known = palette.where("idx between 0 and 255").select(F.col("idx").alias("p"), *(F.col(f"c{i}").alias(f"p{i}") for i in range(3)))
    joined = r.over(r.pixels.join(F.broadcast(known), F.col("c0") == F.col("p"), "left"))
    alpha = F.when(F.col("p").isNull() | (F.col("p") == F.lit(-1 if transparent is None else transparent)), 0).otherwise(255)
    return joined.select([*(F.coalesce(f"p{i}", F.lit(0)).cast("int") for i in range(3)), alpha.cast("int")], layout="Rgba")


def index_colors(r: Raster, palette: list[tuple[int, ...]]) -> Raster:
    """Index of the nearest palette colour by squared distance, the first of equals."""
    far = [sum(((c - v) * (c - v) for c, v in zip(r.colour[1:], p[1:], strict=True)), (r.colour[0] - p[0]) * (r.colour[0] - p[0])) for p in palette]
    best = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far))))
    return replace(r.select([best["i"]], layout="L"), space=("unspecified", "unspecified"))


def premultiply(r: Raster) -> Raster:
    top = S.MAX[r.kind]
    return map_without_alpha(r, lambda c: S.round_to(c.cast("double") * r.channels[-1] / top, r.kind)) if r.has_alpha else r


def unpremultiply(r: Raster) -> Raster:
    top = S.MAX[r.kind]
    return map_without_alpha(r, lambda c: F.coalesce(S.round_to(c.cast("double") * top / F.nullif(r.channels[-1], F.lit(0)), r.kind), F.lit(0))) if r.has_alpha else r


def convert_color_space(r: Raster, source: colour.Space, target: colour.Space) -> Raster:
    """Pixels of one (primaries, transfer) space in another; alpha is kept, and so are grey pictures between equal transfers."""
    for space in (source, target):
        if not colour.supported(space):
            raise ValueError(f"unsupported colour space: {space[0]}, {space[1]}")
    if source == target or (len(r.colour) < 3 and source[1] == target[1]):
        return replace(r, space=target)
    top = S.MAX[r.kind]
    linear = [colour.to_linear(c.cast("double") / top, source[1]) for c in r.colour]
    if source[0] != target[0] and len(linear) == 3:
        linear = [S.mix_channels(linear, row) for row in colour.matrix(source[0], target[0])]
    coded = [colour.from_linear(S.clamp(c, 0.0, 1.0), target[1]) for c in linear]
    return replace(r.select([S.round_to(c * top, r.kind) for c in coded] + ([r.channels[-1]] if r.has_alpha else [])), space=target)


def apply_color_space(r: Raster, target: colour.Space) -> Raster:
    """Pixels from the raster's own space to another."""
    return convert_color_space(r, r.space, target)


def set_color_space(r: Raster, space: colour.Space) -> Raster:
    """Another label, the same pixels."""
    return replace(r, space=space)


def set_rgb_primaries(r: Raster, primaries: str) -> Raster:
    return replace(r, space=(primaries, r.space[1]))


def set_transfer_function(r: Raster, transfer: str) -> Raster:
    return replace(r, space=(r.space[0], transfer))


def to_luma(r: Raster, primaries: str | None = None, kind: str | None = None) -> Raster:
    """Luminance with the weights of the raster's (or the given) primaries; alpha is dropped."""
    if len(r.colour) == 1:
        return convert(r, "L", kind)
    y = S.mix_channels(r.colour, colour.luminance_weights(primaries or r.space[0]))
    return convert(r.select([S.round_to(y, r.kind)], layout="L"), kind=kind)


def grayscale_with_type_alpha(r: Raster, kind: str) -> Raster:
    return convert(grayscale_alpha(r), kind=kind)


def nearest_color(r: Raster, palette: DataFrame) -> Raster:
    """Index of the nearest colour of a palette that is a table (idx, c0.., of at most 65,536 rows), the least of equals; -1 if it is empty."""
    n = len(r.colour)
    rows = palette.select("idx", *(f"c{i}" for i in range(n))).limit((1 << 16) + 1).collect()
    if len(rows) > 1 << 16:
        raise ValueError("a palette has at most 65536 colours")
    colours = np.array([tuple(x) for x in rows], np.float64).reshape(-1, n + 1)

    @F.pandas_udf("int")
    def nearest(*channels: pd.Series) -> pd.Series:
        own, back = np.unique(np.stack([np.asarray(c, np.float64) for c in channels], 1), axis=0, return_inverse=True)
        return pd.Series(Tree(colours[:, 1:], colours[:, 0].astype(np.int64)).nearest(own)[back.reshape(-1)]).astype("int32")

    return replace(r.select([nearest(*r.colour)], layout="L"), space=("unspecified", "unspecified"))
