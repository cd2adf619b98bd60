"""Sample arithmetic: conversions between sample types, luma, blending and colour models, as columns.

Samples of 8 and 16 bits are integers, of 32 bits floats in 0..1.  Every function maps columns to a
column, so chains of them collapse into one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest sample value by sample type.
MAX = {"u8": 255, "u16": 65535, "f32": 1}
# Luma weights in ten-thousandths (Rec. 709).
LUMA = (2126, 7152, 722)


def as_float(c: Column) -> Column:
    return c.cast("float")


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def luma(r: Column, g: Column, b: Column, kind: str = "u8") -> Column:
    """Luminance with fixed weights: rounded for u8, truncated for other integers, in floats for f32."""
    if kind == "f32":
        return as_float(as_float(F.lit(0.2126)) * r + as_float(F.lit(0.7152)) * g + as_float(F.lit(0.0722)) * b)
    total = LUMA[0] * r.cast("bigint") + LUMA[1] * g.cast("bigint") + LUMA[2] * b.cast("bigint") + (5000 if kind == "u8" else 0)
    return F.floor(total / 10000).cast("int")


def convert(c: Column, source: str, target: str) -> Column:
    """A sample in another sample type."""
    if source == target:
        return c
    if target == "f32":
        return as_float(c.cast("double") / MAX[source])
    if source == "f32":
        top = MAX[target]
        x = F.when(F.isnan(c), F.lit(1.0)).otherwise(F.least(c.cast("double"), F.lit(1.0)))
        return F.greatest(F.lit(0), F.floor(x * top + 0.5)).cast("int")
    return (c * 257).cast("int") if target == "u16" else F.floor((c + 128) / 257).cast("int")


def round_to(v: Column, kind: str = "u8") -> Column:
    """Nearest sample of a real value, clamped to the type."""
    if kind == "f32":
        return as_float(clamp(v, 0.0, 1.0))
    return clamp(F.floor(F.round(v, 6) + 0.5), 0, MAX[kind]).cast("int")


def invert(c: Column, kind: str = "u8") -> Column:
    return (F.lit(MAX[kind]) - c).cast("float" if kind == "f32" else "int")


def brighten(c: Column, value: int, kind: str = "u8") -> Column:
    return clamp(c + value, 0, MAX[kind]).cast("int")


def contrast(c: Column, amount: float, kind: str = "u8") -> Column:
    top = MAX[kind]
    factor = ((100.0 + amount) / 100.0) ** 2
    v = ((c.cast("double") / top - 0.5) * factor + 0.5) * top
    v = clamp(v, 0.0, float(top))
    return as_float(v) if kind == "f32" else F.floor(F.round(v, 6)).cast("int")


def hue_matrix(degrees: float) -> list[list[float]]:
    """Rotation of hue that keeps luminance (the hue-rotate filter of the CSS filter effects)."""
    from math import cos, radians, sin

    c, s = cos(radians(degrees)), sin(radians(degrees))
    # Base, cosine and sine parts of the matrix.
    base = [[0.213, 0.715, 0.072]] * 3
    cosine = [[0.787, -0.715, -0.072], [-0.213, 0.285, -0.072], [-0.213, -0.715, 0.928]]
    sine = [[-0.213, -0.715, 0.928], [0.143, 0.140, -0.283], [-0.787, 0.715, 0.072]]
    return [[base[i][j] + c * cosine[i][j] + s * sine[i][j] for j in range(3)] for i in range(3)]


def mix_channels(channels: list[Column], weights: list[float]) -> Column:
    """Weighted sum in double precision, in the order of the channels."""
    total = channels[0].cast("double") * weights[0]
    for c, w in zip(channels[1:], weights[1:], strict=True):
        total = total + c.cast("double") * w
    return total


def blend(under: list[Column], over: list[Column], kind: str = "u8") -> list[Column]:
    """Source-over compositing of colour channels followed by alpha; without alpha, `over` replaces."""
    if len(under) in (1, 3):
        return over
    top = float(MAX[kind])
    ua, oa = under[-1].cast("double") / top, over[-1].cast("double") / top
    alpha = ua + oa - ua * oa
    out = []
    for u, o in zip(under[:-1], over[:-1], strict=True):
        mixed = (o.cast("double") / top * oa + u.cast("double") / top * ua * (1 - oa)) / F.nullif(alpha, F.lit(0.0))
        out.append(F.coalesce(round_to(mixed * top, kind), u))
    out.append(F.when(alpha == 0, under[-1]).otherwise(round_to(alpha * top, kind)))
    if len(under) == 4:
        out = [F.when(over[-1] == 0, u).when(over[-1] == MAX[kind], o).otherwise(v) for u, o, v in zip(under, over, out, strict=True)]
    return out


def lerp(a: Column, b: Column, t: Column, kind: str = "u8") -> Column:
    """Between a and b; truncated for integers."""
    v = a.cast("double") + (b.cast("double") - a.cast("double")) * t
    return as_float(v) if kind == "f32" else F.floor(F.round(v, 6)).cast("int")


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column, kind: str = "u8") -> list[Column]:
    """Each ink with black, in whole numbers, truncated."""
    top = MAX[kind]
    return [F.floor((top - x.cast("bigint")) * (top - k.cast("bigint")) / top).cast("int") for x in (c, m, y)]


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    """Full-range ITU-R BT.601."""
    y, cb, cr = y.cast("double"), cb.cast("double") - 128, cr.cast("double") - 128
    return [round_to(v) for v in (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)]


def srgb_to_linear(v: Column) -> Column:
    """Transfer function of sRGB, on 0..1."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
