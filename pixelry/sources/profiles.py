"""Embedded colour profiles as columns: one colour space for each picture, and pictures of many spaces in one plan.

A profile of the matrix kind (three primaries and a curve for each channel) or of one grey curve is read to
a struct: `matrix` takes linear samples to CIE XYZ under D50, and each of `curves` is a parametric function
or a table.  Profiles with lookup tables, and broken ones, give null: their pictures are left as they are.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelry.functions import colour
from pixelry.functions import samples as S
from pixelry.operators import geometry
from pixelry.plans.raster import KEY, Raster
from pixelry.sources import metadata

# The white of the profile connection space.
_D50 = np.array([0.9642, 1.0, 0.8249])
# G, a, b, c, d, e, f of (a v + b)^g + e from v = d on, c v + f below, by transfer function.
CURVES: dict[str, tuple[float, ...]] = {
    "srgb": (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045, 0.0, 0.0),
    "bt709": (1 / 0.45, 1 / 1.099, 0.099 / 1.099, 1 / 4.5, 0.081, 0.0, 0.0),
    "smpte240m": (1 / 0.45, 1 / 1.1115, 0.1115 / 1.1115, 1 / 4, 0.0912, 0.0, 0.0),
    "gamma22": (2.2, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "gamma28": (2.8, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "linear": (1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
}
_CURVE = T.StructType([T.StructField("parameters", T.ArrayType(T.DoubleType())), T.StructField("table", T.ArrayType(T.DoubleType()))])
PROFILE = T.StructType([T.StructField("primaries", T.StringType()), T.StructField("transfer", T.StringType()), T.StructField("matrix", T.ArrayType(T.DoubleType())), T.StructField("curves", T.ArrayType(_CURVE))])


def to_pcs(primaries: str) -> np.ndarray:
    """Linear RGB to XYZ under D50."""
    x, y = colour.PRIMARIES[primaries][3]
    white = np.array([x / y, 1.0, (1 - x - y) / y])
    b = colour.BRADFORD
    return np.linalg.inv(b) @ np.diag((b @ _D50) / (b @ white)) @ b @ colour.to_xyz(primaries)


def _fixed(raw: bytes, at: int, n: int) -> list[float]:
    return [v / 65536 for v in struct.unpack_from(f">{n}i", raw, at)]


def _curve(raw: bytes) -> dict | None:
    """A curve tag; null for kinds that are not known."""
    if raw[:4] == b"curv":
        n = struct.unpack_from(">I", raw, 8)[0]
        if n == 0:
            return {"parameters": list(CURVES["linear"]), "table": None}
        if n == 1:
            return {"parameters": [struct.unpack_from(">H", raw, 12)[0] / 256, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0], "table": None}
        return {"parameters": None, "table": [v / 65535 for v in struct.unpack_from(f">{n}H", raw, 12)]}
    if raw[:4] == b"para":
        kind = struct.unpack_from(">H", raw, 8)[0]
        p = _fixed(raw, 12, (1, 3, 4, 5, 7)[kind])
        g, a, b, c, d, e, f = [*p, *[0.0] * (7 - len(p))]
        if kind == 0:
            a, d = 1.0, 0.0
        elif kind in (1, 2):  # below -b / a the curve is 0, or the constant c
            e = f = c if kind == 2 else 0.0
            c, d = 0.0, -b / a
        return {"parameters": [g, a, b, c, d, e, f], "table": None}
    return None


def _value(curve: dict, v: np.ndarray) -> np.ndarray:
    if curve["table"]:
        return np.interp(v, np.linspace(0, 1, len(curve["table"])), curve["table"])
    g, a, b, c, d, e, f = curve["parameters"]
    return np.where(v >= d, np.maximum(a * v + b, 0) ** g + e, c * v + f)


def parse(raw: bytes) -> dict | None:
    """primaries, transfer (named where they are known ones), matrix (row by row; null for grey) and curves of a profile."""
    if len(raw) < 132 or raw[36:40] != b"acsp" or raw[20:24] != b"XYZ ":
        return None
    tags = {raw[i : i + 4]: raw[(at := struct.unpack_from(">I", raw, i + 4)[0]) : at + struct.unpack_from(">I", raw, i + 8)[0]] for i in range(132, 132 + 12 * min(struct.unpack_from(">I", raw, 128)[0], 200), 12)}
    grey = raw[16:20] == b"GRAY"
    if not grey and raw[16:20] != b"RGB ":
        return None
    code = tags.get(b"cicp", b"")
    primaries, transfer = ({v: k for k, v in codes.items()}.get(code[i], "unspecified") if len(code) > i else "unspecified" for codes, i in ((colour.PRIMARIES_CODES, 8), (colour.TRANSFER_CODES, 9)))
    curves = [_curve(tags[k]) for k in ([b"kTRC"] if grey else [b"rTRC", b"gTRC", b"bTRC"])]
    if None in curves:
        return None
    matrix = None if grey else np.array([_fixed(tags[k], 8, 3) for k in (b"rXYZ", b"gXYZ", b"bXYZ")]).T
    at = np.linspace(0, 1, 33)
    alike = [name for name, p in CURVES.items() if all(np.abs(_value(c, at) - _value({"parameters": p, "table": None}, at)).max() < 0.002 for c in curves)]
    transfer = alike[0] if transfer == "unspecified" and alike else transfer
    if primaries == "unspecified" and matrix is not None:
        near = [(np.abs(matrix - to_pcs(name)).max(), name) for name in colour.PRIMARIES if name != "xyz"]
        primaries = min(near)[1] if min(near)[0] < 0.002 else primaries
    return {"primaries": primaries, "transfer": transfer, "matrix": None if matrix is None else matrix.reshape(-1).tolist(), "curves": curves}


def profile(icc: Column) -> Column:
    """The profile of a block as a struct; null where there is none, or none of a kind that is read."""

    @F.pandas_udf(PROFILE)
    def found(blocks: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in blocks:
            try:
                row = parse(raw) if raw is not None else None
            except (struct.error, KeyError, IndexError, ZeroDivisionError, UnicodeDecodeError):
                row = None
            rows.append(row or dict.fromkeys(PROFILE.names))
        return pd.DataFrame(rows, columns=PROFILE.names)

    p = found(icc)
    return F.when(p["curves"].isNotNull(), p)


def encode(matrix: np.ndarray | None, curves: list[dict]) -> bytes:
    """A profile block of a matrix to XYZ under D50 (none: grey) and curves."""
    fixed = lambda *values: b"".join(struct.pack(">i", round(v * 65536)) for v in values)

    def curve(c: dict) -> bytes:
        if c["table"]:
            return b"curv\0\0\0\0" + struct.pack(">I", len(c["table"])) + b"".join(struct.pack(">H", round(v * 65535)) for v in c["table"])
        return b"para\0\0\0\0" + struct.pack(">HH", 4, 0) + fixed(*c["parameters"])

    tags = [(b"kTRC", curve(curves[0]))] if matrix is None else [(k, b"XYZ \0\0\0\0" + fixed(*column)) for k, column in zip((b"rXYZ", b"gXYZ", b"bXYZ"), np.asarray(matrix).T, strict=True)] + [(k, curve(c)) for k, c in zip((b"rTRC", b"gTRC", b"bTRC"), curves, strict=True)]
    head, body, at = [], [], 132 + 12 * len(tags)
    for name, data in tags:
        data += b"\0" * (-len(data) % 4)
        head.append(name + struct.pack(">II", at, len(data)))
        body.append(data)
        at += len(data)
    top = struct.pack(">I4sI4s4s4s12s4s", at, b"\0" * 4, 0x04000000, b"mntr", b"GRAY" if matrix is None else b"RGB ", b"XYZ ", b"\0" * 12, b"acsp")
    return top + b"\0" * 28 + fixed(*_D50) + b"\0" * (128 - len(top) - 28 - 12) + struct.pack(">I", len(tags)) + b"".join(head) + b"".join(body)


def of_space(space: colour.Space) -> bytes:
    """A profile block of a named colour space whose transfer function is one of CURVES."""
    return encode(to_pcs(space[0]), [{"parameters": list(CURVES[space[1]]), "table": None}] * 3)


def spaces(blocks: DataFrame) -> DataFrame:
    """picture_id, profile and orientation (1 where none is stated) of rows with path, icc and exif."""
    return blocks.select(F.col("path").alias("picture_id"), profile(F.col("icc")).alias("profile"), F.coalesce(metadata.orientation(F.col("exif")), F.lit(1)).alias("orientation"))


def _linear(v: Column, curve: Column) -> Column:
    table, p = curve["table"], [curve["parameters"][i] for i in range(7)]
    g, a, b, c, d, e, f = p
    place = v * (F.size(table) - 1)
    low = F.least(F.floor(place), F.size(table) - 2).cast("int")
    one, two = F.get(table, low), F.get(table, low + 1)
    power = F.pow(F.greatest(a * v + b, F.lit(0.0)), g) + e
    return F.when(F.size(table) > 1, one + (place - low) * (two - one)).when(v >= d, power).otherwise(c * v + f)


def corrected(r: Raster, found: DataFrame, target: colour.Space = ("srgb", "srgb"), orient: bool = True) -> Raster:
    """Pictures of any embedded spaces in one space, turned upright, in one projection after a join with `spaces` by picture.

    A picture without a profile counts as sRGB.  Where the profile names the target space, or has another
    number of channels than the picture, samples stay as they are; alpha always does.
    """
    top, n = S.MAX[r.kind], len(r.colour)
    back = np.linalg.inv(to_pcs(target[0]))
    standard = to_pcs("srgb").reshape(-1).tolist()
    given = F.coalesce(F.col("profile.matrix"), F.array(*map(F.lit, standard)))
    product = F.array(*(sum((given[3 * k + j] * float(back[i, k]) for k in range(1, 3)), given[j] * float(back[i, 0])) for i in range(3) for j in range(3)))
    default = F.struct(F.array(*map(F.lit, CURVES["srgb"])).alias("parameters"), F.lit(None).cast("array<double>").alias("table"))
    curves = F.coalesce(F.col("profile.curves"), F.array(*[default] * n))
    name = lambda part, i: F.when(F.col("profile").isNull(), F.lit("srgb")).otherwise(F.col(f"profile.{part}"))
    same = (name("transfer", 1) == target[1]) & ((name("primaries", 0) == target[0]) if n == 3 else F.lit(True))
    rows = found.select("picture_id", product.alias("_m"), curves.alias("_curves"), (F.coalesce(same, F.lit(False)) | (F.size(curves) != n)).alias("_same"), F.col("orientation").alias("_turn"))
    joined = r.over(r.pixels.select(*KEY, *r.names).join(rows, "picture_id", "left"))
    missing = F.col("_same").isNull()  # a picture that has no row at all: sRGB, too
    m = lambda k: F.coalesce(F.get("_m", F.lit(k)), F.lit(float((back @ to_pcs("srgb")).reshape(-1)[k])))
    # step by step: each value is used several times by the next
    steps = joined.pixels.withColumns({f"_p{i}": F.coalesce(F.get("_curves", F.lit(i)), default) for i in range(n)})
    steps = steps.withColumns({f"_l{i}": _linear(c.cast("double") / top, F.col(f"_p{i}")) for i, c in enumerate(r.colour)})
    if n == 3:
        steps = steps.withColumns({f"_x{i}": sum((F.col(f"_l{j}") * m(3 * i + j) for j in range(1, 3)), F.col("_l0") * m(3 * i)) for i in range(3)})
    steps = steps.withColumns({f"_v{i}": S.clamp(F.col(f"_{'x' if n == 3 else 'l'}{i}"), 0.0, 1.0) for i in range(n)})
    joined = joined.over(steps)
    coded = [S.round_to(colour.from_linear(F.col(f"_v{i}"), target[1]) * top, r.kind) for i in range(n)]
    stays = F.when(missing, F.lit(target == ("srgb", "srgb"))).otherwise(F.col("_same"))
    channels = [F.when(stays, c).otherwise(v) for c, v in zip(r.colour, coded, strict=True)] + ([r.channels[-1]] if r.has_alpha else [])
    place = geometry.turned(F.coalesce("_turn", F.lit(1))) if orient else {}
    out = joined.select(channels, **place)
    return Raster(out.pixels, out.layout, out.kind, target)
