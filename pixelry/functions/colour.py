"""Colour spaces as columns: primaries, transfer functions, and luminance by primaries.

A space is a pair (primaries, transfer).  Samples are reals in 0..1 here; matrices are made on the
driver from the chromaticities, so a conversion is one projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelry.functions import samples as S

Space = tuple[str, str]
_D65, _C, _E, _DCI = (0.3127, 0.3290), (0.310, 0.316), (1 / 3, 1 / 3), (0.314, 0.351)
# Chromaticities (x, y) of red, green, blue and white, by the names of ITU-T H.273.
PRIMARIES = {
    "srgb": ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), _D65),
    "bt470m": ((0.67, 0.33), (0.21, 0.71), (0.14, 0.08), _C),
    "bt470bg": ((0.64, 0.33), (0.29, 0.60), (0.15, 0.06), _D65),
    "bt601": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), _D65),
    "smpte240m": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), _D65),
    "film": ((0.681, 0.319), (0.243, 0.692), (0.145, 0.049), _C),
    "rec2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), _D65),
    "xyz": ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0), _E),
    "dci-p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), _DCI),
    "display-p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), _D65),
    "ebu3213": ((0.630, 0.340), (0.295, 0.605), (0.155, 0.077), _D65),
}
# The Bradford cone responses.
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
#: Codes of ITU-T H.273 by name; those without a conversion are named, too.
PRIMARIES_CODES = {"srgb": 1, "unspecified": 2, "bt470m": 4, "bt470bg": 5, "bt601": 6, "smpte240m": 7, "film": 8, "rec2020": 9, "xyz": 10, "dci-p3": 11, "display-p3": 12, "ebu3213": 22}
TRANSFER_CODES = {"bt709": 1, "unspecified": 2, "gamma22": 4, "gamma28": 5, "bt601": 6, "smpte240m": 7, "linear": 8, "log100": 9, "log316": 10, "xvycc": 11, "bt1361": 12, "srgb": 13, "rec2020-10": 14, "rec2020-12": 15, "pq": 16, "smpte428": 17, "hlg": 18}
_SDR = ("bt709", "bt601", "xvycc", "bt1361", "rec2020-10", "rec2020-12")  # one curve on 0..1
# A, b and c of hybrid log-gamma.
_HLG = (0.17883277, 0.28466892, 0.55991073)


def _white(xy: tuple[float, float]) -> np.ndarray:
    return np.array([xy[0] / xy[1], 1.0, (1 - xy[0] - xy[1]) / xy[1]])


def to_xyz(primaries: str) -> np.ndarray:
    """Linear RGB to CIE XYZ."""
    *points, white = PRIMARIES[primaries]
    cols = np.array([[x, y, 1 - x - y] for x, y in points]).T
    return cols * np.linalg.solve(cols, _white(white))


def matrix(source: str, target: str) -> list[list[float]]:
    """Linear RGB of one set of primaries to another; whites are adapted by cone responses."""
    a, b = (_white(PRIMARIES[p][3]) for p in (source, target))
    adapt = np.eye(3) if PRIMARIES[source][3] == PRIMARIES[target][3] else np.linalg.inv(BRADFORD) @ np.diag((BRADFORD @ b) / (BRADFORD @ a)) @ BRADFORD
    return (np.linalg.inv(to_xyz(target)) @ adapt @ to_xyz(source)).tolist()


def luminance_weights(primaries: str) -> list[float]:
    return to_xyz(primaries)[1].tolist()


def primaries_supported(name: Column) -> Column:
    """Whether pixels of these primaries can be converted."""
    return name.isin(*PRIMARIES)


def transfer_supported(name: Column) -> Column:
    return name.isin(*(t for t in TRANSFER_CODES if t not in ("unspecified", "pq")))


def supported(space: Space) -> bool:
    return space[0] in PRIMARIES and space[1] in TRANSFER_CODES and space[1] not in ("unspecified", "pq")


def to_linear(v: Column, transfer: str) -> Column:
    """Linear light of a coded value in 0..1."""
    power = lambda x, e: F.pow(x, F.lit(e))
    if transfer in _SDR:
        return F.when(v < 0.081, v / 4.5).otherwise(power((v + 0.099) / 1.099, 1 / 0.45))
    a, b, c = _HLG
    return {
        "gamma22": lambda: power(v, 2.2),
        "gamma28": lambda: power(v, 2.8),
        "smpte240m": lambda: F.when(v < 0.0912, v / 4).otherwise(power((v + 0.1115) / 1.1115, 1 / 0.45)),
        "linear": lambda: v,
        "log100": lambda: F.when(v <= 0, 0.005).otherwise(F.pow(F.lit(10.0), 2 * (v - 1))),
        "log316": lambda: F.when(v <= 0, 10**-2.5 / 2).otherwise(F.pow(F.lit(10.0), 2.5 * (v - 1))),
        "srgb": lambda: S.srgb_to_linear(v),
        "smpte428": lambda: power(v, 2.6) * (52.37 / 48),
        "hlg": lambda: F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - c) / a) + b) / 12),
    }[transfer]()


def from_linear(v: Column, transfer: str) -> Column:
    """Coded value of linear light in 0..1."""
    power = lambda x, e: F.pow(x, F.lit(e))
    if transfer in _SDR:
        return F.when(v < 0.018, v * 4.5).otherwise(1.099 * power(v, 0.45) - 0.099)
    a, b, c = _HLG
    return {
        "gamma22": lambda: power(v, 1 / 2.2),
        "gamma28": lambda: power(v, 1 / 2.8),
        "smpte240m": lambda: F.when(v < 0.0228, v * 4).otherwise(1.1115 * power(v, 0.45) - 0.1115),
        "linear": lambda: v,
        "log100": lambda: F.when(v < 0.01, 0.0).otherwise(1 + F.log10(F.greatest(v, F.lit(0.01))) / 2),
        "log316": lambda: F.when(v < 10**-2.5, 0.0).otherwise(1 + F.log10(F.greatest(v, F.lit(10**-2.5))) / 2.5),
        "srgb": lambda: S.linear_to_srgb(v),
        "smpte428": lambda: power(v * (48 / 52.37), 1 / 2.6),
        "hlg": lambda: F.when(v <= 1 / 12, F.sqrt(3 * v)).otherwise(a * F.log(F.greatest(12 * v - b, F.lit(1e-9))) + c),
    }[transfer]()


#: Weights of red and blue in luma by matrix name, of ITU-T H.273.
LUMA_BIAS = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593), "smpte240": (0.212, 0.087), "bt470bg": (0.2220, 0.0713)}


def yuv_to_rgb(y: Column, u: Column, v: Column, bias: str = "bt601", full: bool = True) -> list[Column]:
    """8-bit luma and chroma to RGB, of full or limited range."""
    kr, kb = LUMA_BIAS[bias]
    y, u, v = ((c.cast("double") - low) * (1.0 if full else 255 / size) for c, low, size in ((y, 0 if full else 16, 219), (u, 128, 224), (v, 128, 224)))
    red, blue = y + 2 * (1 - kr) * v, y + 2 * (1 - kb) * u
    return [S.round_to(c) for c in (red, (y - kr * red - kb * blue) / (1 - kr - kb), blue)]


def ycgco_to_rgb(y: Column, cg: Column, co: Column, full: bool = True) -> list[Column]:
    """8-bit luma, green and orange chroma to RGB, of full or limited range."""
    y, cg, co = ((c.cast("double") - low) * (1.0 if full else 255 / size) for c, low, size in ((y, 0 if full else 16, 219), (cg, 128, 224), (co, 128, 224)))
    return [S.round_to(c) for c in (y - cg + co, y + cg, y - cg - co)]


def expand_bits(v: Column, depth: int) -> Column:
    """A sample of 1, 2 or 4 bits in 8 bits."""
    return (v * (255 // ((1 << depth) - 1))).cast("int")
