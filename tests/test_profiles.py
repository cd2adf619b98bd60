"""Embedded colour profiles: blocks there and back, naming, and mixed corpora in one space."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from pixelry.functions import colour
from pixelry.operators import point
from pixelry.sources import codecs, pictures, profiles
from tests.test_files import chunk, png
from tests.test_tiles import arrays, drawn

SPACES = "path string, icc binary, exif binary"


@pytest.mark.parametrize("primaries", ["srgb", "display-p3", "rec2020", "bt601", "bt470m"])
@pytest.mark.parametrize("transfer", sorted(profiles.CURVES))
def test_named_spaces_there_and_back(primaries, transfer):
    found = profiles.parse(profiles.of_space((primaries, transfer)))
    assert (found["primaries"], found["transfer"]) == (primaries, transfer)
    assert np.allclose(np.array(found["matrix"]).reshape(3, 3), profiles.to_pcs(primaries), atol=1e-4)
    assert np.allclose(profiles.to_pcs(primaries) @ np.ones(3), [0.9642, 1.0, 0.8249], atol=2e-3)  # white is the connection space's white


def curve(kind: int, *values: float) -> bytes:
    return b"para\0\0\0\0" + struct.pack(">HH", kind, 0) + b"".join(struct.pack(">i", round(v * 65536)) for v in values)


@pytest.mark.parametrize(
    "raw, value",
    [
        (b"curv\0\0\0\0\0\0\0\0", lambda v: v),
        (b"curv\0\0\0\0\0\0\0\1\2\0", lambda v: v**2),
        (b"curv\0\0\0\0\0\0\0\3\0\0\x80\0\xff\xff", lambda v: np.interp(v, [0, 0.5, 1], [0, 32768 / 65535, 1])),
        (curve(0, 3), lambda v: v**3),
        (curve(1, 2, 2, -0.5), lambda v: np.where(v >= 0.25, np.maximum(2 * v - 0.5, 0) ** 2, 0)),
        (curve(2, 2, 2, -0.5, 0.125), lambda v: np.where(v >= 0.25, np.maximum(2 * v - 0.5, 0) ** 2 + 0.125, 0.125)),
        (curve(3, 2, 0.5, 0.25, 0.5, 0.5), lambda v: np.where(v >= 0.5, (0.5 * v + 0.25) ** 2, 0.5 * v)),
        (curve(4, 2, 0.5, 0.25, 0.5, 0.5, 0.125, 0.25), lambda v: np.where(v >= 0.5, (0.5 * v + 0.25) ** 2 + 0.125, 0.5 * v + 0.25)),
    ],
)
def test_curves(raw, value):
    v = np.linspace(0, 1, 41)
    assert np.allclose(profiles._value(profiles._curve(raw), v), value(v), atol=1e-4)


def test_broken_profiles_are_null(spark):
    good = profiles.of_space(("srgb", "srgb"))
    rows = [("good", good), ("none", None), ("empty", b""), ("cut", good[:200]), ("short", good[:100]), ("lut", good.replace(b"rTRC", b"A2B0")), ("cmyk", good[:16] + b"CMYK" + good[20:]), ("lab", good[:20] + b"Lab " + good[24:]), ("junk", good[:132] + b"\xff" * 500)]
    got = {r.path: r.p for r in spark.createDataFrame(rows, "path string, icc binary").select("path", profiles.profile("icc").alias("p")).collect()}
    assert {k for k, v in got.items() if v is not None} == {"good"}


def converted(a: np.ndarray, m: np.ndarray, linear, top: int = 255) -> np.ndarray:
    v = np.clip(linear(a / top) @ m.T, 0, 1)
    return np.floor(np.round(np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055) * top, 6) + 0.5)


def test_mixed_corpus_in_one_plan(spark):
    rng = np.random.default_rng(1)
    given = {f"p{i}": rng.integers(0, 256, (3, 4, 4)) for i in range(6)}
    gamma = {"parameters": [1.8, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0], "table": None}
    icc = [None, profiles.of_space(("srgb", "srgb")), profiles.encode(profiles.to_pcs("rec2020"), [gamma] * 3), profiles.encode(None, [gamma]), b"broken"]  # and one without a row
    exif = b"II*\0\x08\0\0\0\1\0\x12\1\3\0\1\0\0\0\6\0\0\0"
    blocks = spark.createDataFrame([(f"p{i}", raw, exif if i == 2 else None) for i, raw in enumerate(icc)], SPACES)
    r = drawn(spark, given, "Rgba")
    out = profiles.corrected(r, profiles.spaces(blocks))
    got = arrays(out)
    assert out.space == ("srgb", "srgb")
    for k in ("p0", "p1", "p3", "p4", "p5"):
        assert (got[k] == given[k]).all()
    m = np.linalg.inv(profiles.to_pcs("srgb")) @ np.array(profiles.parse(icc[2])["matrix"]).reshape(3, 3)
    want = converted(given["p2"][..., :3].astype(float), m, lambda v: v ** (round(1.8 * 65536) / 65536))
    turned = np.rot90(np.concatenate([want, given["p2"][..., 3:]], -1), -1)  # orientation 6: clockwise
    assert (got["p2"] == turned).all()
    assert (arrays(profiles.corrected(r, profiles.spaces(blocks), orient=False))["p2"] == np.concatenate([want, given["p2"][..., 3:]], -1)).all()


def test_other_targets_and_grey(spark):
    rng = np.random.default_rng(2)
    given = {f"p{i}": rng.integers(0, 65536, (2, 3, 3)) for i in range(3)}
    blocks = spark.createDataFrame([("p0", profiles.of_space(("display-p3", "srgb")), None), ("p1", profiles.of_space(("rec2020", "linear")), None)], SPACES)
    r = drawn(spark, given, "Rgb", "u16")
    got = arrays(profiles.corrected(r, profiles.spaces(blocks), ("display-p3", "srgb")))
    assert (got["p0"] == given["p0"]).all()
    plain = arrays(point.convert_color_space(r, ("srgb", "srgb"), ("display-p3", "srgb")))["p2"]
    assert np.abs(got["p2"] - plain).max() <= 40  # the same space by another way: through the connection space's white
    grey = {"p0": rng.integers(0, 256, (2, 3, 1)), "p1": rng.integers(0, 256, (2, 3, 1))}
    table = {"parameters": None, "table": [0.0, 0.1, 1.0]}
    blocks = spark.createDataFrame([("p0", profiles.encode(None, [table]), None), ("p1", profiles.of_space(("rec2020", "linear")), None)], SPACES)
    got = arrays(profiles.corrected(drawn(spark, grey, "L"), profiles.spaces(blocks)))
    t = round(0.1 * 65535) / 65535
    assert (got["p0"] == converted(grey["p0"].astype(float), np.eye(1), lambda v: np.interp(v, [0, 0.5, 1], [0, t, 1]))).all()
    assert (got["p1"] == grey["p1"]).all()  # three curves for one channel: left alone


def test_files_are_corrected_when_read(spark, tmp_path):
    lines = bytes([0, 10, 200, 30, 250, 5, 90, 0, 1, 2, 3, 128, 64, 32])
    icc = chunk(b"iCCP", b"p3\0\0" + zlib.compress(profiles.of_space(("display-p3", "srgb"))))
    turned = chunk(b"eXIf", b"MM\0*\0\0\0\x08\0\1\1\x12\0\3\0\0\0\1\0\3\0\0")
    (tmp_path / "a.png").write_bytes(png(2, 2, lines, icc, turned))
    (tmp_path / "b.png").write_bytes(png(2, 2, lines))
    assert codecs.decode("png", (tmp_path / "a.png").read_bytes())[:4] == (2, 2, "Rgb", "u8")
    got = {k.rsplit("/", 1)[1]: v for k, v in arrays(pictures.read_corrected(spark, tmp_path.as_uri())).items()}
    own = np.frombuffer(lines, np.uint8).reshape(2, 7)[:, 1:].reshape(2, 2, 3).astype(float)
    m = np.linalg.inv(profiles.to_pcs("srgb")) @ np.array(profiles.parse(profiles.of_space(("display-p3", "srgb")))["matrix"]).reshape(3, 3)
    want = converted(own, m, lambda v: np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4))
    assert np.abs(got["a.png"] - want[::-1, ::-1]).max() <= 1
    assert (got["b.png"] == own).all()


def test_labels_are_kept_by_every_operator(spark):
    from pixelry.operators import compose, geometry, resample, window

    space = ("display-p3", "srgb")
    a = {"p": np.random.default_rng(3).integers(0, 256, (6, 5, 3))}
    r, top = drawn(spark, a, space=space), drawn(spark, {"p": a["p"][:2, :2]}, space=space)
    made = [
        resample.resize_exact(r, 3, 3), resample.resize_exact(r, 3, 3, "nearest"), resample.resize(r, 3, 3), resample.resize_to_fill(r, 3, 3), resample.thumbnail_exact(r, 2, 2), resample.thumbnail_exact(r, 9, 9), resample.thumbnail(r, 2, 2),
        compose.overlay(r, top), compose.replace(r, top), compose.tile(r, top, 2, 2), compose.copy_from(r, top, 0, 0), compose.copy_within(r, 0, 0, 2, 2, 1, 1), compose.try_copy_within(r, 0, 0, 2, 2, 1, 1)[0], compose.combine(r, r, lambda x, y: x), compose.beside(r, r),
        geometry.crop(r, 0, 0, 2, 2), geometry.view(r, 0, 0, 2, 2), geometry.rotate90(r), geometry.put_pixel(r, 0, 0, [1, 2, 3]), window.fast_blur(r, 1.5), window.filter3x3(r, [0.0] * 9), window.unsharpen(r, 1.0, 1), window.dither_bilevel(point.grayscale(r)), point.grayscale(r), point.invert(r), point.convert(r, "Rgba", "u16"),
    ]
    assert all(x.space == space for x in made)
    assert point.index_colors(r, [(0, 0, 0)]).space == ("unspecified", "unspecified")
    same = point.apply_color_space(compose.overlay(r, top), space)  # its own space: nothing may change
    assert (arrays(same)["p"] == arrays(compose.overlay(r, top))["p"]).all()
    assert colour.supported(space)
