"""The tile relation: packing, borders, banded matrices and sampling."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelry.operators import resample, window
from pixelry.plans import tiles
from pixelry.plans.raster import Raster
from tests.test_resample import matrix, rounded


def drawn(spark, pictures: dict[str, np.ndarray], layout: str = "Rgb", kind: str = "u8", space=("srgb", "srgb")) -> Raster:
    names = [f"c{i}" for i in range(next(iter(pictures.values())).shape[2])]
    rows = [(k, a.shape[1], a.shape[0], x, y, *(v.item() for v in a[y, x])) for k, a in pictures.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    sample = "float" if kind == "f32" else "int"
    df = spark.createDataFrame(rows, "picture_id string, w int, h int, x int, y int, " + ", ".join(f"{n} {sample}" for n in names))
    return Raster(df.repartition(5, F.hash("x", "y")), layout, kind, space)


def arrays(r: Raster) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for row in r.pixels.collect():
        out.setdefault(row.picture_id, np.full((row.h, row.w, len(r.names)), -1.0))[row.y, row.x] = [row[n] for n in r.names]
    return out


def some(rng, *sizes, channels=3, top=256) -> dict[str, np.ndarray]:
    return {f"p{i}": rng.integers(0, top, (h, w, channels)) for i, (w, h) in enumerate(sizes)}


@pytest.mark.parametrize("layout, kind, channels", [("Rgb", "u8", 3), ("La", "u16", 2), ("L", "f32", 1)])
def test_there_and_back(spark, monkeypatch, layout, kind, channels):
    monkeypatch.setattr(tiles, "HELD_PIXELS", 500)
    rng = np.random.default_rng(1)
    pictures = some(rng, (1, 1), (64, 64), (65, 130), (200, 3), channels=channels, top=65536 if kind == "u16" else 256)
    if kind == "f32":
        pictures = {k: (a / 256).astype(np.float32) for k, a in pictures.items()}
    t = tiles.from_raster(drawn(spark, pictures, layout, kind, ("display-p3", "srgb")))
    assert t.rows.count() == 1 + 1 + 6 + 4
    back = tiles.to_raster(t)
    assert (back.layout, back.kind, back.space) == (layout, kind, ("display-p3", "srgb"))
    got = arrays(back)
    assert all((got[k] == a).all() for k, a in pictures.items())


def test_tiles_with_their_surroundings(spark):
    a = np.random.default_rng(2).integers(0, 256, (140, 100, 1))
    held = tiles.with_halo(tiles.from_raster(drawn(spark, {"p": a}, "L")), 2, 0, 5, 64).collect()
    assert len(held) == 6
    for row in held:
        x0, y0, x1, y1 = tiles.edges(100, 140, row.tx, row.ty)
        want = a[y0 : min(140, y1 + 64), max(0, x0 - 2) : min(100, x1 + 5)]
        assert (np.frombuffer(row.samples, np.uint8) == want.reshape(-1)).all()
    with pytest.raises(ValueError):
        tiles.with_halo(tiles.from_raster(drawn(spark, {"p": a}, "L")), 65, 0, 0, 0)


@pytest.mark.parametrize("name", ["triangle", "catmull_rom", "gaussian", "lanczos3"])
def test_resize_over_tile_borders(spark, monkeypatch, name):
    monkeypatch.setattr(tiles, "HELD_SUMS", 1)
    pictures = some(np.random.default_rng(3), (150, 70), (66, 64), (1, 130), channels=2)
    got = arrays(resample.resize_exact(drawn(spark, pictures, "La"), F.greatest(F.lit(1), F.col("w") - 61), F.col("h") * 2, name))
    for k, a in pictures.items():
        h, w = a.shape[:2]
        want = np.einsum("oy,yxc,px->opc", matrix(h, 2 * h, name), a.astype(float), matrix(w, max(1, w - 61), name))
        assert (got[k] == rounded(want)).mean() > 0.9999 and np.abs(got[k] - rounded(want)).max() <= 1


def test_resize_to_one_pixel_sends_one_sum(spark):
    a = np.random.default_rng(4).integers(0, 256, (300, 200, 1))
    got = arrays(resample.resize_exact(drawn(spark, {"p": a}, "L"), 1, 1, "triangle"))["p"]
    assert got == rounded(matrix(300, 1, "triangle") @ a[:, :, 0] @ matrix(200, 1, "triangle").T)


def test_operators_follow_one_another_on_tiles(spark):
    a = np.random.default_rng(5).integers(0, 256, (90, 130, 3))
    t = tiles.from_raster(drawn(spark, {"p": a}))
    chained = arrays(tiles.to_raster(tiles.resize(tiles.resize(t, 70, 45, "triangle"), 20, 10, "gaussian")))["p"]
    half = rounded(np.einsum("oy,yxc,px->opc", matrix(90, 45, "triangle"), a.astype(float), matrix(130, 70, "triangle")))
    assert (chained == rounded(np.einsum("oy,yxc,px->opc", matrix(45, 10, "gaussian"), half.astype(float), matrix(70, 20, "gaussian")))).all()


@pytest.mark.parametrize("bilinear", [True, False])
def test_sampling(spark, monkeypatch, bilinear):
    monkeypatch.setattr(tiles, "HOT_POINTS", 20)
    pictures = some(np.random.default_rng(6), (130, 70), (64, 65), (1, 1))
    rng = np.random.default_rng(7)
    rows = [(f"p{rng.integers(4)}", int(i), float(rng.choice([0, 63, 63.5, 64, 129, -0.1, 129.01, float("nan"), *rng.uniform(-5, 140, 9)])), float(rng.choice([0, 64, 69, 63.25, *rng.uniform(-5, 75, 9)]))) for i in range(400)]
    rows += [("p0", 1000 + i, 70.25, 3.5) for i in range(100)] + [("p0", 5, None, 1.0), (None, 6, 1.0, 1.0), ("p0", 1000, 70.25, 3.5)]
    points = spark.createDataFrame(rows, "picture_id string, n int, x double, y double").selectExpr("*", "x AS c9", "1 AS tx", "'k' AS samples")
    f = resample.interpolate_bilinear if bilinear else resample.interpolate_nearest
    got = sorted(((r.picture_id or "", r.n, r.c0, r.c1, r.c2, r.tx, r.samples) for r in f(points, drawn(spark, pictures), F.col("x"), F.col("y")).collect()), key=str)
    want = []
    for p, n, x, y in rows:
        v = [None] * 3
        if p in pictures and x is not None and 0 <= x <= pictures[p].shape[1] - 1 and 0 <= y <= pictures[p].shape[0] - 1:
            a = pictures[p].astype(float)
            if bilinear:
                i, j = int(x), int(y)
                k, m = min(i + 1, a.shape[1] - 1), min(j + 1, a.shape[0] - 1)
                dx, dy = x - i, y - j
                v = [int(c) for c in rounded(a[j, i] * (1 - dx) * (1 - dy) + a[m, i] * (1 - dx) * dy + a[j, k] * dx * (1 - dy) + a[m, k] * dx * dy)]
            else:
                v = [int(c) for c in a[int(np.floor(y + 0.5)), int(np.floor(x + 0.5))]]
        want.append((p or "", n, *v, 1, "k"))
    assert got == sorted(want, key=str)


def test_neighbourhoods_on_tiles_equal_those_on_pixels(spark):
    pictures = some(np.random.default_rng(8), (130, 70), (64, 3), (1, 1))
    r = drawn(spark, pictures, space=("display-p3", "srgb"))
    t = tiles.from_raster(r)
    kernel = [1.0, -2.0, 0.5, 0.0, 5.0, -1.0, 0.25, 0.0, -1.0]
    for f in (lambda v: window.gaussian_blur(v, 2.0), lambda v: window.fast_blur(v, 4.0), lambda v: window.filter3x3(v, kernel), lambda v: window.unsharpen(v, 1.5, 3), lambda v: window.box_pass(v, "x", 5)):
        on_pixels, on_tiles = arrays(f(r)), arrays(tiles.to_raster(f(t)))
        assert all((on_pixels[k] == on_tiles[k]).all() for k in pictures)
    chained = tiles.to_raster(window.gaussian_blur(tiles.resize(t, 90, 80, "lanczos3"), 1.2))
    apart = window.gaussian_blur(resample.resize_exact(r, 90, 80, "lanczos3"), 1.2)
    assert chained.space == apart.space == ("display-p3", "srgb")
    assert all((arrays(chained)[k] == v).all() for k, v in arrays(apart).items())
    with pytest.raises(ValueError):
        window.box_pass(t, "x", 65)


def test_empty(spark):
    t = tiles.from_raster(drawn(spark, {"p": np.zeros((1, 1, 3), int)}).where("false"))
    assert tiles.to_raster(tiles.resize(t, 3, 3, "triangle")).pixels.count() == 0
