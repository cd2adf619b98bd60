"""Neighbourhood operators across tiles against direct computations, and known values of error diffusion."""

from __future__ import annotations

import numpy as np
import pytest

from pixelry.operators import window
from pixelry.plans.raster import Raster


def relation(spark, drawn: dict[str, np.ndarray], kind: str = "u8") -> Raster:
    rows = [(name, a.shape[1], a.shape[0], x, y, a[y, x].item()) for name, a in drawn.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return Raster(spark.createDataFrame(rows, f"picture_id string, w int, h int, x int, y int, c0 {'float' if kind == 'f32' else 'int'}").repartition(3), "L", kind)


def arrays(r: Raster) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    rows = r.pixels.collect()
    for p in rows:
        out.setdefault(p.picture_id, np.full((p.h, p.w), -1.0))[p.y, p.x] = p.c0
    assert len(rows) == sum(a.size for a in out.values())
    return out


def plain(a: np.ndarray, axis: int, taps: list, finish) -> np.ndarray:
    """One pass with the picture's edge repeated."""
    k = len(taps) // 2
    wide = np.pad(a, [(k, k) if i == axis else (0, 0) for i in range(2)], mode="edge")
    n = a.shape[axis]
    return finish(sum(np.take(wide, range(i, i + n), axis) * t for i, t in enumerate(taps)))


@pytest.fixture(scope="module")
def drawn() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(4)
    return {f"p{w}x{h}": rng.integers(0, 256, (h, w)) for w, h in [(1, 1), (2, 7), (9, 4), (16, 16), (23, 31)]}


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(window, "TILE", 8)


def test_box_blurs(spark, drawn):
    mean = lambda n: lambda v: (v + n // 2) // n
    got = arrays(window.box_pass(window.box_pass(relation(spark, drawn), "x", 2), "y", 11))
    for k, a in drawn.items():
        assert (got[k] == plain(plain(a, 1, [1] * 5, mean(5)), 0, [1] * 23, mean(23))).all()
    got = arrays(window.fast_blur(relation(spark, drawn), 3.0))
    for k, a in drawn.items():
        for radius in window.box_radii(3.0):
            n = 2 * radius + 1
            a = plain(plain(a, 1, [1] * n, mean(n)), 0, [1] * n, mean(n))
        assert (got[k] == a).all()


def test_gaussian_blur_and_sharpening(spark, drawn):
    taps = [int(t * (1 << 15)) for t in window.gaussian_taps(window.kernel_size(1.7), 1.7)]
    finish = lambda v: np.minimum(255, (v + (1 << 14)) >> 15)
    soft = {k: plain(plain(a, 1, taps, finish), 0, taps, finish) for k, a in drawn.items()}
    got = arrays(window.gaussian_blur(relation(spark, drawn), 1.7))
    assert all((got[k] == soft[k]).all() for k in drawn)
    got = arrays(window.unsharpen(relation(spark, drawn), 1.7, 9))
    for k, a in drawn.items():
        d = a - soft[k]
        assert (got[k] == np.where(abs(d) > 9, np.clip(a + d, 0, 255), a)).all()


def test_blur_of_floats(spark, drawn):
    real = {k: (a / 255).astype(np.float32) for k, a in drawn.items()}
    taps = window.gaussian_taps(5, 1.0)
    got = arrays(window.gaussian_blur(relation(spark, real, "f32"), 1.0, size_x=5, size_y=3))
    for k, a in real.items():
        assert got[k] == pytest.approx(plain(plain(a, 1, taps, lambda v: v), 0, window.gaussian_taps(3, 1.0), lambda v: v), abs=1e-5)


def test_3x3_filter(spark, drawn):
    kernel = [1.0, -2.0, 0.5, 0.0, 5.0, -1.0, 0.25, 0.0, -1.0]
    got = arrays(window.filter3x3(relation(spark, drawn), kernel))
    for k, a in drawn.items():
        want = np.zeros(a.shape)
        for y in range(1, a.shape[0] - 1):
            for x in range(1, a.shape[1] - 1):
                v = sum(kernel[3 * i + j] * a[y + i - 1, x + j - 1] for i in range(3) for j in range(3)) / sum(kernel)
                want[y, x] = min(255, max(0, np.floor(round(v, 6))))
        assert (got[k] == want).all()


def test_constant_pictures_stay(spark):
    flat = {"a": np.full((9, 20), 77), "b": np.full((1, 3), 5)}
    for f in (lambda r: window.fast_blur(r, 5.0), lambda r: window.gaussian_blur(r, 2.0), lambda r: window.blur(r, 1.5)):
        got = arrays(f(relation(spark, flat)))
        assert all(abs(got[k] - flat[k]).max() <= 1 for k in flat)


@pytest.mark.parametrize(("before", "after"), [([[127, 127], [127, 127]], [[0, 255], [255, 0]]), ([[255]], [[255]]), ([[127] * 4], [[0, 255, 0, 255]]), ([[127]] * 4, [[0], [255], [0], [255]])])
def test_error_diffusion(spark, before, after):
    assert arrays(window.dither_bilevel(relation(spark, {"p": np.array(before)})))["p"].tolist() == after
