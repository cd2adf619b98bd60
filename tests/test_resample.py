"""Resampling of whole pictures against direct computations."""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelry import catalog
from pixelry.operators import resample
from pixelry.plans.raster import Raster

DATA = "/root/testdata/sf0.01"
SIZES = {"resize_triangle": (40, 60), "resize_catmull_rom": (40, 60), "resize_gaussian": (40, 60), "resize_lanczos3": (40, 60), "enlarge_triangle": (150, 170)}


@pytest.fixture(scope="module")
def picture() -> np.ndarray:
    """The 100 by 100 events picture, as rows of columns of channels."""
    rows = duckdb.sql(f"SELECT ((floor(value) % 256) + 256) % 256, user_id % 256, event_id * 13 % 256 FROM '{DATA}/events.parquet' ORDER BY event_id").fetchall()
    return np.array(rows, float).reshape(100, 100, 3)


def _cubic(t: float) -> float:
    a = abs(t)
    return 1.5 * a**3 - 2.5 * a * a + 1 if a < 1 else -0.5 * a**3 + 2.5 * a * a - 4 * a + 2 if a < 2 else 0.0


KERNELS = {
    "triangle": (lambda t: max(0.0, 1 - abs(t)), 1),
    "catmull_rom": (_cubic, 2),
    "gaussian": (lambda t: float(np.exp(-2 * t * t)), 3),
    "lanczos3": (lambda t: float(np.sinc(t) * np.sinc(t / 3)) if abs(t) < 3 else 0.0, 3),
}


def matrix(size: int, new_size: int, name: str) -> np.ndarray:
    if size == new_size:
        return np.eye(size)
    kernel, support = KERNELS[name]
    ratio = size / new_size
    spread = max(ratio, 1.0)
    out = np.zeros((new_size, size))
    for o in range(new_size):
        centre = (o + 0.5) * ratio
        low = min(max(int(np.floor(centre - support * spread)), 0), size - 1)
        high = min(max(int(np.ceil(centre + support * spread)), low + 1), size)
        out[o, low:high] = [kernel((i + 0.5 - centre) / spread) for i in range(low, high)]
    return out / out.sum(1, keepdims=True)


def rounded(a: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.round(a, 6) + 0.5), 0, 255).astype(int)


def as_array(df, shape: tuple[int, int]) -> np.ndarray:
    out = np.full((*shape, 3), -1)
    rows = df.collect()
    for r in rows:
        out[r.y, r.x] = r.c0, r.c1, r.c2
    assert len(rows) == shape[0] * shape[1]
    return out


@pytest.mark.parametrize("name", SIZES)
def test_resize_of_the_whole_raster(spark, picture, name):
    w, h = SIZES[name]
    kind = name.split("_", 1)[1]
    want = np.einsum("oy,yxc,px->opc", matrix(100, h, kind), picture, matrix(100, w, kind))
    assert (as_array(catalog.QUERIES[name](spark, DATA), (h, w)) == rounded(want)).all()


def test_nearest_of_the_whole_raster(spark, picture):
    ys, xs = ((np.floor((np.arange(m) + 0.5) * 100 / m)).astype(int) for m in (250, 30))
    assert (as_array(catalog.QUERIES["resize_nearest"](spark, DATA), (250, 30)) == picture[ys][:, xs]).all()


@pytest.mark.parametrize("name", ["resize_nearest", "resize_nearest_whole"])
def test_nearest_of_a_tall_raster(spark, tmp_path, name):
    """Ten lines of a picture so tall that a line times the new height exceeds 32 bits, against the SQL."""
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT * REPLACE (event_id // 100 * 666_600 + event_id % 100 AS event_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert max(want, key=lambda r: r[1])[1] > 140_000


def test_nearest_places_at_the_largest_sizes(spark):
    top = 2**31 - 1
    cases = [(at, size, new) for size, new in ((top, top), (top, top - 1), (3, 7), (7, 3), (1, 5), (5, 1), (2, 0), (0, 4)) for at in {0, 1, size // 2, size - 1, size} if at >= 0]
    df = spark.createDataFrame(cases, "at int, size int, new int")
    for r in df.withColumn("places", resample.nearest_places(F.col("at"), F.col("size"), F.col("new"))).collect():
        near = range(max(0, r.at * r.new // r.size - 2), min(r.new, (r.at + 1) * r.new // r.size + 2)) if r.at < r.size else []
        assert (r.places or []) == [o for o in near if (2 * o + 1) * r.size // (2 * r.new) == r.at]


def relation(spark, drawn: dict[str, np.ndarray], layout: str = "L", kind: str = "u8") -> Raster:
    """Pictures of any sizes as pixels; arrays of lines of columns of channels."""
    rows = [(name, a.shape[1], a.shape[0], x, y, *a[y, x].tolist()) for name, a in drawn.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    names = ", ".join(f"c{i} {'int' if kind != 'f32' else 'float'}" for i in range(next(iter(drawn.values())).shape[2]))
    return Raster(spark.createDataFrame(rows, f"picture_id string, w int, h int, x int, y int, {names}"), layout, kind)


@pytest.mark.parametrize("name", [*KERNELS, "nearest"])
def test_resize_of_mixed_sizes(spark, name):
    """No picture is lost, whatever its size, and each axis may shrink, grow or stay."""
    rng = np.random.default_rng(8)
    drawn = {f"p{w}x{h}": rng.integers(0, 256, (h, w, 1)) for w, h in [(1, 1), (4, 4), (10, 4), (4, 10), (10, 10), (23, 3), (1, 30)]}
    got = resample.resize_exact(relation(spark, drawn), 10, 7, name).pixels.collect()
    found = {(r.picture_id, r.x, r.y): r.c0 for r in got}
    assert len(found) == len(got) == 70 * len(drawn)
    assert {(r.w, r.h) for r in got} == {(10, 7)}
    for k, a in drawn.items():
        h, w, _ = a.shape
        if name == "nearest":
            want = a[[int((o + 0.5) * h / 7) for o in range(7)]][:, [int((o + 0.5) * w / 10) for o in range(10)], 0]
        else:
            want = rounded(matrix(h, 7, name) @ a[:, :, 0] @ matrix(w, 10, name).T)
        assert {(x, y): found[k, x, y] for x in range(10) for y in range(7)} == {(x, y): want[y, x] for x in range(10) for y in range(7)}


def test_sizes_that_fit_and_fill(spark):
    drawn = {f"p{w}x{h}": np.full((h, w, 1), 9) for w, h in [(1, 1), (8, 4), (4, 8), (3, 3)]}
    r = relation(spark, drawn)
    assert {(p.picture_id, p.w, p.h, n) for p, n in _sizes(resample.resize(r, 6, 6))} == {("p1x1", 6, 6, 36), ("p8x4", 6, 3, 18), ("p4x8", 3, 6, 18), ("p3x3", 6, 6, 36)}
    assert {(p.picture_id, p.w, p.h, n) for p, n in _sizes(resample.resize_to_fill(r, 6, 2))} == {(k, 6, 2, 12) for k in drawn}
    assert {(p.picture_id, p.w, p.h, n) for p, n in _sizes(resample.thumbnail(r, 2, 2))} == {("p1x1", 2, 2, 4), ("p8x4", 2, 1, 2), ("p4x8", 1, 2, 2), ("p3x3", 2, 2, 4)}


def _sizes(r: Raster):
    return [(x, x["count"]) for x in r.pixels.groupBy("picture_id", "w", "h").count().collect()]


def test_points_that_repeat_a_key(spark):
    r = relation(spark, {"p": np.array([[[10], [20]]])})
    points = spark.createDataFrame([("p", 1, 0.5), ("p", 1, 0.5), ("p", 1, 9.0), ("q", 1, 0.5)], "picture_id string, probe int, at double")
    got = resample.interpolate_bilinear(points, r, F.col("at"), F.lit(0.0)).collect()
    assert sorted((x.picture_id, x["at"], x.c0 or -1) for x in got) == [("p", 0.5, 15), ("p", 0.5, 15), ("p", 9.0, -1), ("q", 0.5, -1)]


def test_sampling_at_known_places(spark):
    """One hot channel in each corner of a 2 by 2 picture."""
    corners = np.zeros((2, 2, 4), int)
    corners[0, 0, 0] = corners[0, 1, 1] = corners[1, 0, 2] = corners[1, 1, 3] = 255
    r = relation(spark, {"p": corners}, "Rgba")
    points = spark.createDataFrame([("p", 0.5, 0.5), ("p", 0.5, 0.0), ("p", 1.5, 0.0), ("p", 0.5, -0.1)], "picture_id string, u double, v double")
    got = {(x.u, x.v): (x.c0, x.c1, x.c2, x.c3) for x in resample.sample_bilinear(points, r, F.col("u"), F.col("v")).collect()}
    assert got == {(0.5, 0.5): (64, 64, 64, 64), (0.5, 0.0): (128, 128, 0, 0), (1.5, 0.0): (None,) * 4, (0.5, -0.1): (None,) * 4}


@pytest.mark.parametrize("name", ["sample_nearest", "sample_bilinear"])
def test_probes_of_all_events(spark, picture, name):
    got = {r.probe: (r.c0, r.c1, r.c2) for r in catalog.QUERIES[name](spark, DATA).collect()}
    assert got.keys() == set(range(10_000))
    for k, found in got.items():
        u, v = k * 37 % 1001 / 1000, k * 91 % 1003 / 1000
        if v > 1:
            assert found == (None, None, None)
            continue
        x, y = (max(0.0, min(99.0, q * 100 - 0.5)) for q in (u, v))
        if name == "sample_nearest":
            want = picture[int(y + 0.5), int(x + 0.5)]
        else:
            (i, p), (j, q) = ((int(a), a - int(a)) for a in (x, y))
            at = lambda b, a: picture[min(b, 99), min(a, 99)]
            want = rounded((1 - q) * ((1 - p) * at(j, i) + p * at(j, i + 1)) + q * ((1 - p) * at(j + 1, i) + p * at(j + 1, i + 1)))
        assert tuple(want) == found


def window_of(o: int, size: int, n: int) -> dict[int, Fraction]:
    """Shares of the pixels of one axis in window o, case by case."""
    a, b = Fraction(o * size, n), Fraction((o + 1) * size, n)
    left = min(ceil(a), size - 1)
    right = max(left, min(ceil(b), size))
    if left < right:
        return {i: Fraction(1, right - left) for i in range(left, right)}
    f = (a % 1 + b % 1) / 2
    return {right - 1: 1 - f, right: f}


@pytest.mark.parametrize("kind", ["u8", "f32"])
@pytest.mark.parametrize("target", [(7, 5), (7, 2), (2, 9), (3, 3), (1, 1)])
def test_thumbnails_of_mixed_sizes(spark, target, kind):
    rng, rows, want = np.random.default_rng(3), [], {}
    for k, (w, h) in enumerate([(1, 1), (2, 3), (3, 2), (5, 8), (9, 4), (7, 5), (20, 11), (1, 30)]):
        drawn = rng.integers(0, 256, (h, w))
        rows += [(f"i{k}", w, h, x, y, (int if kind == "u8" else float)(drawn[y, x])) for y in range(h) for x in range(w)]
        for oy in range(target[1]):
            for ox in range(target[0]):
                v = sum(p * q * int(drawn[y, x]) for y, p in window_of(oy, h, target[1]).items() for x, q in window_of(ox, w, target[0]).items())
                want[f"i{k}", ox, oy] = floor(v + Fraction(1, 2)) if kind == "u8" else float(v)
    pixels = spark.createDataFrame(rows, f"picture_id string, w int, h int, x int, y int, c0 {'int' if kind == 'u8' else 'float'}")
    got = resample.thumbnail_exact(Raster(pixels, "L", kind), *target).pixels.collect()
    assert len(got) == len(want)
    assert {(r.w, r.h) for r in got} == {target}
    assert {(r.picture_id, r.x, r.y): r.c0 for r in got} == pytest.approx(want, rel=1e-6)
