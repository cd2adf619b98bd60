"""Composition of frames, dithering in blocks and budgets of frames against plain loops."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelry.operators import frames, window
from pixelry.plans import tiles
from tests.test_tiles import arrays, drawn

SHAPE = "picture_id string, frame_no int, w int, h int, left int, top int, width int, height int, dispose string, blend string"
PIXELS = "picture_id string, frame_no int, x int, y int, c0 int, c1 int, c2 int, c3 int"


def over(u, o):
    if o[3] in (0, 255):
        return u if o[3] == 0 else o
    ua, oa = u[3] / 255, o[3] / 255
    alpha = ua + oa - ua * oa
    return [*(int(np.floor(round((o[i] / 255 * oa + u[i] / 255 * ua * (1 - oa)) / alpha * 255, 6) + 0.5)) for i in range(3)), int(np.floor(round(alpha * 255, 6) + 0.5))]


def plain(shapes, pixels, blended):
    """(picture, frame, x, y) -> colour, place by place."""
    colour = {(p, f, x, y): list(c) for p, f, x, y, *c in pixels}
    out = {}
    for picture in {s[0] for s in shapes}:
        own = sorted((s for s in shapes if s[0] == picture), key=lambda s: s[1])
        for x in range(own[0][2]):
            for y in range(own[0][3]):
                now = before = [0] * 4
                region, last = False, "background"
                for _, f, _, _, left, top, width, height, dispose, blend in own:
                    inside = left <= x < left + width and top <= y < top + height
                    c = colour.get((picture, f, x - left, y - top), [0] * 4)
                    if blended:
                        undone = before if region and last == "previous" else [0] * 4 if region and last == "background" else now
                        before = before if last == "previous" else now
                        shown = undone if not inside else over(undone, c) if blend == "over" else c
                        now, region, last = shown, inside, dispose
                    else:
                        shown = c if inside and c[3] > 0 else now
                        now = now if not inside or dispose == "previous" else [0] * 4 if dispose == "background" else shown
                    out[picture, f, x, y] = tuple(shown)
    return out


def animation(seed, n, sizes=((70, 5), (3, 66))):
    rng = random.Random(seed)
    shapes, pixels = [], []
    for i, (w, h) in enumerate(sizes):
        for f in range(n):
            width, height = rng.randint(1, w), rng.randint(1, h)
            left, top = rng.randint(0, w - width), rng.randint(0, h - height)
            shapes.append((f"p{i}", 3 * f, w, h, left, top, width, height, rng.choice(["keep", "background", "previous", None]), rng.choice(["source", "over", None])))
            pixels += [(f"p{i}", 3 * f, x, y, *(rng.randrange(256) for _ in range(3)), rng.choice([0, 100, 255])) for x in range(width + 2) for y in range(height) if rng.random() < 0.8]
    return shapes, pixels


@pytest.mark.parametrize("blended", [False, True])
def test_composition(spark, blended):
    shapes, pixels = animation(1, 9)
    f = frames.compose_blended if blended else frames.compose_transparent
    got = f(spark.createDataFrame(shapes, SHAPE).repartition(3), spark.createDataFrame(pixels, PIXELS).repartition(3)).collect()
    assert {(r.picture_id, r.frame_no, r.x, r.y): (r.c0, r.c1, r.c2, r.c3) for r in got} == plain(shapes, pixels, blended)
    assert len(got) == 9 * (70 * 5 + 3 * 66)


def test_repeated_pixels_and_empty_animations(spark):
    shapes = [("p", 0, 2, 1, 0, 0, 2, 1, "keep", "source")]
    pixels = [("p", 0, 0, 0, 1, 2, 3, 255), ("p", 0, 0, 0, 1, 2, 3, 255), ("p", 7, 0, 0, 9, 9, 9, 255), ("p", 0, 5, 5, 9, 9, 9, 255), ("q", 0, 0, 0, 1, 1, 1, 1)]
    got = frames.compose_transparent(spark.createDataFrame(shapes, SHAPE), spark.createDataFrame(pixels, PIXELS)).collect()
    assert sorted((r.x, r.c0, r.c3) for r in got) == [(0, 1, 255), (1, 0, 0)]
    assert frames.compose_blended(spark.createDataFrame([], SHAPE), spark.createDataFrame(pixels, PIXELS)).collect() == []


def test_time_is_linear_in_frames(spark):
    def seconds(n):
        shapes = spark.range(n).selectExpr("'p' picture_id", "cast(id as int) frame_no", "16 w", "16 h", "0 left", "0 top", "16 width", "16 height", "element_at(array('keep','previous'), cast(id % 2 + 1 as int)) dispose", "'over' blend")
        pixels = spark.range(n * 256).selectExpr("'p' picture_id", "cast(id div 256 as int) frame_no", "cast(id % 16 as int) x", "cast(id div 16 % 16 as int) y", *(f"cast((id * {k}) % 256 as int) c{i}" for i, k in enumerate((3, 5, 7, 11))))
        began = time.perf_counter()
        frames.compose_blended(shapes, pixels).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(10)
    short, long = seconds(400), seconds(3200)
    assert long < 8 * 1.5 * short


def test_delays_of_nulls(spark):
    rows = spark.createDataFrame([(None,), (-1,), (1_500_000,), ((1 << 53) + 1,)], "n long").select(frames.saturating_delay(F.col("n")).alias("d")).collect()
    assert rows[0].d is None and rows[1].d is None
    assert tuple(rows[2].d) == (3, 2)


@pytest.mark.parametrize("free", [False, True])
def test_budget(spark, free):
    rng = random.Random(4)
    shapes = [(f"p{i}", f, 10, 10, 0, 0, rng.choice([1, 5, 10]), rng.choice([2, 10]), "keep", "over") for i in range(20) for f in range(8)]
    got = {(r.picture_id, r.frame_no): (int(r.reserved), r.fits, r.error) for r in frames.within_budget(spark.createDataFrame(shapes, SHAPE), 1700, free=free).collect()}
    for i in range(20):
        total, late = 800, False
        for s in sorted((s for s in shapes if s[0] == f"p{i}"), key=lambda s: s[1]):
            total = (800 if free else total) + 4 * s[6] * s[7]
            first = total > 1700 and not late
            late |= total > 1700
            assert got[s[0], s[1]] == (total, not late, "limits" if first else None)


def plain_dither(a):
    v, (h, w) = a.astype(int).copy(), a.shape
    for y in range(h):
        for x in range(w):
            old = v[y, x]
            v[y, x] = 255 if old > 127 else 0
            for dx, dy, part in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                if 0 <= x + dx < w and y + dy < h:
                    v[y + dy, x + dx] = min(255, max(0, v[y + dy, x + dx] + int((old - v[y, x]) * part / 16)))
    return v


@pytest.mark.parametrize("block", [1, 3, 16, 512])
def test_dither_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    sizes = [(1, 1), (1, 4), (4, 1), (9, 7)] if block == 1 else [(1, 1), (1, 30), (30, 1), (40, 33), (17, 50)]
    pictures = {f"p{i}": rng.integers(0, 256, (h, w, 1)) for i, (w, h) in enumerate(sizes)}
    if block == 3:
        pictures = {k: a[:12, :12] for k, a in pictures.items()}
    got = window.dither_bilevel(drawn(spark, pictures, "L", space=("display-p3", "srgb")), block)
    assert got.space == ("display-p3", "srgb")
    found = arrays(got)
    for k, a in pictures.items():
        assert (found[k][:, :, 0] == plain_dither(a[:, :, 0])).all()


def test_dither_of_nothing(spark):
    assert window.dither_bilevel(drawn(spark, {"p": np.zeros((1, 1, 1), int)}, "L").where("false")).pixels.count() == 0
    assert tiles.TILE <= window.DITHER_BLOCK
