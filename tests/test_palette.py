"""Palettes: k-d tree lookups against all distances, and the error of trained ones."""

from __future__ import annotations

import numpy as np
import pytest

from pixelry.operators import palette, point
from tests.test_tiles import arrays, drawn


@pytest.mark.parametrize("n, axes", [(0, 3), (1, 3), (5, 1), (17, 3), (300, 3), (3000, 4)])
def test_tree_against_all_distances(n, axes):
    rng = np.random.default_rng(n)
    colours, points = rng.integers(0, 40, (n, axes)), rng.integers(-5, 45, (400, axes))
    index = rng.permutation(n) + 7
    got = palette.Tree(colours, index).nearest(points)
    for p, g in zip(points, got, strict=True):
        assert g == (min(zip(((colours - p) ** 2).sum(1).tolist(), index.tolist(), strict=True))[1] if n else -1)


def test_long_palettes_and_empty_ones(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (30, 70, 3))
    r = drawn(spark, {"p": a}, space=("display-p3", "srgb"))
    colours = rng.integers(0, 256, (2000, 3))
    df = spark.createDataFrame([(5 * i, *map(int, c)) for i, c in enumerate(colours)], "idx int, c0 int, c1 int, c2 int")
    got = point.nearest_color(r, df)
    far = ((a[:, :, None, :] - colours[None, None]) ** 2).sum(-1)
    assert (arrays(got)["p"][:, :, 0] == 5 * far.argmin(-1)).all()
    assert got.space == ("unspecified", "unspecified")
    assert set(arrays(point.nearest_color(r, df.limit(0)))["p"].reshape(-1)) == {-1}


def error(a: np.ndarray, colours: np.ndarray) -> float:
    return float(((a.reshape(-1, 1, a.shape[-1]).astype(float) - colours[None]) ** 2).sum(-1).min(1).mean())


def test_training_of_many_pictures_in_one_plan(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 256, (12, 3))
    pictures = {
        "few": rng.integers(0, 2, (20, 20, 3)) * 9,  # eight colours, closer than the cells
        "clusters": np.clip(centres[rng.integers(0, 12, (80, 80))] + rng.integers(-6, 7, (80, 80, 3)), 0, 255),
        "noise": rng.integers(0, 256, (70, 90, 3)),
        "ramp": np.stack([np.tile(np.arange(100), (50, 1)) * 2, np.tile(np.arange(50)[:, None], (1, 100)) * 5, np.full((50, 100), 7)], -1),
        "one": np.full((3, 3, 3), 200),
    }
    rows = palette.train(drawn(spark, pictures), 16).collect()
    found = {k: np.array([(r.c0, r.c1, r.c2) for r in sorted(rows, key=lambda r: r.idx) if r.picture_id == k]) for k in pictures}
    assert all(1 <= len(v) <= 16 for v in found.values())
    assert error(pictures["few"], found["few"]) == 0
    assert found["one"].tolist() == [[200, 200, 200]]
    for k in ("clusters", "noise", "ramp"):
        flat = pictures[k].reshape(-1, 3).astype(float)
        best = np.inf  # k-means from several random starts, over all pixels
        for seed in range(4):
            c = flat[np.random.default_rng(seed).choice(len(flat), 16, replace=False)]
            for _ in range(25):
                own = ((flat[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                c = np.array([flat[own == i].mean(0) if (own == i).any() else c[i] for i in range(16)])
            best = min(best, error(pictures[k], c))
        assert error(pictures[k], found[k]) <= 1.25 * best + 1


def test_reduced_pictures_use_their_own_palette(spark):
    rng = np.random.default_rng(3)
    pictures = {f"p{i}": rng.integers(0, 256, (70, 65, 4)) for i in range(3)}
    r = drawn(spark, pictures, "Rgba", space=("display-p3", "srgb"))
    palettes = palette.train(r, 8)
    rows = palettes.collect()
    out = palette.reduce_colors(r, 8)
    assert (out.layout, out.space) == ("Rgba", ("display-p3", "srgb"))
    got = arrays(out)
    for k, a in pictures.items():
        colours = np.array([(x.c0, x.c1, x.c2, x.c3) for x in sorted(rows, key=lambda x: x.idx) if x.picture_id == k])
        assert (got[k] == colours[((a[:, :, None] - colours[None, None]) ** 2).sum(-1).argmin(-1)]).all()
    alone = palette.index_of(r, palettes.where("picture_id <> 'p1'"))
    assert set(arrays(alone)["p1"].reshape(-1)) == {-1}


def test_limits_of_training(spark):
    r = drawn(spark, {"p": np.zeros((1, 1, 3), int)})
    for n in (0, 257):
        with pytest.raises(ValueError):
            palette.train(r, n)
    assert palette.train(r.where("false"), 4).collect() == []
