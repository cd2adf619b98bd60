"""Cross-polytope search against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pixelry.llm import cross_polytope, textbuf

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10, every=100):
    """query id -> list of (id, distance), of rows that take part, without repeated rows."""
    kept = sorted({(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    if not kept:
        return {}
    x = np.array([v for _, v in kept], np.float32).astype(np.float64)
    ids = np.array([i for i, _ in kept])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), d[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    """Share of true neighbours found; results must be exact distances, nearest first."""
    hits = total = 0
    for q, near in want.items():
        assert len(got.get(q, [])) == len(near)
        assert got.get(q, []) == sorted(got.get(q, []), key=lambda x: (x[1], x[0]))
        hits += len({i for i, _ in near} & {i for i, _ in got.get(q, [])})
        total += len(near)
        lengths = dict(near)
        assert all(abs(lengths[i] - s) < 1e-12 for i, s in got.get(q, []) if i in lengths)
    return hits / total if total else 1.0


def sphere(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_recall_without_structure(spark):
    """Evenly spread unit vectors, the hardest case: neighbours are hardly nearer than others."""
    x = sphere(np.random.default_rng(1), 6000)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    assert recall(found(cross_polytope.search(table(spark, rows))), brute(rows)) >= 0.9


def test_recall_in_a_group_of_near_copies(spark, monkeypatch):
    """A third of all rows close together: their buckets are hashed again by differences."""
    monkeypatch.setattr(cross_polytope, "CROWD", 256)
    rng = np.random.default_rng(2)
    x = sphere(rng, 6000)
    x[::3] = x[0] + 0.05 * sphere(rng, 2000)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    assert recall(found(cross_polytope.search(table(spark, rows))), brute(rows)) >= 0.9


def test_exact_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    x = sphere(rng, 900)
    rows = [(i, (x[0] if i % 3 == 0 else x[i]).tolist(), 0) for i in range(900)]  # a third of the rows has one vector
    rows += [(5000 + i, [float(j == i % 64) for j in range(64)], 0) for i in range(1, 200)]  # equal distances
    got, want = found(cross_polytope.search(table(spark, rows))), brute(rows)
    assert got[300] == want[300] == [(i, 0.0) for i in range(0, 30, 3)]
    assert recall(got, want) >= 0.9


def test_blocks_of_what_stays_crowded(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "CROWD", 16)
    monkeypatch.setattr(cross_polytope, "ROUNDS", 1)
    monkeypatch.setattr(cross_polytope, "HELD", 500)
    monkeypatch.setattr(textbuf, "BROADCAST_ROWS", 0)
    x = sphere(np.random.default_rng(4), 1500, 20)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    assert recall(found(cross_polytope.search(table(spark, rows))), brute(rows)) >= 0.9


def test_odd_rows(spark):
    x = sphere(np.random.default_rng(5), 300, 10) * 3
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [rows[100], rows[100], (1000, None, 1), (1100, [], 1), (1200, [0.0] * 10, 1), (1300, [1.0] * 9 + [None], 1), (1400, [1.0] * 9 + [float("nan")], 1), (1500, [1.0] * 9 + [float("inf")], 1), (None, [1.0] * 10, 1)]
    df = table(spark, rows).selectExpr("*", "1 AS id", "2 AS v", "'x' AS rank", "null AS score")
    got, want = found(cross_polytope.search(df)), brute(rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    other = [*rows, (1600, [1.0] * 9, 1), (1700, [1.0] * 11, 1)]
    assert found(cross_polytope.search(table(spark, other))).keys() == want.keys()


@pytest.mark.parametrize("n", [0, 1, 2, 5, 11, 12, 70])
def test_few_rows(spark, n):
    rows = [(100 * i, v.tolist(), 0) for i, v in enumerate(sphere(np.random.default_rng(n), n, 3))]
    got, want = found(cross_polytope.search(table(spark, rows))), brute(rows)
    assert got.keys() == {q for q in want if want[q]}
    assert recall(got, want) >= 0.9


def test_queries_that_meet_too_few_points_meet_all(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "fitted_probes", lambda *_: 1)
    x = sphere(np.random.default_rng(6), 400, 8)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    recall(found(cross_polytope.search(table(spark, rows), tables=1)), brute(rows))  # ten rows for each query


def test_one_id_with_different_vectors(spark):
    x = sphere(np.random.default_rng(7), 60, 4)
    rows = [(i // 2 * 10, v.tolist(), 0) for i, v in enumerate(x)]
    got = cross_polytope.search(table(spark, rows)).collect()
    assert {r.query_id for r in got} == {0, 100, 200}
    assert all(r.vec_id != r.query_id for r in got)


def test_double_vectors_of_any_size(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) * 1e200
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(cross_polytope.search(df))
    assert got.keys() == {0, 100, 200}
    d = np.linalg.norm((x - x[100]) / 1e200, axis=1)
    assert [i for i, _ in got[100]] == [int(i) for i in np.argsort(d)[1:11]]


def test_pseudo_rotations_keep_lengths_and_angles():
    x = sphere(np.random.default_rng(9), 50, 48)
    y = cross_polytope.rotated(x, 1, 2)
    assert y.shape == (50, 64)
    assert np.allclose(y @ y.T, x @ x.T, atol=1e-5)


def test_first_probe_is_the_own_bucket_and_probes_are_distinct():
    x = cross_polytope.unit(sphere(np.random.default_rng(10), 40))
    for bits in (0, 1, 5, 7, 9, 12):
        at = cross_polytope.probes(x, bits, 1 << bits, 3)
        assert (at[:, 0] == cross_polytope.codes(x, bits, 3)).all()
        assert (np.sort(at, 1) == np.arange(1 << bits)).all()
        few = cross_polytope.probes(x, bits, 10, 3)
        assert (few == at[:, :10]).mean() > 0.99
