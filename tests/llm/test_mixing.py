"""Raking against its targets, on the driver and in DataFrame operations, and the sampling."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pixelry.llm import mixing as M
from tests.llm.samples import SCHEMA, awkward, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n: int = 400) -> list[tuple]:
    rng = random.Random(6)
    return [(i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 5 + ["web", "books", None]), 0) for i in range(n)]


def test_raked_shares_meet_all_targets():
    rng = np.random.default_rng(1)
    codes = [c.ravel() for c in np.meshgrid(range(4), range(3), range(5), indexing="ij")]
    counts = rng.integers(1, 1000, 60).astype(float)
    shares = [rng.dirichlet(np.ones(k)) for k in (4, 3, 5)]
    raked = M.rake(counts, codes, shares)
    for code, share in zip(codes, shares, strict=True):
        assert np.bincount(code, raked) == pytest.approx(share, abs=1e-6)


def test_targets_that_cannot_be_met_are_warned_of():
    """The second source has cells of the first language only, and both are to have a share that rules this out."""
    codes, counts = [np.array([0, 0, 1]), np.array([0, 1, 0])], np.array([5.0, 5.0, 5.0])
    with pytest.warns(RuntimeWarning, match="not met"):
        M.rake(counts, codes, [np.array([0.2, 0.8]), np.array([0.3, 0.7])])


def plain_fit(rows: list[tuple], topics: list, budget: float) -> dict:
    """Probability of each cell (source, lang, topic): marginals fitted by plain loops, and the factor by bisection."""
    cells: dict[tuple, int] = {}
    for (_, text, lang, source, _), topic in zip(rows, topics, strict=True):
        cells[source, lang, topic] = cells.get((source, lang, topic), 0) + len(WORD.findall(text or ""))
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    for _ in range(300):
        for k, dim in enumerate(M.DIMENSIONS):
            tokens: dict = {}
            now: dict = {}
            for c, n in cells.items():
                tokens[c[k]] = tokens.get(c[k], 0) + n
                now[c[k]] = now.get(c[k], 0.0) + w[c]
            raw = {v: n ** M.EXPONENTS[dim] for v, n in tokens.items()}
            for c in w:
                w[c] *= raw[c[k]] / sum(raw.values()) / now[c[k]] if now[c[k]] else 0
    ratio = {c: w[c] * total / n if n else 0.0 for c, n in cells.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        f = (low + high) / 2
        low, high = (f, high) if sum(n * min(1, f * ratio[c]) for c, n in cells.items()) < budget * total else (low, f)
    return {c: min(1, low * r) for c, r in ratio.items()}


@pytest.mark.parametrize("cells", [M.CELLS_ON_DRIVER, 0])
def test_probabilities_against_a_plain_fit(spark, cells):
    rows = corpus(200)
    out = M.mix(frame(spark, rows), cells_on_driver=cells).collect()
    topics = {r.doc_id: r.topic for r in out}
    want = plain_fit(rows, [topics[r[0]] for r in rows], M.BUDGET)
    for r in out:
        assert r.probability == pytest.approx(want[r.source, r.lang, r.topic] if r.n_tokens else 0, abs=1e-6)
    taken = sum(r.n_tokens for r in out if r.sampled)
    assert taken == pytest.approx(M.BUDGET * sum(r.n_tokens for r in out), rel=0.1)


def test_scale_reaches_the_budget():
    rng = np.random.default_rng(2)
    ratio, counts = rng.random(30) * 5, rng.integers(1, 100, 30).astype(float)
    for share in (0.05, 0.5, 0.9):
        f = M.scale(ratio, counts, share * counts.sum())
        assert (counts * np.minimum(1, f * ratio)).sum() == pytest.approx(share * counts.sum())


def test_mixture(spark):
    rows = corpus() + awkward()
    clash = {f"cell_{c}": "7" for c in (*M.DIMENSIONS, "weight", "probability")}
    out = M.mix(frame(spark, rows, {"weight": "'x'", "sampled": "2", **clash})).collect()
    assert len(out) == len(rows)
    assert {tuple(r[c] for c in clash) for r in out} == {(7,) * 5}
    words = {}
    for r in rows:
        words.setdefault(r[0], set()).add(len(WORD.findall(r[1] or "")))
    assert all(r.n_tokens in words[r.doc_id] for r in out)
    assert all(not r.sampled and r.probability == 0 for r in out if r.n_tokens == 0)
    total = sum(r.n_tokens for r in out)
    assert sum(r.n_tokens * r.probability for r in out) == pytest.approx(M.BUDGET * total, rel=1e-6)
    for dim in M.DIMENSIONS:
        have: dict = {}
        for r in out:
            t, w = have.get(r[dim], (0, 0.0))
            have[r[dim]] = t + r.n_tokens, w + r.n_tokens * r.weight / total
        raw = {k: t ** M.EXPONENTS[dim] for k, (t, _) in have.items()}
        for k, (_, w) in have.items():
            assert w == pytest.approx(raw[k] / sum(raw.values()), abs=1e-6)
    again = {(r.doc_id, r.sampled) for r in M.mix(frame(spark, rows[::-1])).collect()}
    assert again == {(r.doc_id, r.sampled) for r in out}


def test_given_targets_and_topics(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, "en", ["a", "b", "c"][i % 3], 0) for i in range(300)]
    out = M.mix(frame(spark, rows), topic=F.lit("one"), targets={"source": {"a": 0.5, "b": 0.5}}, budget=0.4).collect()
    assert {round(r.probability, 9) for r in out if r.source == "c"} == {0.0}
    assert {round(r.probability, 9) for r in out if r.source in "ab"} == {0.6}


def test_distributed_raking_agrees(spark):
    rows = corpus(120)
    key = lambda r: (r.doc_id, r.source or "", r.lang or "")
    near = {key(r): (r.weight, r.probability) for r in M.mix(frame(spark, rows)).collect()}
    far = {key(r): (r.weight, r.probability) for r in M.mix(frame(spark, rows), cells_on_driver=0).collect()}
    assert near.keys() == far.keys()
    for k, v in near.items():
        assert far[k] == pytest.approx(v, rel=1e-6, abs=1e-9)


def test_empty_table_and_texts(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.sampled for r in M.mix(frame(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)])).collect()] == [False, False]
