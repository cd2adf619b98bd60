"""The similarity join against all pairs of sets."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from pixelry.llm import jaccard_join as J
from pixelry.llm import textbuf
from pixelry.llm.components import connected_components
from tests.llm.samples import SCHEMA, awkward, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows: list[tuple]) -> Counter:
    """doc_id, n_shingles, component and number of links of every row, from all pairs of sets."""
    sets = {i: shingles(r[1]) for i, r in enumerate(rows)}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    seen: dict[frozenset, int] = {}
    for i, s in sets.items():
        if s and s in seen:
            up[top(i)] = top(seen[s])
        elif s:
            for t, j in seen.items():
                both = len(s & t)
                if 100 * both >= 75 * (len(s) + len(t) - both):
                    up[top(i)] = top(j)
            seen[s] = i
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    classes = Counter(s for s in sets.values() if s)
    links = {s: sum(n for t, n in classes.items() if 100 * len(s & t) >= 75 * len(s | t)) - 1 for s in classes}
    return Counter((r[0], len(sets[i]), least.get(top(i)) if sets[i] else r[0], links.get(sets[i], 0)) for i, r in enumerate(rows))


def found(df) -> Counter:
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect())


def test_awkward_rows(spark):
    rows = awkward()
    df = frame(spark, rows, {"node": "1", "n": "'x'", "part": "2", "component_id": "7", "sig": "3"})
    assert found(J.near_duplicates(df, sketch_bits=16)) == brute(rows)


def test_threshold_is_exact(spark):
    line = "a b c d e f g h i j k"  # 7 shingles; a changed last word leaves 6 of 8
    rows = [(1, line), (2, line[:-1] + "z"), (3, "y" + line[1:-1] + "q"), (4, "A B C D E"), (5, "a b c d e"), (6, "a b c d"), (7, "a  b\tc\nd")]
    rows = [(i, t, None, None, None) for i, t in rows]
    got = found(J.near_duplicates(frame(spark, rows), sketch_bits=16))
    assert got == brute(rows)
    assert (2, 7, 1, 1) in got
    assert (5, 1, 4, 1) in got
    assert (7, 1, 6, 1) in got


@pytest.mark.parametrize("cut", [False, True])
def test_large_families_of_near_copies(spark, monkeypatch, cut):
    """cut: in several levels of runs, with lists dealt out by groups, and without broadcasts."""
    if cut:
        monkeypatch.setattr(J, "RUN", 16)
        monkeypatch.setattr(J, "LONG_LIST", 12)
        monkeypatch.setattr(J, "PART_BLOCK", 20)
        monkeypatch.setattr(textbuf, "BROADCAST_ROWS", 0)
    rng = random.Random(3)
    rows = []
    for family in range(3):
        words = prose(rng, 120).split()
        for i in range(60):
            w = list(words)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 300)}"
            rows.append((1000 * family + i, " ".join(w), None, None, None))
    rng.shuffle(rows)
    assert found(J.near_duplicates(frame(spark, rows), sketch_bits=16)) == brute(rows)


def test_links_need_not_be_counted(spark):
    rows = awkward()
    got = J.near_duplicates(frame(spark, rows), sketch_bits=16, links=False)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_copies"]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(x[:3] for x in brute(rows).elements())


@pytest.mark.parametrize("tied", [True, False])
def test_list_pairs_lose_no_link(tied):
    """Blocks skipped by position and part leave every pair that could reach the overlap."""
    rng = np.random.default_rng(5)
    m = 400
    n = rng.integers(5, 60, m)
    position = (rng.random(m) * J.prefix_length(n)).astype(np.int64)
    h = np.sort(rng.integers(0, 3 if tied else 40, m).astype(np.uint64))
    group = rng.integers(0, 50, m)
    order = np.lexsort((position, group, h))
    n, position, h, group = n[order], position[order], h[order], group[order]
    i, j = J.list_pairs(np.arange(m), group, n, h, position)
    got = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
    want = {
        (a, b)
        for a in range(m)
        for b in range(a + 1, m)
        if h[a] == h[b] and group[a] != group[b] and 7 * min(n[a] - position[a], n[b] - position[b]) >= 3 * (n[a] + n[b])
    }
    assert got == want


def test_empty_table(spark):
    assert J.near_duplicates(spark.createDataFrame([], SCHEMA), sketch_bits=16).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, x) for x in range(1001, 1400)] + [(5000, 5000), (None, 3), (7, 6), (6, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(1000, 1400), 1000), 5000: 5000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
