"""Fingerprints by locally consistent parsing: what they promise, and the query against a direct computation."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelry.llm import fingerprints as P
from pixelry.llm.queries import QUERIES
from pixelry.llm.textbuf import SpanHasher, mix
from tests.llm.samples import SCHEMA, awkward, frame, hashes, many_of_one_id, prose


def prints(*texts: str) -> list[str]:
    raw = [t.encode() for t in texts]
    return P.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def names(text: str) -> set[int]:
    raw = text.encode()
    return set(P.phrase_names(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_a_text_has_one_fingerprint_whatever_stands_beside_it(texts):
    assert prints(*texts) == [prints(t)[0] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=80))
def test_labels_are_few_and_differ_between_neighbours(values):
    x = np.array([v for i, v in enumerate(values) if i == 0 or v != values[i - 1]], np.uint64)
    labels = P._labels(x, np.array([0]))
    assert labels.max() < 8
    assert (labels[1:] != labels[:-1]).all()


def test_equal_substrings_share_interior_names_at_any_offset():
    body = prose(random.Random(1), 800)
    for shift in range(1, 8):
        moved = "#" * shift + "?" + body
        assert len(names(body) & names(moved)) >= 0.95 * len(names(body))


def test_likeness_follows_the_share_of_equal_text():
    rng = random.Random(2)
    a, b = prose(rng, 1500), prose(rng, 1500)
    two_thirds = a[: 2 * len(a) // 3] + b[: len(a) // 3]
    fa, fb, mixed = prints(a, b, two_thirds)
    assert P.likeness(fa, fa) == 1
    assert P.likeness(fa, fb) < 0.3
    assert P.likeness(fa, fb) < P.likeness(fa, mixed) < 1
    assert (P.likeness("", ""), P.likeness("", fa)) == (1, 0)


def bag(text: str) -> Counter:
    """Names of all phrases, with their numbers, by a plain walk over the text's symbols."""
    symbols: list = list(text.encode())
    levels: list[list] = []
    for level in range(1, P.LAST_LEVEL + 1):
        runs: list[tuple] = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1] = (x, runs[-1][1] + 1)
            else:
                runs.append((x, 1))
        if not runs:
            break
        mask = (1 << 64) - 1
        mixed = lambda v: int(mix(np.array([v & mask], np.uint64))[0])
        names_ = [x + (n << 8) if level == 1 else x if n == 1 else mixed(x + n * 0x9E3779B97F4A7C15) for x, n in runs]
        labels = [x for x, _ in runs] if level == 1 else list(names_)
        for _ in range(P.ROUNDS):
            tossed = []
            for i, x in enumerate(labels):
                low = 1 if i == 0 else (x ^ labels[i - 1]) & -(x ^ labels[i - 1])
                tossed.append(2 * (low.bit_length() - 1) + bool(x & low))
            labels = tossed
        begins = [i for i in range(len(labels)) if i == 0 or (i < len(labels) - 1 and labels[i - 1] > labels[i] < labels[i + 1])]
        phrases = [tuple(names_[a:b]) for a, b in zip(begins, [*begins[1:], len(names_)], strict=True)]
        symbols = [int(SpanHasher(np.array(p, np.uint64))(np.array([0]), np.array([len(p)]))[0]) for p in phrases]
        levels.append([(level, p) for p in symbols])
    used = [x for level in levels[P.FIRST_LEVEL - 1 :] for x in level]
    if len(levels) < P.FIRST_LEVEL or len(levels[P.FIRST_LEVEL - 1]) < 4:
        used += levels[P.FIRST_LEVEL - 2] if len(levels) >= P.FIRST_LEVEL - 1 else []
    return Counter(used)


def test_phrases_and_likeness_against_a_plain_parse():
    """The same bags of phrases, and likenesses near the exact Jaccard similarity of the bags."""
    rng = random.Random(5)
    errors = []
    for n in (0, 1, 3, 8, 20, 60, 300, 900, 2000):
        a = prose(rng, n) + "aaaa" * rng.randint(0, 3)
        words = a.split(" ")
        for k in range(0, len(words), rng.choice((3, 10, 40))):
            words[k] = rng.choice(words)
        x, y = bag(a), bag(" ".join(words))
        assert len(P.phrase_names(np.frombuffer(a.encode(), np.uint8), np.array([0, len(a.encode())]))[0]) == sum(x.values())
        exact = sum((x & y).values()) / max(sum((x | y).values()), 1) if x or y else 1.0
        errors.append(abs(P.likeness(*prints(a, " ".join(words))) - exact))
    assert max(errors) < 0.2
    assert sum(errors) / len(errors) < 0.07


def test_phrases_met_before_are_not_hashed_again(monkeypatch):
    """What is hashed item by item: the items of longer phrases, 0.63 a byte here, and hardly any runs of bytes, which are 0.97 a byte."""
    hashed = []

    class Counting(SpanHasher):
        def __init__(self, items):
            hashed.append(len(items))
            super().__init__(items)

    monkeypatch.setattr(P, "SpanHasher", Counting)
    text = prose(random.Random(3), 20_000)
    once = prints(text)
    hashed.clear()
    assert prints(text) == once
    assert sum(hashed) < 0.8 * len(text.encode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\0\x01\u00fc\u4e2d"), max_size=200), min_size=1, max_size=5))
def test_a_phrase_has_the_hash_of_its_runs_held_or_not(texts):
    class Tiny(P.PhraseCache):
        BITS = 2  # nearly all places are fought for

    cache = Tiny()
    for text in texts * 2:
        buf = np.frombuffer(text.encode(), np.uint8)
        if not len(buf):
            continue
        starts = np.flatnonzero(np.append(True, buf[1:] != buf[:-1]))
        begin = np.unique(np.append(0, np.arange(0, len(starts), 3)))
        items = buf[starts] + (np.diff(starts, append=len(buf)).astype(np.uint64) << np.uint64(8))
        want = SpanHasher(items)(begin, np.append(begin[1:], len(items)))
        assert cache(buf, starts, begin).tolist() == want.tolist()


def test_names_are_sorted_where_only_last_bits_differ():
    names_ = np.array([9, 8, 9, 8, 8, 1 << 60, 8], np.uint64)
    owner = np.array([0, 0, 0, 0, 6, 6, 6])
    got, whose = P._grouped(names_, owner, 7)
    assert (got.tolist(), whose.tolist()) == ([8, 8, 9, 9, 8, 8, 1 << 60], [0, 0, 0, 0, 6, 6, 6])


@pytest.mark.parametrize("block", [1, 50, 1 << 12])
def test_blocks_do_not_show(monkeypatch, block):
    rng = random.Random(4)
    texts = ["", "", *(prose(rng, rng.choice((0, 1, 3, 40, 300))) for _ in range(60)), "a" * 5000, ""]
    want = prints(*texts)
    monkeypatch.setattr(P, "BLOCK_BYTES", block)
    assert prints(*texts) == want


@pytest.mark.parametrize("per_range", [5, 2048])
def test_each_document_meets_the_next(spark, per_range):
    rows = awkward() + many_of_one_id()
    out = P.with_next(frame(spark, rows, {"range": "1", "fingerprint": "'x'", "next_text": "2"}), docs_per_range=per_range).collect()
    h = hashes(spark, [(0, r[1] or "") for r in rows])
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows), key=lambda r: (not r[0], -r[1], -h[r[2]]))
    want = sorted((r[1] if r[0] else -1, r[2], order[(i + 1) % len(order)][2]) for i, r in enumerate(order))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.next_text) for r in out) == want
    assert all(r.fingerprint == prints(r.text)[0] and r.next_fingerprint == prints(r.next_text)[0] for r in out)


def test_query(spark, tmp_path):
    rows = sorted({r[0]: r for r in awkward() if r[0] is not None}.values(), key=lambda r: -r[0])
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op7_phrase_fingerprints"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, row in enumerate(rows):
        text, following = row[1] or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        fp, fe, fn = prints(text, edited, following)
        r = got[row[0]]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, hashlib.sha256(edited.encode()).hexdigest(), fp, fe)
        assert (r.near_edited, r.near_next) == (P.likeness(fp, fe), P.likeness(fp, fn))


def test_one_row_and_none(spark):
    (only,) = P.with_next(spark.createDataFrame([(7, "alone", None, None, None)], SCHEMA)).collect()
    assert (only.text, only.next_text) == ("alone", "alone")
    assert P.with_next(spark.createDataFrame([], SCHEMA)).collect() == []
