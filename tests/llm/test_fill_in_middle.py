"""Fill-in-the-middle against cutting the list of all units."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelry.llm import fill_in_middle
from tests.llm.samples import awkward, frame, many_of_one_id


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["<P>", "a<S>b", "<", "<P", "P><S", "ab<" * 40, "x" * 5000, "é" * 3000, "a1" * 4000, "\n\r\x00\t", "日本語 text 😀 more", "S>" * 30, "<M", "word " * 30_000, "z" * 300_000 + "é1"]


def check(spark, rows, clash=None):
    df = fill_in_middle.transform(frame(spark, rows, clash))
    got = [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in df.withColumn("back", fill_in_middle.restore(df.output, df.form)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    want = [(r[0], r[1], *plain(r[0], r[1]), r[1] or "") for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    return {r[3] for r in got}


def test_against_the_list_of_units(spark):
    rows = awkward() + [(5000 + 7 * i + j, t, "en", "web", 0) for i, t in enumerate(ODD) for j in range(7)]
    assert check(spark, rows, {"form": "1", "N": "'x'", "_h0": "2", "output": "null"}) == {"plain", "psm", "spm"}


def test_one_id_and_empty_table(spark):
    check(spark, many_of_one_id())
    check(spark, [])


@pytest.mark.parametrize("every, window", [(1, 1), (2, 3), (3, 7), (256, 1 << 17)])
def test_checkpoints_of_any_spacing(every, window):
    rng = random.Random(every)
    texts = ["".join(rng.choice(["a", "Z", "é", " ", "😀", "<"]) for _ in range(rng.choice([0, 0, 1, 5, 60]))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    index = fill_in_middle.Checkpoints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), every, window)
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t, re.S) for t in texts]
    assert index.n.tolist() == [len(u) for u in units]
    for k in range(61):
        at = np.array([min(k, len(u)) for u in units])
        byte, char = index.find(np.arange(40), at)
        heads = ["".join(u[:m]) for u, m in zip(units, at, strict=True)]
        assert char.tolist() == [len(h) for h in heads]
        assert (byte - index.offs[:-1]).tolist() == [len(h.encode()) for h in heads]
    assert len(index.units) <= sum(map(len, units)) // every + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6), st.integers(1, 5), st.integers(1, 9))
def test_any_texts(texts, every, window):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    texts = [b.decode() for b in raw]
    index = fill_in_middle.Checkpoints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), every, window)
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t, re.S) for t in texts]
    assert index.n.tolist() == [len(u) for u in units]
    half = np.array([len(u) // 2 for u in units], np.int64)
    assert index.find(np.arange(len(texts)), half)[1].tolist() == [len("".join(u[: len(u) // 2])) for u in units]
