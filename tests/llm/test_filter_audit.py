"""The filter audit against applying every order to every document."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from pixelry.llm import filter_audit, textbuf
from tests.llm.samples import awkward, frame, many_of_one_id

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[1]]
                out[part, "".join(order), step] = [len(left) - len(hit), len(hit), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in left + gone), sum(d[2] for d in hit), sum(d[3] for d in hit)]
                shapley[f] += len(hit)
                gone += hit
                left = [d for d in left if f not in d[1]]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def found(df):
    return {(r["part"], r.filter_order, r.step): [r[c] for c in filter_audit.OUTCOMES] for r in df.collect()}


def rows_and_labels():
    rng = random.Random(3)
    rows = awkward() + [(1000 + i, "SHOUT " * 120 if i % 3 else "a # " * 150, "de", "web", 0) for i in range(12)]
    ids = [r[0] for r in rows]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in ids for _ in range(rng.choice([0, 1, 2]))] + [(77_777, 1, 1)]
    return rows, labels


def test_against_every_order(spark):
    rows, labels = rows_and_labels()
    df = frame(spark, rows, {"mask": "'x'", "part": "1", "n": "null"})
    assert found(filter_audit.audit(df, spark.createDataFrame(labels, LABELS))) == plain(rows, labels)


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(textbuf, "BROADCAST_ROWS", 0)
    rows, labels = rows_and_labels()
    assert found(filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS))) == plain(rows, labels)


def test_one_id_and_no_id(spark):
    rows = many_of_one_id() + [(5, None, None, None, None), (6, "", None, None, None), (None, "", "en", None, None)]
    labels = [(21, 1, 0), (21, 0, 1), (None, 1, 1)]
    assert found(filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS))) == plain(rows, labels)


def test_empty_tables(spark):
    rows, labels = rows_and_labels()
    assert found(filter_audit.audit(frame(spark, []), spark.createDataFrame(labels, LABELS))) == {}
    assert found(filter_audit.audit(frame(spark, rows), spark.createDataFrame([], LABELS))) == plain(rows, [])


def test_matrices_say_what_becomes_of_a_mask():
    m = filter_audit.outcome_matrices()
    assert {v.shape for v in m.values()} == {(32, 600)}
    assert (m["kept"][0] == 1).all() and not m["removed"][0].any()
    assert (m["removed"].reshape(32, 120, 5).sum(2)[1:] == 1).all()  # whatever fails something is removed once


@pytest.mark.parametrize("text, mask", [("a " * 100, 2), (" ".join(map(str, range(100))), 0), ("", 1), ("A", 5), ("|", 1 + 8)])
def test_single_texts(spark, text, mask):
    assert filter_audit.failures(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).collect()[0]["mask"] == mask
