"""Quality rules against a direct computation."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from pixelry.llm import quality_rules as Q
from tests.llm.samples import SCHEMA, awkward, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows: list[tuple], max_docs: int, depleted: float) -> Counter:
    holders = defaultdict(set)
    lines_of = lambda text: [x for x in (text or "").split("\n") if WORD.search(x)]
    for _, text, _, host, _ in rows:
        for line in lines_of(text):
            holders[host, tuple(WORD.findall(lower(line)))].add(text)
    gone = {k for k, v in holders.items() if len(v) > max_docs}
    out = Counter()
    for doc_id, text, _, host, _ in rows:
        words, lines = WORD.findall(text or ""), lines_of(text)
        at = defaultdict(list)
        for i in range(len(words) - 2):
            at[tuple(words[i : i + 3])].append(i)
        repeated = len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)})
        failed = len(words) < 50 or 100 * repeated > 50 * len(words)
        removed = [x for x in lines if (host, tuple(WORD.findall(lower(x)))) in gone]
        n = sum(len(WORD.findall(x)) for x in removed)
        clean = text
        if removed:
            clean = "\n".join(x for x in text.split("\n") if not (WORD.search(x) and (host, tuple(WORD.findall(lower(x)))) in gone))
        out[doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated, failed, not failed and 100 * n <= depleted * len(words), len(removed), n, clean] += 1
    return out


def found(df) -> Counter:
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_lines, r.n_removed_words, r.clean_text) for r in df.collect())


def hosted(seed: int) -> list[tuple]:
    """Documents of three hosts, whose pages share lines."""
    rng = random.Random(seed)
    shared = ["Subscribe to our news letter now", "  Home   About\tContact ", "# * $ all | rights & < reserved >", "Accept cookies"]
    rows = []
    for i in range(150):
        host = rng.choice(["hot", "hot", "hot", "cold", None])
        parts = [prose(rng, rng.randint(20, 90)).replace("\n", " ") for _ in range(rng.randint(1, 3))]
        for line in shared[: 2 + (host == "hot")]:
            if rng.random() < 0.5:
                parts.insert(rng.randint(0, len(parts)), rng.choice([line, line.upper()]))
        if host == "hot" and rng.random() < 0.2:
            parts = parts[:1] + shared * 30
        rows.append((i, "\n".join(parts) + rng.choice(["", "\n", "\r\n"]), "en", host, 0))
    return rows + rows[:5]


@pytest.mark.parametrize("limits", [(10, 50), (3, 10)])
def test_against_brute_force(spark, limits):
    rows = awkward() + hosted(9)
    df = frame(spark, rows, {"kept": "1", "n_words": "'x'", "removable": "2", "line": "3", "docs": "4"})
    out = Q.apply_rules(df, max_docs=limits[0], depleted_percent=limits[1])
    assert found(out) == brute(rows, *limits)
    assert {(r.removable, r.line, r.docs) for r in out.collect()} == {(2, 3, 4)}


def test_same_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(Q, "BROADCAST_HOSTS", -1)
    rows = hosted(4)
    assert found(Q.apply_rules(frame(spark, rows))) == brute(rows, 10, 50)


def test_empty_table(spark):
    out = Q.apply_rules(spark.createDataFrame([], SCHEMA))
    assert out.collect() == []
    assert {"doc_id", "text", "kept", "clean_text"} <= set(out.columns)


def boilerplate(n: int) -> list[tuple]:
    """A hot host of n documents: 12 share one line, and 12 more consist mostly of a line of theirs."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows = [[" ".join(rng.choice(words) for _ in range(60))] for _ in range(n)]
    for i in range(12):
        rows[i].append("All rights of this page are reserved")
        rows[20 + i].append(" ".join(f"menu{k}" for k in range(80)))
    return [(i, "\n".join(x), "en", "hot", 0) for i, x in enumerate(rows)]


@pytest.mark.parametrize("hosts", [Q.BROADCAST_HOSTS, -1])
def test_pipeline_limit_does_not_grow_with_the_host(spark, monkeypatch, hosts):
    import corpus_pipeline

    monkeypatch.setattr(Q, "BROADCAST_HOSTS", hosts)
    rows = boilerplate(600)
    left = {r.doc_id: r.text for r in corpus_pipeline.rules(spark, frame(spark, rows), "").collect()}
    assert left.keys() == set(range(600)) - set(range(20, 32))
    assert not any("reserved" in x for x in left.values())
    assert found(Q.apply_rules(frame(spark, rows))) == brute(rows, 10, 50)


def test_long_lists_never_ride_on_the_documents(spark, monkeypatch):
    """Beyond BROADCAST_LINES a document meets its own removable lines only."""
    monkeypatch.setattr(Q, "BROADCAST_LINES", 0)
    rows = hosted(4) + boilerplate(300)
    docs = frame(spark, rows)
    assert found(Q.apply_rules(docs)) == brute(rows, 10, 50)
    sizes = {r.doc_id: len(r.removable or b"") // 8 for r in Q._with_own_lines(docs, Q.frequent_lines(docs), "source", "text").collect()}
    assert max(sizes.values()) <= max(len(set(r[1].split("\n"))) for r in rows)
    assert 0 in sizes.values()
