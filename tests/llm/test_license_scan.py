"""License scan: planted notices are found at their places, and nothing else is."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from pixelry.llm import license_scan as L
from tests.llm.samples import SCHEMA, awkward, frame, prose


def spans(df) -> list[tuple]:
    return sorted((r.doc_id, r.license, round(r.coverage, 6), r.start_char, r.end_char) for r in df.collect())


def test_planted_statements(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i, (name, text) in enumerate(L.TEMPLATES.items()):
        before = prose(rng, rng.choice([0, 5, 3000])) + "\n"
        shown = text.upper() if i % 2 else text
        rows.append((i, before + shown + ".\n" + prose(rng, 40), "en", None, None))
        words = L.license_words(np.frombuffer(shown.encode(), np.uint8), np.array([0, len(shown.encode())]))
        want.append((i, name, 1.0, len(before) + int(words[1][0]), len(before) + int(words[2][-1])))
    got = spans(L.scan(frame(spark, rows, {"license": "1", "coverage": "'x'", "end_char": "3"})))
    assert got == sorted(want)


def test_changed_and_cut_notices(spark):
    words = L.TEMPLATES["MIT-text"].split()
    changed = [w if i % 12 else "другое" for i, w in enumerate(words)]
    longer = words[:20] + ["indeed"] * 2 + words[20:]
    rows = [(1, " ".join(changed), None, None, None), (2, " ".join(words[: len(words) // 2]), None, None, None), (3, " ".join(longer), None, None, None), (4, " ".join(words) + " and " + " ".join(words), None, None, None)]
    got = spans(L.scan(frame(spark, rows)))
    assert [g[:2] for g in got] == [(1, "MIT-text"), (3, "MIT-text"), (4, "MIT-text"), (4, "MIT-text")]
    assert got[0][2] >= L.MIN_COVERAGE
    assert got[0][2] < 1
    assert got[1][2] == got[2][2] == got[3][2] == 1
    assert got[2][4] <= got[3][3]


def plain_alignment(template: list, words: list) -> tuple[int, int, int]:
    """Matched words and span of the best local alignment, over all diagonals."""
    best, row = (0, 0, 0, 0), [(0, 0, -1)] * (len(words) + 1)
    for t in template:
        now = [(0, 0, -1)]
        for j, w in enumerate(words):
            score, matches, first = row[j]
            cell = (score + 2, matches + 1, j if first < 0 else first) if t == w else (score - 2, matches, first)
            if t == w and cell[:2] > best[:2]:
                best = (*cell, j + 1)
            for other in (row[j + 1], now[j]):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            now.append(cell if cell[0] > 0 else (0, 0, -1))
        row = now
    return best[1], best[2], best[3]


def test_edited_statements_against_plain_alignment(spark):
    """Every short template with words changed or left out, as far as the least coverage allows, is found as by aligning all templates in full."""
    rng = random.Random(9)
    words_of = lambda text: L.license_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0].tolist()
    templates = {n: words_of(t) for n, t in L.TEMPLATES.items()}
    rows, want = [], []
    for name, text in L.TEMPLATES.items():
        if len(templates[name]) > L.SHORT:
            continue
        for _ in range(4):
            words = text.replace(",", " ").replace("-", " ").replace(".", " ").replace("/", " ").split()
            for i in rng.sample(range(len(words)), int(len(words) * (1 - L.MIN_COVERAGE))):
                words[i] = rng.choice(["", "zzz"])
            shown = f"{prose(rng, 6)} qq {' '.join(words)} qq {prose(rng, 6)}"
            rows.append((len(rows), shown, "en", None, None))
            own = words_of(shown)
            found = [(got, got / len(t), n) for n, t in templates.items() for got, _, _ in [plain_alignment(t, own)] if got >= L.MIN_COVERAGE * len(t)]
            want.append(max(found, key=lambda f: (f[0], f[1]))[:2] if found else None)
    got = {r.doc_id: (r.n_matched, r.coverage) for r in L.scan(frame(spark, rows)).collect()}
    assert [got.get(i) for i in range(len(rows))] == want
    assert sum(w is not None for w in want) > 0.9 * len(want)


@pytest.mark.parametrize("kind", ["replaced", "inserted", "left out"])
def test_long_templates_with_a_fifth_of_their_words_edited(spark, kind):
    """At least 0.9 of what plain alignment finds, of templates of every length."""
    rng = random.Random(kind)
    words_of = lambda text: L.license_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0].tolist()
    rows, want = [], []
    for name, text in L.TEMPLATES.items():
        template = words_of(text)
        for _ in range(2 if len(template) > L.SHORT else 4):
            words = text.replace(",", " ").replace("-", " ").replace(".", " ").replace("/", " ").split()
            for i in sorted(rng.sample(range(len(words)), len(words) // 5), reverse=True):
                words[i : i + (kind != "inserted")] = [] if kind == "left out" else [f"zz{rng.randrange(10**6)}"]
            shown = f"{prose(rng, 6)} qq {' '.join(words)} qq {prose(rng, 6)}"
            if plain_alignment(template, words_of(shown))[0] >= L.MIN_COVERAGE * len(template):
                want.append((len(rows), name, len(template) > L.SHORT))
            rows.append((len(rows), shown, "en", None, None))
    got = {(r.doc_id, r.license) for r in L.scan(frame(spark, rows)).collect()}
    found_docs = {i for i, _ in got}
    assert sum(i in found_docs for i, *_ in want) >= 0.9 * len(want)
    long = [(i, n) for i, n, is_long in want if is_long]
    assert sum(x in got for x in long) >= 0.9 * len(long)
    assert len(long) >= 15


def test_many_repeats_take_linear_time():
    index = L.Index(L.TEMPLATES)
    words = np.tile(index.words[index.names.index("MIT-short")], 20_000)
    at, posting = index.hits(L.gram_hashes(words, 2))
    began = time.perf_counter()
    assert len(L.matches(index, words, at, posting)) == 20_000
    assert time.perf_counter() - began < 60


def test_rows_without_notices(spark):
    out = L.scan(frame(spark, awkward()))
    assert out.collect() == []
    assert "text" not in out.columns
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_repeat_matches(spark):
    row = (1, "Released under the MIT License", "en", "s", 3)
    assert len(spans(L.scan(frame(spark, [row, row])))) == 2


def test_winnowing_keeps_one_of_each_window():
    h = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for window in (1, 2, 5):
        kept = set(L.winnow(h, window).tolist())
        want = set()
        for i in range(len(h) - window + 1):
            least = min(h[i : i + window])
            want.add(max(j for j in range(i, i + window) if h[j] == least))
        assert kept == want
