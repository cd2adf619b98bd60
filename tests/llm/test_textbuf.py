"""Span hashes and caches, on words that are known to collide under a polynomial hash modulo a power of two."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from pixelry.llm import byte_bpe, jaccard_join, quality_rules, textbuf, token_shards
from tests.llm.samples import frame


def thue_morse(n: int, letters: str) -> str:
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join(letters[x] for x in word[:n])


#: The Thue-Morse word and its complement.
PAIR = thue_morse(4096, "ab"), thue_morse(4096, "ba")


def test_hashes_depend_on_the_items_alone():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(3000)] + list(PAIR)
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    found: dict[str, int] = {}
    for w, h in zip(words, textbuf.SpanHasher(raw)(ends - [len(w) for w in words], ends).tolist(), strict=True):
        assert found.setdefault(w, h) == h
    assert len(set(found.values())) == len(found)
    wide = np.array([5, 5, 1 << 40, 7, 5, 1 << 40], np.uint64)
    a, b, c = textbuf.SpanHasher(wide)(np.array([1, 4, 0]), np.array([3, 6, 2]))
    assert a == b != c


def test_a_cache_is_right_whatever_the_hash(monkeypatch):
    class Lengths:
        def __init__(self, items):
            pass

        def __call__(self, starts, ends):
            return (ends - starts).astype(np.uint64) % np.uint64(2)

    monkeypatch.setattr(textbuf, "SpanHasher", Lengths)
    rng = random.Random(2)
    monkeypatch.setattr(textbuf.SpanCache, "RECENT", 15)
    cache = textbuf.SpanCache(most=90)
    for _ in range(20):
        words = ["".join(rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 7, 8, 9)))) for _ in range(rng.randint(0, 40))]
        raw, ends = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([len(w) for w in words], dtype=np.int64)
        flat, lens = cache.ids(raw, ends - np.array([len(w) for w in words], np.int64), ends, lambda texts: [list(x.encode()) for x in texts])
        assert flat.tolist() == [x for w in words for x in w.encode()]
        assert lens.tolist() == [len(w) for w in words]


@pytest.fixture(scope="module")
def rows():
    a, b = PAIR
    return [(1, a, "en", "s", 0), (2, b, "en", "s", 0), (3, f"{a}\n{b}\n{a}", "en", "s", 0), (4, f"{b} {a}", "en", "s", 0), (5, a, "en", "s", 0)]


def test_encoders(spark, rows, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for r in byte_bpe.encode(frame(spark, rows).coalesce(1), "text", path, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(r.text)
    path = public_tokenizers.path("word_bpe_49k.json")
    token_shards.write(frame(spark, rows).coalesce(1), str(tmp_path / "shards"), path, end_id=1)
    texts, tokenizer = {r[0]: r[1] for r in rows}, Tokenizer.from_file(path)
    for r in token_shards.read_documents(spark, str(tmp_path / "shards")).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]


def test_sets_and_lines(spark, rows):
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    lines = {r.doc_id: r.n_dup_lines for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    assert lines == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
