"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelry.llm import byte_bpe as B
from tests.llm.samples import SCHEMA, awkward, frame

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = B.load_ranks(RANKS)
LIBRARY = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY, special_tokens={})
SMALL = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"aa": 259, b"aaaa": 260}


def ids(blob) -> list[int]:
    return np.frombuffer(bytes(blob), "<u4").tolist()


def test_ids_and_round_trip(spark):
    rows = awkward()
    rows += [(900 + i, t, None, None, None) for i, t in enumerate(["a  b", "a \n b", "x　 y", "\x1c a", "a\x1f b", "don't  we'll\r\n\r\n 1234567", "ends with space ", "\u0085 q", "é ​ z", " " * 3000, "ab" * 2000])]
    df = frame(spark, rows, {"ids": "'clash'", "decoded": "1"})
    out = B.decode(B.encode(df, "text", RANKS, public_tokenizers.PATTERN), "ids", RANKS)
    got = Counter((r.doc_id, tuple(ids(r["ids"])), bytes(r.decoded)) for r in out.collect())
    assert got == Counter((r[0], tuple(LIBRARY.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)


def test_empty_table(spark):
    out = B.encode(spark.createDataFrame([], SCHEMA), "text", RANKS, public_tokenizers.PATTERN)
    assert out.collect() == []
    assert out.columns[-1] == "ids"


def test_perfect_hash_has_no_spare_slot_and_knows_strangers():
    import xxhash

    table = B.PerfectHash(VOCABULARY)
    assert len(table.slots) == len(VOCABULARY)
    assert None not in table.slots
    look = lambda k: table.get(k, xxhash.xxh3_64_intdigest(k))
    assert all(look(k) == v for k, v in VOCABULARY.items())
    assert look(b"surely not in the vocabulary") is None
    assert B.PerfectHash({}).get(b"a", 5) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=40))
def test_heap_merges_equal_repeated_scans(text):
    parts = [text[i : i + 1].encode() for i in range(len(text))]
    while True:
        best = min(((SMALL[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in SMALL), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert B.merge_bytes(text.encode(), SMALL) == [SMALL[p] for p in parts]
