"""Wavelet-matrix shards against plain arrays and the tokenizers library."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelry.llm import token_shards as W
from tests.llm.samples import SCHEMA, awkward, frame, hashes, many_of_one_id

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=300), st.integers(0, 80))
def test_queries_on_one_matrix(values, token):
    m = W.WaveletMatrix.build(np.array(values, np.uint16))
    assert m.tokens().tolist() == values
    assert [m.access(i) for i in range(len(values))] == values
    places = [i for i, v in enumerate(values) if v == token]
    assert m.rank(token) == len(places)
    assert m.rank(token, len(values) // 2) == sum(p < len(values) // 2 for p in places)
    assert [m.select(token, k) for k in range(len(places))] == places
    assert m.select(token, len(places)) == -1


def test_rank_and_select_across_blocks():
    values = np.random.default_rng(2).integers(0, 5, 3 * W.BLOCK + 77).astype(np.uint16)
    ids, lens, m = W.unpack(W.pack([4, None], np.array([len(values), 0]), values))
    assert ids == [4, None]
    assert lens.tolist() == [len(values), 0]
    places = np.flatnonzero(values == 3)
    for k in (0, 1, len(places) // 2, len(places) - 1):
        assert m.select(3, k) == places[k]
        assert m.rank(3, int(places[k])) == k
    with pytest.raises(ValueError, match="shard"):
        W.unpack(b"nothing of the kind")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = awkward() + many_of_one_id() + [(2000 + i, t, None, None, None) for i, t in enumerate(["[CLS] and [MASK] in a text", "<s> </s> <pad> <unk> <|endoftext|>", "Café́ É É", "Quiet,loud;a.b:c!d?e", "İstanbul ſharp", "a b​c"])]
    path = str(tmp_path_factory.mktemp("shards") / "out")
    W.write(frame(spark, rows, {"shard": "5", "ids": "'x'"}), path, PATH, end_id=1, docs_per_range=16)
    library = Tokenizer.from_file(PATH)
    want = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    h = hashes(spark, rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, h[rows[i][1]]))
    return rows, path, [want[i] for i in order]


def test_many_rows_of_one_id_are_spread(spark, written):
    _, path, _ = written
    assert max(r.n_docs for r in W.shards(spark, path).collect()) < 60


@pytest.mark.parametrize("most", [W.BROADCAST_SHARDS, 0])
def test_documents_read_back(spark, written, monkeypatch, most):
    monkeypatch.setattr(W, "BROADCAST_SHARDS", most)
    _, path, want = written
    got = sorted(W.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    at = 0
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
    both = lambda pairs: sorted((d or -1, tuple(x)) for d, x in pairs)
    assert both((r.doc_id, np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in got) == both(want)


def test_counts_and_occurrences(spark, written):
    _, path, want = written
    some = sorted({ids[0] for _, ids in want[:6]} | {1, 48_000})
    counts = {r.token: r["count"] for r in W.token_counts(spark, path, some).collect()}
    assert counts == {t: sum(ids.count(t) for _, ids in want) for t in some}
    token = want[1][1][0]
    got = sorted((r.doc_id or -1, r.position) for r in W.occurrences(spark, path, token).collect())
    assert got == sorted((d or -1, k) for d, ids in want for k, x in enumerate(ids) if x == token)


def test_empty_table(spark, tmp_path):
    W.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), PATH, end_id=1)
    assert W.read_documents(spark, str(tmp_path / "none")).collect() == []
