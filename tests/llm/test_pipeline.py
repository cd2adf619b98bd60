"""The pipeline's stages, one after the other, on a small corpus."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from pixelry.llm import byte_bpe
from pixelry.llm.textbuf import saved
from tests.llm.samples import SCHEMA, awkward, frame, prose
from tests.llm.test_jaccard_join import brute


def kept(rows: list[tuple]) -> Counter:
    """Ids of the rows that stay: one of each group of rows, by rows and not by ids."""
    numbered = [(i, *r[1:]) for i, r in enumerate(rows)]
    groups: dict[int, list] = {}
    for i, _, group, _ in brute(numbered).elements():
        groups.setdefault(group, []).append(rows[i][0])
    return Counter(min(ids, key=lambda x: (x is None, x or 0)) for ids in groups.values())


def test_near_duplicates_by_row(spark):
    """Different texts that share an id all stay, copies without an id are copies."""
    a, b, c, d = (f"{x} text of some nine words that differ {x}" for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (None, d), (None, "alone without an id"), (None, None), (7, ""), (8, b), (8, b)]
    docs = frame(spark, [(i, t, None, None, None) for i, t in rows], {"row": "'r'", "component_id": "1"})
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or -1, r.text or "") for r in left.collect())) == sorted([(1, a), (2, b), (3, c), (3, d), (-1, "alone without an id"), (-1, ""), (7, "")])


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == []
        assert name == "byte_bpe" or out.columns == docs.columns


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = awkward() + [(5000 + i, prose(rng, rng.randint(60, 200)), "en", "web", 1) for i in range(60)]
    junk = [(7000 + i, "".join(rng.choice("qxzj#%&0123456789 ") for _ in range(900)), "en", "web", 900) for i in range(5)]
    frame(spark, rows + junk, {"node": "1", "kept": "2", "topic": "'t'"}).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(5000 + i, 1, 0) for i in range(60)] + [(7000, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r)[:5] for r in docs.collect()]
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        seen[name] = before, docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
            assert {r.doc_id for r in seen[name][1]} <= {r[0] for r in before}
    left = {r.doc_id for r in seen["quality_classifier"][1]}
    assert not left & {7000 + i for i in range(5)}
    assert len(left & {5000 + i for i in range(60)}) >= 55
    assert all(len((r.text or "").split()) >= 50 for r in seen["quality_rules"][1])
    before, after = seen["near_duplicates"]
    assert Counter(r.doc_id for r in after) == kept(before)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before, after = seen["byte_bpe"]
    assert sorted((r.doc_id or -1, r.n_tokens, tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in after) == sorted((r[0] or -1, len(x), tuple(x)) for r in before for x in [library.encode_ordinary(r[1] or "")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)
