"""Every raster query against its SQL in DuckDB, and the entry module."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from pixelry import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(v):
    if isinstance(v, float):
        return f"{v:.6g}" if math.isfinite(v) else str(v)
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
    else:
        cur = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(df.columns)
        assert sorted(rows) == sorted(tuple(shown(r[i]) for i in order) for r in cur.fetchall())


@pytest.fixture(scope="module")
def near_levels(tmp_path_factory):
    """Embeddings of values just below a level, whose products with 1000 reach it as floats but not as doubles."""
    at = tmp_path_factory.mktemp("near")
    below = np.nextafter((np.arange(1, 20_000) / 1000).astype(np.float32), np.float32(0))
    below = below[np.floor(below * np.float32(1000)) != np.floor(below.astype(float) * 1000)]
    vectors = np.resize(below * np.where(np.arange(len(below)) % 2, 1, -1).astype(np.float32), 20 * 64).reshape(20, 64)
    pq.write_table(pa.table({"vec_id": pa.array(range(20), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 20, pa.int32())}), at / "embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["codec_bmp_rgb_u8", "codec_bmp_rgba_u8", "codec_farbfeld_rgba_u16", "codec_ico_rgba_u8", "codec_png_l_u16", "codec_png_rgba_u8", "codec_pnm_rgb_u8", "codec_pnm_rgba_u16", "codec_qoi_rgb_u8", "codec_qoi_rgba_u8", "codec_tga_l_u8", "codec_tga_rgba_u8", "dither_corpus", "embedded_profiles", "reduced_colors", "palette_of_each", "frames_blended", "frames_transparent"])
def test_levels_of_embeddings(spark, near_levels, name):
    df = catalog.QUERIES[name](spark, near_levels)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{near_levels}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_entry_has_rows_and_a_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["x", "y", "c0", "c1", "c2"]
    assert df.count() == 100


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert __spark_entry__.queries().keys() == catalog.QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() == catalog.ORACLE_SQL.keys()


def test_oracles_belong_to_queries():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
