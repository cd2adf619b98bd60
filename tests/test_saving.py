"""Committed picture files, ranged header reads, the registry of formats, layouts and chroma planes."""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelry.functions import layouts
from pixelry.operators import compose, generate, planes
from pixelry.plans.raster import Raster
from pixelry.sources import codecs, headers, hooks, pictures, saving
from tests.test_files import png
from tests.test_tiles import arrays, drawn

ENCODED = "picture_id string, content binary, error string"


def files(folder) -> list[str]:
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".png"))


def test_ids_that_look_alike_get_files_of_their_own(spark, tmp_path):
    ids = ["a b", "a_b", "a/b", None, "none", "%null", "a%20b", "", ".", "..", "_x", "é", "日本", "x" * 300, "x" * 299 + "y", "A b", "a b"]
    rows = [(k, f"{i}".encode(), None) for i, k in enumerate(ids)] + [("broken", None, "no good")]
    out = pictures.save(spark.createDataFrame(rows, ENCODED).repartition(3), str(tmp_path / "o ut"), "png").collect()
    assert sorted(r.picture_id or "" for r in out) == sorted(r[0] or "" for r in rows)
    assert len(files(tmp_path)) == len(ids) == len({r.path for r in out if r.path})
    assert {(r.picture_id, open(r.path, "rb").read()) for r in out if r.path} == {(k, f"{i}".encode()) for i, k in enumerate(ids)}
    assert [(r.path, r.error) for r in out if r.picture_id == "broken"] == [(None, "no good")]
    assert len({saving.file_name(k) for k in ids}) == len(set(ids))
    assert len({saving.file_name(k).lower() for k in ["é", "%C3%A9"]}) == 2
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(str(tmp_path / "o ut"))
    assert read.count() == len(ids)  # no name is hidden from readers


def test_saved_twice_is_there_twice_and_evaluated_twice_once(spark, tmp_path):
    df = spark.createDataFrame([("a", b"1", None)], ENCODED)
    one = pictures.save(df, tmp_path.as_uri(), "png")
    assert one.count() == one.count() == 1
    assert len(files(tmp_path)) == 1
    pictures.save(df, tmp_path.as_uri(), "png")
    assert len(files(tmp_path)) == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "out").mkdir()
    rows = spark.range(40).select(F.col("id").cast("string").alias("picture_id"), F.when(F.col("id") == 39, F.raise_error(F.lit("boom")).cast("binary")).otherwise(F.lit(b"x")).alias("content"), F.lit(None).cast("string").alias("error"))
    with pytest.raises(Exception, match="boom"):
        pictures.save(rows.repartition(4), str(tmp_path / "out"), "png")
    assert files(tmp_path) == []
    assert os.listdir(tmp_path / "out") == []


def test_nothing_to_save(spark, tmp_path):
    assert pictures.save(spark.createDataFrame([], ENCODED), str(tmp_path), "png").collect() == []


def jpeg(w: int, h: int, filler: int) -> bytes:
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", filler + 2) + b"\xff" * filler + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9 + b"\xff\xd9"


def tiff(w: int, h: int, gap: int) -> bytes:
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, 8), (277, 3, 1, 3)]
    return b"II*\0" + struct.pack("<I", 8 + gap) + struct.pack("<HHH", 16, 16, 16)[:0] + b"\x10\0" * (gap // 2) + struct.pack("<H", 4) + b"".join(struct.pack("<HHII", *e) for e in entries)


def test_headers_by_ranged_reads(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    body = b"\0" * 3_000_000
    exr = b"v/1\x01\2\0\0\0" + b"channels\0chlist\0" + struct.pack("<I", 37) + b"\0" * 37 + b"dataWindow\0box2i\0" + struct.pack("<I4i", 16, 2, 3, 11, 7)
    made = {
        "a.png": (png(7, 5, b"") + body, "png", 7, 5, "Rgb", "u8"),
        "deep/b.jpg": (jpeg(640, 480, 60_000) + body, "jpeg", 640, 480, "Rgb", "u8"),
        "deep/c.tif": (tiff(31, 17, 4000) + body, "tiff", 31, 17, "Rgb", "u16"),
        "deep/er/d.pgm": (b"P5 # a comment\n 12 9\n65535\n" + body, "pnm", 12, 9, "L", "u16"),
        "e.pam": (b"P7\nWIDTH 3\nHEIGHT 4\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n", "pnm", 3, 4, "Rgba", "u8"),
        "f.qoi": (b"qoif" + struct.pack(">IIBB", 8, 9, 4, 0), "qoi", 8, 9, "Rgba", "u8"),
        "g.exr": (exr + body, "exr", 10, 5, None, "f32"),
        "h.avif": (b"\0\0\0\x1cftypavif" + b"\0" * 200 + b"\0\0\0\x14ispe\0\0\0\0" + struct.pack(">II", 300, 200) + body, "avif", 300, 200, None, None),
        "i.tga": (b"\0" * 12 + struct.pack("<HH", 20, 30) + b"\x20\0", "tga", 20, 30, "Rgba", "u8"),
        "j.gif": (b"GIF89a" + struct.pack("<HH", 6, 4) + b"\0" * 9, "gif", 6, 4, "Rgba", "u8"),
    }
    for name, (raw, *_) in made.items():
        (tmp_path / name).write_bytes(raw)
    odd = {"x.png": b"\x89PNG\r\n\x1a\n\0\0", "y.jpg": b"\xff\xd8\xff\xe1\x00", "z.txt": b"hello", "empty.bmp": b""}
    for name, raw in odd.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / ".hidden.png").write_bytes(made["a.png"][0])
    rows = {os.path.relpath(r.path, tmp_path): r for r in headers.read(spark, str(tmp_path)).collect()}
    assert rows.keys() == made.keys() | odd.keys()
    for name, (raw, *want) in made.items():
        r = rows[name]
        assert [r.format, r.w, r.h, r.layout, r.kind, r.error] == [*want, None]
        assert r.length == len(raw)
        assert r.bytes_read <= 9 * headers.HEAD  # of files of three million bytes
    assert all(rows[name].error and rows[name].w is None for name in odd)
    assert headers.read(spark, tmp_path.as_uri(), glob="*.tif").count() == 1
    assert headers.read(spark, str(tmp_path / "a.png")).count() == 1
    sizes = {os.path.relpath(r.path, tmp_path): (r.w, r.h) for r in pictures.sizes(spark, str(tmp_path)).collect()}
    assert sizes["deep/b.jpg"] == (640, 480)


def read_raw(window) -> tuple:
    """A header reader that a hook names: width and height of one byte each."""
    w, h = window(4, 2)
    return w, h, "L", "u8"


def decode_raw(raw: bytes, most: int) -> tuple:
    """A decoder that a hook names: two samples after four bytes."""
    return 2, 1, "L", "u8", np.frombuffer(raw[4:6], np.uint8).astype(np.int64)


def test_hooks_outrun_built_in_formats_in_sql(spark, tmp_path):
    hooks.clear()
    try:
        assert not hooks.decoder_registered("raw8")
        assert hooks.register_decoder("RAW8", "tests.test_saving:decode_raw", "tests.test_saving:read_raw")
        assert not hooks.register_decoder("raw8", "tests.test_saving:other")  # the first stays
        assert hooks.decoder_registered("Raw8")
        hooks.register_signature("raw8", b"\x89PNG", b"\xff\xff\xff\0")
        hooks.register_signature("later", b"\x89PNG")
        (tmp_path / "a.png").write_bytes(b"\x89PNX" + bytes([9, 8]) + b"rest")
        (tmp_path / "b.raw8").write_bytes(b"none" + bytes([3, 2]))
        (tmp_path / "c.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 6, 4))
        headers.register(spark)
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW scanned USING picture_headers OPTIONS (path '{tmp_path}', hooks '{hooks.as_option()}')")
        got = {os.path.basename(r.path): (r.format, r.w, r.h) for r in spark.sql("SELECT * FROM scanned").collect()}
        assert got == {"a.png": ("raw8", 9, 8), "b.raw8": ("raw8", 3, 2), "c.gif": ("gif", 6, 4)}
        assert [(r.place, r.extension, r.mask, r.decoder) for r in hooks.table(spark).orderBy("place").collect()] == [(0, "raw8", "ffffff00", "tests.test_saving:decode_raw"), (1, "later", "ffffffff", None)]
        assert json.loads(hooks.as_option())["headers"] == {"raw8": "tests.test_saving:read_raw"}
        decoded = {os.path.basename(r.picture_id): (r.format, r.w, r.h, r.samples) for r in pictures.decode(pictures.files(spark, tmp_path.as_uri(), guess=True).where("path like '%a.png' or path like '%.raw8'")).collect()}
        assert decoded == {"a.png": ("raw8", 2, 1, [9, 8]), "b.raw8": ("raw8", 2, 1, [3, 2])}
    finally:
        hooks.clear()


@pytest.mark.parametrize("strides", [(1, 3, 15), (20, 1, 5), (1, 12, 3), (1, 4, 20), (0, 0, 0), (1, 2, 15), (15, 3, 1), (1, 3, 1 << 62)])
def test_layouts(spark, strides):
    c, x, y = strides
    at = layouts.layout(3, c, 5, x, 4, y)
    place = lambda i, j, k: i * c + j * x + k * y
    row = spark.range(1).select(layouts.min_length(at).alias("n"), layouts.has_aliased_samples(at).alias("aliased"), layouts.index(at, 2, 4, 3).alias("last"), layouts.index(at, 3, 0, 0).alias("out"), layouts.index_ignoring_bounds(at, 3, 0, 0).alias("free"), layouts.fits(at, F.lit(60)).alias("fits"), layouts.fits(layouts.shrink_to(at, 1, 9, 1), F.lit(20)).alias("small"), *(layouts.is_normal(at, f).alias(f) for f in layouts.FORMS)).first()
    big = place(2, 4, 3) >= 1 << 63
    assert row.n == (None if big else place(2, 4, 3) + 1)
    assert row["last"] == (None if big else place(2, 4, 3))
    assert (row.out, row.free) == (None, place(3, 0, 0))
    assert row.fits == (not big and place(2, 4, 3) < 60)
    assert row.small == (place(0, 4, 0) < 20)
    if y < 1000:
        places = [place(i, j, k) for i in range(3) for j in range(5) for k in range(4)]
        dims = sorted([(c, 3), (x, 5), (y, 4)])
        walks = dims[0][0] * dims[0][1] <= dims[1][0] and dims[1][0] * dims[1][1] <= dims[2][0]
        assert row.aliased == (not walks)
        assert not walks or not any(strides) or len(set(places)) == 60  # strides of zero count as no overlap
        assert row.image_packed == (walks and sorted(places) == list(range(60)))
    assert row.row_major_packed == (strides == (1, 3, 15))
    assert row.column_major_packed == (strides == (1, 12, 3))
    assert row.pixel_packed == (c == 1 and not row.aliased)


def test_views_of_arrays(spark):
    v = list(range(60))
    df = spark.createDataFrame([("p", v), ("short", v[:59]), ("none", None)], "picture_id string, s array<int>")
    want = np.array(v).reshape(4, 5, 3)
    assert (arrays(layouts.from_samples(df, "s", layouts.row_major_packed(3, 5, 4), "Rgb"))["p"] == want).all()
    assert arrays(layouts.from_samples(df, "s", layouts.row_major_packed(3, 5, 4), "Rgb")).keys() == {"p"}
    assert (arrays(layouts.from_samples(df, "s", layouts.transposed(layouts.row_major_packed(3, 5, 4)), "Rgb"))["p"] == want.transpose(1, 0, 2)).all()
    plane, begin = layouts.one_channel(layouts.row_major_packed(3, 5, 4), 1)
    assert (arrays(layouts.from_samples(df, "s", plane, "L", offset=begin))["p"][:, :, 0] == want[:, :, 1]).all()
    assert (arrays(layouts.from_samples(df, "s", layouts.one_pixel(3, 7, 6), "Rgb"))["p"] == want[0, 0]).all()
    assert layouts.from_samples(df, "s", layouts.one_pixel(2, 7, 6), "Rgb").pixels.count() == 0


@pytest.mark.parametrize("sub", ["4:4:4", "4:2:2", "4:2:0", "4:0:0"])
def test_planes_of_odd_pictures(spark, sub):
    rng = np.random.default_rng(1)
    sx, sy = {"4:4:4": (1, 1), "4:2:2": (2, 1), "4:2:0": (2, 2), "4:0:0": (1, 1)}[sub]
    sizes = {"a": (7, 5), "b": (1, 1), "c": (4, 2)}
    y = {k: rng.integers(0, 256, (h, w, 1)) for k, (w, h) in sizes.items()}
    u, v = ({k: rng.integers(0, 256, (-(-h // sy), -(-w // sx), 1)) for k, (w, h) in sizes.items()} for _ in range(2))
    got = arrays(planes.to_rgb(drawn(spark, y, "L"), drawn(spark, u, "L"), drawn(spark, v, "L"), sub))
    for k, (w, h) in sizes.items():
        grow = lambda p: p[k].repeat(sy, 0).repeat(sx, 1)[:h, :w, 0].astype(float) - 128 if sub != "4:0:0" else np.zeros((h, w))  # noqa: B023, E731
        a, b, c = y[k][:, :, 0].astype(float), grow(u), grow(v)
        red, blue = a + 1.402 * c, a + 1.772 * b
        want = np.stack([red, (a - 0.299 * red - 0.114 * blue) / 0.587, blue], -1)
        assert (got[k] == np.clip(np.floor(np.round(want, 6) + 0.5), 0, 255)).all()


def test_planes_there_and_back(spark):
    smooth = np.stack([np.add.outer(np.arange(9) * 4, np.arange(7) * 3 + k * 20) for k in range(3)], -1)
    r = drawn(spark, {"p": smooth})
    for sub, far in (("4:4:4", 2), ("4:2:2", 12), ("4:2:0", 16)):
        assert np.abs(arrays(planes.to_rgb(*planes.from_rgb(r, sub), sub))["p"] - smooth).max() <= far
    y, u, v = planes.from_rgb(r, "4:2:0")
    assert {x.shape for x in arrays(u).values()} == {(5, 4, 1)}
    with pytest.raises(Exception, match="too small"):
        planes.to_rgb(y, u.where("x < 3"), v, "4:2:0").pixels.collect()


def test_bytes_and_copies_within(spark):
    a = np.random.default_rng(2).integers(0, 65536, (3, 4, 2))
    r = drawn(spark, {"p": a, "q": a[:1]}, "La", "u16")
    found = {x.picture_id: bytes(x.content) for x in generate.into_bytes(r).collect()}
    assert found == {"p": a.astype("<u2").tobytes(), "q": a[:1].astype("<u2").tobytes()}
    done, failed = compose.try_copy_within(r, 0, 0, 2, 2, 2, 1)
    want = a.copy()
    want[1:3, 2:4] = a[0:2, 0:2]
    assert (arrays(done)["p"] == want).all() and (arrays(done)["q"] == a[:1]).all()
    assert [tuple(x) for x in failed.collect()] == [("q", "rectangle exceeds the picture")]
    assert isinstance(done, Raster)


def test_animations_with_a_broken_frame_report_it(spark):
    row = {"picture_id": "p", "frame_no": 0, "w": 1, "h": 1, "loops": 0, "left": 0, "top": 0, "width": 1, "height": 1, "dispose": "keep", "blend": "source", "numer": 1, "denom": 1, "samples": [1, 2, 3, 4], "error": None}
    rows = [row, {**row, "frame_no": 2, "error": "second"}, {**row, "frame_no": 1, "error": "first"}, {**row, "picture_id": "q"}]
    got = {r.picture_id: (r.content is not None, r.error) for r in pictures.encode_frames(spark.createDataFrame(rows, pictures.FRAME)).collect()}
    assert got == {"p": (False, "first"), "q": (True, None)}
    assert codecs.encode("png", 1, 1, "L", "u8", np.zeros(1, int))
