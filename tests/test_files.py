"""Picture files: codecs against hand-made files, animations, metadata, limits, and files as streams."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelry.operators import frames, geometry, point
from pixelry.sources import codecs, formats, metadata, pictures
from pixelry.streaming import arrivals


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(w: int, h: int, lines: bytes, *more: bytes, kind: int = 2, laced: int = 0) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, laced)) + b"".join(more) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def gif_codes(index: list[int], bits: int) -> bytes:
    """Plain codes of one width: the table is cleared before it grows."""
    out, held, have, width = bytearray(), 0, 0, bits + 1
    codes = []
    for k, v in enumerate(index):
        if k % ((1 << bits) - 2) == 0:
            codes.append(1 << bits)
        codes.append(v)
    for c in [*codes, (1 << bits) + 1]:
        held |= c << have
        have += width
        while have >= 8:
            out.append(held & 255)
            held, have = held >> 8, have - 8
    out.append(held & 255)
    return bytes([bits]) + b"".join(bytes([len(out[i : i + 255])]) + out[i : i + 255] for i in range(0, len(out), 255)) + b"\0"


def gif(w: int, h: int, shown: list[tuple]) -> bytes:
    """shown: (left, top, width, height, indices, disposal, transparent index or None, delay)."""
    table = b"".join(bytes([i * 60, 255 - i * 60, i]) for i in range(4))
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + table + b"!\xff\x0bNETSCAPE2.0\x03\x01\x05\x00\x00"
    for left, top, fw, fh, index, dispose, clear, delay in shown:
        out += b"!\xf9\x04" + struct.pack("<BHB", dispose << 2 | (clear is not None), delay, clear or 0) + b"\0"
        out += b"," + struct.pack("<HHHHB", left, top, fw, fh, 0) + gif_codes(index, 2)
    return out + b";"


SHOWN = [(0, 0, 3, 2, [0, 1, 2, 3, 0, 1], 1, None, 7), (1, 0, 2, 2, [3, 0, 2, 2], 2, 0, 0), (0, 1, 3, 1, [1, 1, 1], 3, None, 5), (0, 0, 1, 1, [2], 0, None, 1)]


def test_gif_frames():
    w, h, loops, found = codecs.decode_frames("gif", gif(3, 2, SHOWN))
    assert (w, h, loops) == (3, 2, 5)
    assert [(f["left"], f["top"], f["width"], f["height"], f["dispose"], f["numer"]) for f in found] == [(0, 0, 3, 2, "keep", 70), (1, 0, 2, 2, "background", 0), (0, 1, 3, 1, "previous", 50), (0, 0, 1, 1, "keep", 10)]
    colour = lambda i: [i * 60, 255 - i * 60, i, 255]
    assert found[0]["samples"].reshape(-1, 4).tolist() == [colour(i) for i in SHOWN[0][4]]
    assert found[1]["samples"].reshape(-1, 4).tolist() == [colour(3), [0] * 4, colour(2), colour(2)]
    many = [i % 4 for i in range(40 * 30)]
    assert codecs.decode("gif", gif(40, 30, [(0, 0, 40, 30, many, 1, None, 0)]))[4].reshape(-1, 4).tolist() == [colour(i) for i in many]
    whole = gif(3, 2, SHOWN)
    for cut in range(0, 60, 7):
        with pytest.raises(ValueError, match=".+"):
            codecs.decode("gif", whole[:cut])


def test_gif_codes_that_grow():
    """Codes of several widths, from a plain encoder."""
    rng = np.random.default_rng(1)
    index = np.repeat(rng.integers(0, 4, 3000), rng.integers(1, 6, 3000)).tolist()[:6000]
    table, codes, now = {(i,): i for i in range(4)}, [(4, 3)], ()
    width = 3
    for v in index:
        if (*now, v) in table:
            now = (*now, v)
            continue
        codes.append((table[now], width))
        if len(table) + 2 < 4096:
            table[*now, v] = len(table) + 2
            width = max(width, min(12, (len(table) + 1).bit_length()))
        now = (v,)
    codes += [(table[now], width), (5, width)]
    held, have, out = 0, 0, bytearray()
    for c, n in codes:
        held |= c << have
        have += n
        while have >= 8:
            out.append(held & 255)
            held, have = held >> 8, have - 8
    out.append(held & 255)
    assert list(codecs._gif_codes(bytes(out), 2, len(index))) == index


def test_animated_png():
    first, second = b"\0" + bytes([10] * 6) + b"\0" + bytes([20] * 6), b"\0" + bytes([1, 2, 3])
    control = lambda n, w, h, x, y, d, b: chunk(b"fcTL", struct.pack(">IIIIIHHBB", n, w, h, x, y, 3, 0, d, b))
    raw = png(2, 2, first, chunk(b"acTL", struct.pack(">II", 2, 9)), control(0, 2, 2, 0, 0, 0, 0))
    raw = raw[:-12] + control(1, 1, 1, 1, 0, 2, 1) + chunk(b"fdAT", struct.pack(">I", 2) + zlib.compress(second)) + raw[-12:]
    w, h, loops, found = codecs.decode_frames("png", raw)
    assert (w, h, loops, len(found)) == (2, 2, 9, 2)
    assert found[1]["samples"].tolist() == [1, 2, 3, 255]
    assert [(f["left"], f["dispose"], f["blend"], f["numer"], f["denom"]) for f in found] == [(0, "keep", "source", 3000, 100), (1, "previous", "over", 3000, 100)]
    assert len(codecs.decode_frames("png", png(2, 2, first))[3]) == 1


@pytest.mark.parametrize(("w", "h"), [(1, 1), (3, 2), (8, 8), (9, 13), (2, 5)])
def test_interlaced_png(w, h):
    v = np.random.default_rng(w * h).integers(0, 256, (h, w, 3)).astype(np.uint8)
    lines = b""
    for x, y, dx, dy in codecs._ADAM7:
        part = v[y::dy, x::dx]
        if part.size:
            lines += b"".join(b"\0" + row.tobytes() for row in part)
    assert (codecs.decode("png", png(w, h, lines, laced=1))[4] == v.ravel()).all()


def test_bmp_kinds():
    head = lambda w, h, depth, packing, body, table=b"", size=40: struct.pack("<2sIHHI", b"BM", 0, 0, 0, 14 + size + len(table)) + struct.pack("<IiiHHIIiiII", size, w, h, 1, depth, packing, 0, 0, 0, len(table) // 4, 0).ljust(size, b"\0") + table + body
    table = b"".join(bytes([i, i + 1, i + 2, 0]) for i in (0, 100))
    assert codecs.decode("bmp", head(3, -2, 1, 0, b"\xa0\0\0\0\x40\0\0\0", table))[4].reshape(-1, 3).tolist() == [[102, 101, 100], [2, 1, 0], [102, 101, 100], [2, 1, 0], [102, 101, 100], [2, 1, 0]]
    grey = b"".join(bytes([i * 16] * 3 + [0]) for i in range(16))
    assert codecs.decode("bmp", head(3, 1, 4, 0, b"\x12\x30\0\0", grey))[4].reshape(-1, 3)[:, 0].tolist() == [16, 32, 48]
    assert codecs.decode("bmp", head(5, 2, 8, 1, b"\x03\x02\0\0\0\x03\x01\x02\x03\0\0\1", grey))[4].reshape(2, 5, 3)[::-1, :, 0].tolist() == [[32, 32, 32, 0, 0], [16, 32, 48, 0, 0]]
    assert codecs.decode("bmp", head(4, 1, 4, 2, b"\x04\x12\0\1", grey))[4].reshape(-1, 3)[:, 0].tolist() == [16, 32, 16, 32]
    assert codecs.decode("bmp", head(2, 1, 16, 0, struct.pack("<HH", 0x7C00, 0x3E0)))[4].tolist() == [255, 0, 0, 0, 255, 0]
    assert codecs.decode("bmp", head(1, 1, 16, 3, struct.pack("<H", 0xF800) + b"\0\0", struct.pack("<III", 0xF800, 0x7E0, 0x1F)))[4].tolist() == [255, 0, 0]
    v = np.arange(6, dtype=np.int32)
    assert codecs.decode("bmp", codecs.encode("bmp", 3, 2, "L", "u8", v))[4].tolist() == np.repeat(v, 3).tolist()


def test_tga_runs_and_palettes():
    head = lambda mapped, kind, w, h, depth, flags=32, count=0, entry=0: struct.pack("<BBBHHBHHHHBB", 0, mapped, kind, 0, count, entry, 0, 0, w, h, depth, flags)
    assert codecs.decode("tga", head(0, 10, 3, 1, 24) + b"\x81\1\2\3\0\7\x08\x09")[4].tolist() == [3, 2, 1, 3, 2, 1, 9, 8, 7]
    assert codecs.decode("tga", head(1, 1, 2, 1, 8, 32, 2, 24) + b"\1\2\3\4\5\6" + b"\1\0")[4].tolist() == [6, 5, 4, 3, 2, 1]
    assert codecs.decode("tga", head(0, 3, 2, 2, 8, 0) + b"\1\2\3\4")[4].tolist() == [3, 4, 1, 2]
    assert codecs.decode("tga", head(0, 3, 2, 1, 8, 48) + b"\1\2")[4].tolist() == [2, 1]
    assert codecs.decode("tga", head(0, 2, 1, 1, 16) + struct.pack("<H", 31 << 10 | 1))[4].tolist() == [255, 0, 8]


def test_icons_of_bitmaps():
    icon = lambda entries: struct.pack("<HHH", 0, 1, len(entries)) + b"".join(struct.pack("<BBBBHHII", w, h, 0, 0, 1, depth, len(body), 6 + 16 * len(entries) + sum(len(b) for *_, b in entries[:i])) for i, (w, h, depth, body) in enumerate(entries)) + b"".join(b for *_, b in entries)
    head = lambda w, h, depth: struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, depth, 0, 0, 0, 0, 0, 0)
    mask = b"\x80\0\0\0\0\0\0\0"
    small = (1, 1, 24, head(1, 1, 24) + b"\1\2\3\0" + b"\0\0\0\0")
    large = (2, 2, 24, head(2, 2, 24) + b"\1\2\3\4\5\6\0\0" + b"\7\x08\x09\x0a\x0b\x0c\0\0" + mask)
    assert codecs.decode("ico", icon([small, large]))[4].reshape(-1, 4).tolist() == [[9, 8, 7, 255], [12, 11, 10, 255], [3, 2, 1, 0], [6, 5, 4, 255]]
    full = (1, 2, 32, head(1, 2, 32) + b"\1\2\3\4" + b"\5\6\7\x08" + b"\0" * 8)
    assert codecs.decode("ico", icon([full]))[4].reshape(-1, 4).tolist() == [[7, 6, 5, 8], [3, 2, 1, 4]]


def test_written_animations_and_options():
    v = np.arange(24) % 256
    frame = lambda **k: {"left": 0, "top": 0, "width": 3, "height": 2, "dispose": "keep", "blend": "source", "numer": 70, "denom": 1, "samples": v, **k}
    raw = codecs.write_animation(3, 2, [frame(), frame(left=1, width=2, dispose="previous", blend="over", samples=v[:16], numer=200_000)], 4)
    w, h, loops, found = codecs.decode_frames("png", raw)
    assert (w, h, loops) == (3, 2, 4)
    assert [f["samples"].tolist() for f in found] == [v.tolist(), v[:16].tolist()]
    assert [(f["left"], f["dispose"], f["blend"], f["numer"] / f["denom"]) for f in found] == [(0, "keep", "source", 70), (1, "previous", "over", 200_000)]
    flat = np.zeros(3000, np.int32)
    sizes = [len(codecs.encode("png", 100, 10, "Rgb", "u8", flat, level=k)) for k in (0, 9)]
    assert sizes[0] > 3000 > 100 > sizes[1]
    held = codecs.encode("png", 100, 10, "Rgb", "u8", flat, filtered=False, icc=b"profile", exif=b"MM\0*")
    assert metadata._png_blocks(held) == {"icc": b"profile", "exif": b"MM\0*"}
    assert (codecs.decode("png", held)[4] == flat).all()


def test_files_are_saved(spark, folder, tmp_path):
    found = pictures.decode_frames(pictures.files(spark, folder).where("format = 'gif'")).where("frame_no = 0 or error is null").where("picture_id like '%a.gif'")
    (made,) = pictures.encode_frames(found, loops=2).collect()
    assert [f["samples"].tolist() for f in codecs.decode_frames("png", bytes(made.content))[3]] == [r.samples for r in found.orderBy("frame_no").collect()]
    pixels = pictures.rasters(pictures.decode(pictures.files(spark, folder)), "Rgb")
    (row,) = pictures.save(pictures.encode(pixels, "png", level=9), (tmp_path / "out").as_uri(), "png").collect()
    assert row.error is None
    assert codecs.decode("png", Path(row.path).read_bytes())[:4] == (200, 3, "Rgb", "u8")


def test_qoi_by_its_definition():
    body = bytes([0xFE, 10, 20, 30, 0x40 | 3 << 4 | 2 << 2 | 1, 0x80 | 40, 0x9A, 0xC1, (10 * 3 + 20 * 5 + 30 * 7 + 255 * 11) % 64, 0xFF, 1, 2, 3, 4])
    got = codecs.decode("qoi", b"qoif" + struct.pack(">IIBB", 7, 1, 4, 0) + body + b"\0" * 7 + b"\1")[4].reshape(-1, 4).tolist()
    assert got == [[10, 20, 30, 255], [11, 20, 29, 255], [20, 28, 39, 255], [20, 28, 39, 255], [20, 28, 39, 255], [10, 20, 30, 255], [1, 2, 3, 4]]


def test_hdr_round_trip_and_runs():
    v = np.abs(np.random.default_rng(3).normal(size=(4, 9, 3))).astype(np.float32).ravel()
    raw = codecs.encode("hdr", 9, 4, "Rgb", "f32", v)
    got = codecs.decode("hdr", raw)
    assert got[:4] == (9, 4, "Rgb", "f32")
    assert np.abs(got[4] - v).max() <= v.max() / 128
    runs = b"#?RADIANCE\n\n-Y 1 +X 8\n" + b"\2\2\0\x08" + b"\x88\x80" + b"\x88\x40" + b"\4\1\2\3\4\x84\5" + b"\x88\x81"
    assert codecs.decode("hdr", runs)[4].reshape(8, 3).tolist() == [[1.0, 0.5, k / 128] for k in (1, 2, 3, 4, 5, 5, 5, 5)]
    for cut in (5, 30, len(raw) - 1):
        with pytest.raises(ValueError, match=".+"):
            codecs.decode("hdr", raw[:cut])


def fold(shown: list[tuple], w: int, h: int) -> list[list]:
    """The canvas of each GIF frame, pixel by pixel."""
    kept, out = [[0] * 4 for _ in range(w * h)], []
    for left, top, fw, fh, index, dispose, clear, _ in shown:
        now = [list(c) for c in kept]
        for y in range(fh):
            for x in range(fw):
                at, v = (top + y) * w + left + x, index[y * fw + x]
                if v != clear:
                    now[at] = [v * 60, 255 - v * 60, v, 255]
                if dispose == 2:
                    kept[at] = [0] * 4
                elif dispose != 3:
                    kept[at] = list(now[at])
        out.append(now)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "a.gif").write_bytes(gif(3, 2, SHOWN))
    (at / "b.gif").write_bytes(gif(3, 2, SHOWN[::-1]))
    (at / "cut.gif").write_bytes(gif(3, 2, SHOWN)[:30])
    (at / "c.bmp").write_bytes(codecs.encode("bmp", 200, 3, "Rgb", "u8", np.zeros(1800, np.int32)))
    (at / "d.hdr").write_bytes(codecs.encode("hdr", 2, 2, "Rgb", "f32", np.full(12, 0.5)))
    return str(at)


def test_animations_of_files(spark, folder):
    found = pictures.decode_frames(pictures.files(spark, folder).where("format = 'gif'"))
    assert [r.error is None for r in found.where("error is not null or frame_no = 0").orderBy("picture_id").collect()] == [True, True, False]
    got: dict = {}
    for r in pictures.compose(found, blended=False).collect():
        got[r.picture_id[-5:], r.frame_no, r.y * 3 + r.x] = [r.c0, r.c1, r.c2, r.c3]
    for name, shown in (("a.gif", SHOWN), ("b.gif", SHOWN[::-1])):
        for n, canvas in enumerate(fold(shown, 3, 2)):
            assert [got[name, n, k] for k in range(6)] == canvas


def test_limits_hooks_and_kinds(spark, folder):
    found = pictures.files(spark, folder)
    by_name = lambda df: {r.picture_id.rsplit("/", 1)[1]: r for r in df.collect()}
    plain = by_name(pictures.decode(found))
    assert (plain["c.bmp"].w, plain["c.bmp"].error) == (200, None)
    assert plain["cut.gif"].error
    assert plain["d.hdr"].error
    assert by_name(pictures.decode(found, floats=True))["d.hdr"].samples == [0.5] * 12
    assert by_name(pictures.decode(found, max_width=128))["c.bmp"].error == "limits"
    assert by_name(pictures.decode(found, max_alloc=100))["c.bmp"].error == "limits"
    hooked = pictures.decode(found, hooks={"bmp": lambda raw, most: (1, 1, "L", "u8", np.array([len(raw) % 7]))})
    assert by_name(hooked)["c.bmp"].samples == [codecs.encode("bmp", 200, 3, "Rgb", "u8", np.zeros(1800, np.int32)).__len__() % 7]
    assert {(r.path.rsplit("/", 1)[1], r.w, r.h) for r in pictures.sizes(spark, folder).collect()} >= {("a.gif", 3, 2), ("c.bmp", 200, 3), ("d.hdr", 2, 2)}


def streamed(spark, df, at, name: str, mode: str = "append") -> list:
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_files_as_they_arrive(spark, folder, tmp_path):
    stream = arrivals.decoded(spark, folder)
    assert len(streamed(spark, stream.select("picture_id", "w", "h", "error"), tmp_path / "a", "arrived")) == 5
    turned = point.invert(geometry.flip_horizontal(arrivals.pixels(stream, "Rgb"))).pixels
    assert {(r.c0, r.w) for r in streamed(spark, turned, tmp_path / "b", "turned")} == {(255, 200)}
    counts = streamed(spark, arrivals.per_window(spark, folder), tmp_path / "c", "counted", "complete")
    assert {f: sum(r.n for r in counts if r["format"] == f) for f in ("gif", "bmp", "hdr")} == {"gif": 3, "bmp": 1, "hdr": 1}


def test_sizes_from_headers(spark):
    u = lambda *v: struct.pack("<" + "I" * len(v), *v)
    cases = {
        "webp-x": (b"RIFF\0\0\0\0WEBPVP8X" + u(10, 0) + (299).to_bytes(3, "little") + (199).to_bytes(3, "little"), (300, 200)),
        "webp-l": (b"RIFF\0\0\0\0WEBPVP8L" + u(9) + b"\x2f" + u(299 | 199 << 14), (300, 200)),
        "webp": (b"RIFF\0\0\0\0WEBPVP8 " + u(9) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300, 200), (300, 200)),
        "ico": (b"\0\0\1\0\1\0\0\x30", (256, 48)),
        "pnm": (b"P5\n# note\n30 # x\n20\n255\n", (30, 20)),
        "hdr": (b"#?RADIANCE\nFORMAT=x\n\n-Y 7 +X 9\n", (9, 7)),
        "bmp-up": (codecs.encode("bmp", 5, 4, "Rgb", "u8", np.zeros(60, np.int32))[:22] + struct.pack("<i", -4) + b"\0" * 20, (5, 4)),
        "cut": (b"\x89PNG\r\n\x1a\n\0\0", None),
        "none": (b"", None),
        "null": (None, None),
    }
    rows = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, (v, _) in cases.items()], "k string, content binary")
    got = {r.k: tuple(r.d) if r.d else None for r in rows.select("k", metadata.dimensions(F.col("content")).alias("d")).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}


def test_metadata_blocks(spark):
    exif, icc, xmp = b"MM\0*\0\0\0\x08\0\0", b"profile" * 9, b"<x:xmpmeta/>"
    of_png = png(1, 1, b"\0\1\2\3", chunk(b"eXIf", exif), chunk(b"iCCP", b"name\0\0" + zlib.compress(icc)), chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp))
    mark = lambda n, body: b"\xff" + bytes([n]) + struct.pack(">H", len(body) + 2) + body
    of_jpeg = b"\xff\xd8" + mark(0xE1, b"Exif\0\0" + exif) + mark(0xE2, b"ICC_PROFILE\0\2\2" + icc[30:]) + mark(0xE2, b"ICC_PROFILE\0\1\2" + icc[:30]) + mark(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp) + mark(0xED, b"Photoshop 3.0\0iptc") + b"\xff\xd9"
    part = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    of_webp = b"RIFF\0\0\0\0WEBP" + part(b"ICCP", icc) + part(b"EXIF", exif) + part(b"XMP ", xmp)
    rows = spark.createDataFrame([("png", bytearray(of_png)), ("jpeg", bytearray(of_jpeg)), ("webp", bytearray(of_webp)), ("bad", bytearray(of_png[:60])), ("null", None)], "path string, content binary")
    got = {r.path: tuple(bytes(v) if v is not None else None for v in (r.icc, r.exif, r.xmp, r.iptc)) for r in metadata.blocks(rows).collect()}
    assert got == {"png": (icc, exif, xmp, None), "jpeg": (icc, exif, xmp, b"iptc"), "webp": (icc, exif, xmp, None), "bad": (None, exif, None, None), "null": (None,) * 4}


def test_formats_by_content(spark):
    rows = spark.createDataFrame([(bytearray(codecs.encode(f, 1, 1, lay, kind, np.zeros(codecs.CHANNELS[lay], np.int32))), f) for f, lay, kind in (("bmp", "Rgb", "u8"), ("png", "L", "u8"), ("qoi", "Rgb", "u8"), ("farbfeld", "Rgba", "u16"), ("pnm", "Rgba", "u8"), ("hdr", "Rgb", "f32"))], "content binary, f string")
    assert all(r.f == r.g for r in rows.select("f", formats.guess_format(F.col("content")).alias("g")).collect())


def test_delays(spark):
    row = spark.range(1).select(frames.saturating_delay(F.lit(20_000_000)).alias("a"), frames.saturating_delay(F.lit(1)).alias("b"), frames.saturating_delay(F.lit((1 << 62))).alias("c"), frames.hundredths(frames.delay(F.lit(10_000_000), F.lit(1))).alias("d")).first()
    assert (tuple(row.a), tuple(row.b), row.d) == ((20, 1), (1, 1_000_000), 65535)
    assert tuple(row.c) == ((1 << 32) - 1, 1)
