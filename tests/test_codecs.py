"""Codecs: round trips, hand-made files, truncation, and files as tables."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from pixelry.sources import codecs, formats, pictures

SIZES = [(1, 1), (2, 2), (3, 2), (7, 1), (9, 3), (100, 10)]
HOLDS = [("farbfeld", "Rgba", "u16")] + [("pnm", x, k) for x in codecs.CHANNELS for k in ("u8", "u16")] + [("bmp", x, "u8") for x in ("Rgb", "Rgba")] + [("qoi", x, "u8") for x in ("Rgb", "Rgba")] + [("tga", x, "u8") for x in codecs.CHANNELS] + [("ico", x, "u8") for x in codecs.CHANNELS] + [("png", x, k) for x in codecs.CHANNELS for k in ("u8", "u16")]


def some(w: int, h: int, layout: str, kind: str) -> np.ndarray:
    return np.random.default_rng(w * h).integers(0, 256 if kind == "u8" else 65536, w * h * codecs.CHANNELS[layout]).astype(np.int32)


@pytest.mark.parametrize(("name", "layout", "kind"), HOLDS)
def test_round_trip_and_truncation(name, layout, kind):
    for w, h in SIZES:
        v = some(w, h, layout, kind)
        raw = codecs.encode(name, w, h, layout, kind, v)
        got = codecs.decode(name, raw)
        assert got[:4] == (w, h, layout, kind)
        assert (got[4] == v).all()
    for cut in range(0, len(raw) - 13, 37):
        with pytest.raises(ValueError, match=".+"):
            codecs.decode(name, raw[:cut])
    with pytest.raises(ValueError, match="limits"):
        codecs.decode(name, raw, most=100)


def test_pnm_kinds():
    assert codecs.decode("pnm", b"P1\n# note\n3 2\n1 0 1\n010")[4].tolist() == [0, 255, 0, 255, 0, 255]
    assert codecs.decode("pnm", b"P4 9 1\n\xaa\x80")[4].tolist() == [0, 255] * 4 + [0]
    assert codecs.decode("pnm", b"P2 2 1 15 0 15")[4].tolist() == [0, 255]
    assert codecs.decode("pnm", b"P3 1 1 # c\n255 1 2 3")[:4] == (1, 1, "Rgb", "u8")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    """Rows filtered one byte at a time, by the definition of each filter."""
    w, h, n = 5, 4, 3
    v = some(w, h, "Rgb", "u8").reshape(h, w * n)
    body = b""
    for y in range(h):
        body += bytes([kind])
        for x in range(w * n):
            a = int(v[y, x - n]) if x >= n else 0
            b = int(v[y - 1, x]) if y else 0
            c = int(v[y - 1, x - n]) if y and x >= n else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            body += bytes([(int(v[y, x]) - (0, a, b, (a + b) // 2, nearest)[kind]) % 256])
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert (codecs.decode("png", raw)[4] == v.ravel()).all()


def test_png_palette_and_low_depth():
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    make = lambda w, depth, colour, rows, *more: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, 1, depth, colour, 0, 0, 0)) + b"".join(more) + chunk(b"IDAT", zlib.compress(b"\0" + rows))
    assert codecs.decode("png", make(3, 1, 0, b"\xa0"))[4].tolist() == [255, 0, 255]
    palette = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    assert codecs.decode("png", make(2, 4, 3, b"\x10", palette))[4].tolist() == [4, 5, 6, 1, 2, 3]
    assert codecs.decode("png", make(2, 4, 3, b"\x10", palette, chunk(b"tRNS", b"\x07")))[4].tolist() == [4, 5, 6, 255, 1, 2, 3, 7]
    with pytest.raises(ValueError, match="palette"):
        codecs.decode("png", make(2, 4, 3, b"\x30", palette))


def test_files_as_tables(spark, tmp_path):
    v = some(3, 2, "Rgb", "u8")
    (tmp_path / "a.png").write_bytes(codecs.encode("png", 3, 2, "Rgb", "u8", v))
    (tmp_path / "b.ppm").write_bytes(codecs.encode("pnm", 3, 2, "Rgb", "u8", v))
    (tmp_path / "c.txt").write_bytes(codecs.encode("png", 3, 2, "Rgb", "u8", v))
    (tmp_path / "d.png").write_bytes(b"?")
    (tmp_path / "e.webp").write_bytes(b"RIFF1234WEBP")
    got = {r.picture_id[-5:]: r for r in pictures.read(spark, str(tmp_path)).collect()}
    assert got["a.png"].samples == got["b.ppm"].samples == v.tolist()
    assert all(got[n].error for n in ("c.txt", "d.png", ".webp"))
    found = pictures.read(spark, str(tmp_path), guess=True)
    assert found.where("error is null").count() == 3
    pixels = pictures.rasters(found, "Rgb")
    assert pixels.pixels.count() == 18
    for r in pictures.encode(pixels, "png").collect():
        assert codecs.decode("png", bytes(r.content))[4].tolist() == v.tolist()
    assert all(r.error for r in pictures.encode(pixels, "farbfeld").collect())


def test_stated_formats_have_codecs():
    assert {f for f, _, _, r, _ in formats.FORMATS if r} == codecs.READERS.keys()
    assert {f for f, _, _, _, w in formats.FORMATS if w} == codecs.WRITERS.keys()
