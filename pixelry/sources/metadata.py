"""What picture files tell without being decoded: sizes, orientation, and blocks of EXIF, ICC, XMP and IPTC data."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelry.sources import codecs


def _number(hexed: Column, at: Column | int, n: int, little: bool | Column) -> Column:
    """Unsigned number of n bytes at a place of bytes that are given as hexadecimal digits."""
    digits = [F.substring(hexed, (F.lit(at) + k) * 2 + 1, F.lit(2)) for k in range(n)]
    big, small = F.concat(*digits), F.concat(*digits[::-1])
    text = F.when(little, small).otherwise(big) if isinstance(little, Column) else small if little else big
    return F.conv(F.nullif(text, F.lit("")), 16, 10).cast("long")


def dimensions(content: Column) -> Column:
    """w and h as a header of PNG, GIF, BMP, farbfeld, QOI, ICO, PNM, HDR or WebP states them; null for others and cut files."""
    head = F.substring(content, 1, 64)
    h = F.lower(F.hex(head))
    enough = lambda n: F.octet_length(head) >= n
    num = lambda at, n, little: _number(h, at, n, little)
    size = lambda w, t: F.struct(w.alias("w"), t.alias("h"))
    text = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    pnm, hdr = r"^P[1-6](?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)", r"(?s)^#\?R.*?-Y (\d+) \+X (\d+)\n"
    group = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("long")
    short = lambda at: num(at, 2, True).bitwiseAND(0x3FFF)
    return (
        F.when(h.startswith("89504e470d0a1a0a") & enough(24), size(num(16, 4, False), num(20, 4, False)))
        .when(h.startswith("47494638") & enough(10), size(num(6, 2, True), num(8, 2, True)))
        .when(h.startswith("424d") & enough(26) & (num(14, 4, True) == 12), size(num(18, 2, True), num(20, 2, True)))
        .when(h.startswith("424d") & enough(26), size(num(18, 4, True), F.least(num(22, 4, True), (1 << 32) - num(22, 4, True))))
        .when(h.startswith("6661726266656c64") & enough(16), size(num(8, 4, False), num(12, 4, False)))
        .when(h.startswith("716f6966") & enough(12), size(num(4, 4, False), num(8, 4, False)))
        .when(h.startswith("00000100") & enough(8), size((num(6, 1, True) + 255) % 256 + 1, (num(7, 1, True) + 255) % 256 + 1))
        .when(h.rlike("^52494646.{8}5745425056503858") & enough(30), size(num(24, 3, True) + 1, num(27, 3, True) + 1))
        .when(h.rlike("^52494646.{8}574542505650384c") & enough(25), size(short(21) + 1, F.shiftright(num(21, 4, True), 14).bitwiseAND(0x3FFF) + 1))
        .when(h.rlike("^52494646.{8}5745425056503820") & enough(30), size(short(26), short(28)))
        .when(text.rlike(pnm), size(group(pnm, 1), group(pnm, 2)))
        .when(text.rlike(hdr), size(group(hdr, 2), group(hdr, 1)))
    )


def _orientation_entry(chunk: bytes | None) -> tuple[int, int, str] | None:
    """Orientation, place of its two bytes and their order, of an EXIF block (TIFF structure, tag 0x0112, one SHORT)."""
    if not chunk or len(chunk) < 8 or chunk[:4] not in (b"II*\0", b"MM\0*"):
        return None
    order = "little" if chunk[:2] == b"II" else "big"
    num = lambda a, n: int.from_bytes(chunk[a : a + n], order)
    at = num(4, 4)
    for entry in range(at + 2, min(at + 2 + 12 * num(at, 2), len(chunk) - 11), 12):
        if num(entry, 2) == 0x112 and num(entry + 2, 2) == 3 and num(entry + 4, 4) == 1:
            return (num(entry + 8, 2), entry + 8, order) if 1 <= num(entry + 8, 2) <= 8 else None
    return None


def orientation(exif: Column) -> Column:
    """Orientation 1 to 8 that an EXIF block states, else null."""

    @F.pandas_udf("int")
    def found(chunks: pd.Series) -> pd.Series:
        return pd.Series([e[0] if (e := _orientation_entry(c)) else None for c in chunks], dtype="Int32")

    return found(exif)


def without_orientation(exif: Column) -> Column:
    """The block with an orientation of 1 where it states another one; unchanged where it states none."""

    @F.pandas_udf("binary")
    def cleared(chunks: pd.Series) -> pd.Series:
        return pd.Series([c[: e[1]] + (1).to_bytes(2, e[2]) + c[e[1] + 2 :] if (e := _orientation_entry(c)) else c for c in chunks], dtype=object)

    return cleared(exif)


def to_exif(orientation: Column) -> Column:
    """The number of an orientation that is one of 1 to 8, else null."""
    return F.when(orientation.between(1, 8), orientation).cast("int")


def _jpeg_blocks(raw: bytes) -> dict[str, bytes]:
    out, profile, at = {}, {}, 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] not in (0xDA, 0xD9):
        mark, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            out.setdefault("exif", body[6:])
        elif mark == 0xE1 and body[:29] == b"http://ns.adobe.com/xap/1.0/\0":
            out.setdefault("xmp", body[29:])
        elif mark == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(body) > 14:
            profile[body[12]] = body[14:]
        elif mark == 0xED and body[:14] == b"Photoshop 3.0\0":
            out.setdefault("iptc", body[14:])
        at += 2 + size
    if profile:
        out["icc"] = b"".join(v for _, v in sorted(profile.items()))
    return out


def _png_blocks(raw: bytes) -> dict[str, bytes]:
    out = {}
    for name, body in codecs.png_chunks(raw):
        if name == b"eXIf":
            out.setdefault("exif", body)
        elif name == b"iCCP":
            out.setdefault("icc", zlib.decompress(body.split(b"\0", 1)[1][1:]))
        elif name == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0"):
            rest = body[18:]
            text = rest[2:].split(b"\0", 2)[2]
            out.setdefault("xmp", zlib.decompress(text) if rest[0] else text)
    return out


def _webp_blocks(raw: bytes) -> dict[str, bytes]:
    out, at = {}, 12
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        key = {b"EXIF": "exif", b"ICCP": "icc", b"XMP ": "xmp"}.get(name)
        if key and at + 8 + size <= len(raw):
            out.setdefault(key, raw[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def blocks(files: DataFrame) -> DataFrame:
    """path, icc, exif, xmp and iptc of `files` (path and content), of PNG, JPEG and WebP; null where there is none or it is broken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                raw, found = content.as_py() or b"", {}
                try:
                    found = _png_blocks(raw) if raw[:4] == b"\x89PNG" else _jpeg_blocks(raw) if raw[:2] == b"\xff\xd8" else _webp_blocks(raw) if raw[:4] == b"RIFF" else {}
                except (zlib.error, IndexError, struct.error):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), *(pa.array([found.get(k)], pa.binary()) for k in ("icc", "exif", "xmp", "iptc"))], names=["path", "icc", "exif", "xmp", "iptc"])

    return files.select("path", "content").mapInArrow(run, "path string, icc binary, exif binary, xmp binary, iptc binary")
