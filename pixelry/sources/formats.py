"""Picture formats: names, extensions, MIME types, magic numbers, limits and EXIF orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format, extensions, MIME types (the first is the one to write), readable here, writable here.
FORMATS: list[tuple[str, str, str, bool, bool]] = [
    ("avif", "avif", "image/avif", False, False),
    ("bmp", "bmp", "image/bmp image/x-ms-bmp", True, True),
    ("farbfeld", "ff", "application/octet-stream", True, True),
    ("gif", "gif", "image/gif", True, False),
    ("hdr", "hdr", "image/vnd.radiance", True, True),
    ("ico", "ico", "image/x-icon image/vnd.microsoft.icon", True, True),
    ("jpeg", "jpg jpeg jfif", "image/jpeg", False, False),
    ("exr", "exr", "image/x-exr", False, False),
    ("png", "png apng", "image/png image/apng", True, True),
    ("pnm", "pbm pgm ppm pam pnm", "image/x-portable-anymap image/x-portable-bitmap image/x-portable-graymap image/x-portable-pixmap", True, True),
    ("qoi", "qoi", "image/x-qoi image/qoi", True, True),
    ("tga", "tga", "image/x-targa image/x-tga", True, True),
    ("tiff", "tif tiff", "image/tiff", False, False),
    ("webp", "webp", "image/webp", False, False),
]
# Magic numbers in the order of the tests, as hexadecimal; dots stand for any byte.
MAGIC: list[tuple[str, str]] = [
    ("89504e470d0a1a0a", "png"), ("ffd8ff", "jpeg"), ("474946383961", "gif"), ("474946383761", "gif"), ("52494646........57454250", "webp"),
    ("4d4d002a", "tiff"), ("49492a00", "tiff"), ("424d", "bmp"), ("00000100", "ico"), ("233f52414449414e4345", "hdr"),
    ("5031", "pnm"), ("5032", "pnm"), ("5033", "pnm"), ("5034", "pnm"), ("5035", "pnm"), ("5036", "pnm"), ("5037", "pnm"),
    ("6661726266656c64", "farbfeld"), ("........6674797061766966", "avif"), ("762f3101", "exr"), ("716f6966", "qoi"),
]


def formats(spark: SparkSession) -> DataFrame:
    """format, extensions, mime, mimes, can_read, can_write: one row for each known format."""
    rows = [(f, e.split(), m.split()[0], m.split(), r, w) for f, e, m, r, w in FORMATS]
    return spark.createDataFrame(rows, "format string, extensions array<string>, mime string, mimes array<string>, can_read boolean, can_write boolean")


def _lookup(key: Column, pairs: list[tuple[str, str]]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    return F.try_element_at(table, key)


def from_extension(extension: Column) -> Column:
    return _lookup(F.lower(extension), [(e, f) for f, exts, *_ in FORMATS for e in exts.split()])


def from_path(path: Column) -> Column:
    return from_extension(F.regexp_extract(path, r"\.([^./]+)$", 1))


def from_mime_type(mime: Column) -> Column:
    return _lookup(mime, [(m, f) for f, _, mimes, *_ in FORMATS for m in mimes.split()])


def to_mime_type(name: Column) -> Column:
    return _lookup(name, [(f, mimes.split()[0]) for f, _, mimes, *_ in FORMATS])


def guess_format(content: Column, hooks: list[tuple[str, str]] | None = None) -> Column:
    """Format by the first magic number that fits; hooks (hexadecimal with dots, name) come first."""
    head = F.lower(F.hex(F.substring(content, 1, 64)))
    out = F.lit(None).cast("string")
    for magic, name in reversed([*(hooks or []), *MAGIC]):
        out = F.when(head.rlike(f"^{magic}"), name).otherwise(out)
    return out


def within_limits(width: Column, height: Column, bytes_per_pixel: Column, max_width: int | None = None, max_height: int | None = None, max_alloc: int | None = 512 << 20) -> Column:
    """Whether a picture of that size may be decoded."""
    ok = F.lit(True)
    if max_width is not None:
        ok = ok & (width <= max_width)
    if max_height is not None:
        ok = ok & (height <= max_height)
    if max_alloc is not None:
        ok = ok & (width.cast("bigint") * height.cast("bigint") * bytes_per_pixel <= max_alloc)
    return ok
