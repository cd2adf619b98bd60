"""Headers of picture files as a data source: size, layout and sample type from a few ranged reads of each file.

`spark.read.format("picture_headers").load(path)`, or `USING picture_headers` in SQL, gives a row for each file
below a folder.  Folders are partitions, and files beside one another are dealt in runs of FILES.  Of each
file the first HEAD bytes are read, and where its size stands further on (JPEG, TIFF) the pieces on the way.
Options: path, hooks (the text of `hooks.as_option()`), glob (a pattern of the names to read).
"""

from __future__ import annotations

import fnmatch
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pixelry.sources import formats, hooks

FORMAT = "picture_headers"
HEAD, FILES = 512, 1000
SCHEMA = "path string, length long, format string, w long, h long, layout string, kind string, bytes_read long, error string"

Ranged = Callable[[int, int], bytes]  # place and number of bytes


def guess_format(head: bytes) -> str | None:
    for magic, name in formats.MAGIC:
        if re.match(magic, head[: len(magic) // 2 + 1].hex()):
            return name
    return None


def _png(read: Ranged) -> tuple:
    w, h, bits, kind = struct.unpack(">IIBB", read(16, 10))
    return w, h, {0: "L", 2: "Rgb", 3: "Rgb", 4: "La", 6: "Rgba"}[kind], "u16" if bits == 16 else "u8"


def _bmp(read: Ranged) -> tuple:
    head = read(14, 16)
    if struct.unpack_from("<I", head)[0] == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", head, 4)
    else:
        w, h, _, bits = struct.unpack_from("<iiHH", head, 4)
    return w, abs(h), "Rgba" if bits == 32 else "Rgb", "u8"


def _jpeg(read: Ranged) -> tuple:
    at = 2
    while True:
        mark, size = struct.unpack(">HH", read(at, 4))
        if mark >> 8 != 0xFF:
            raise ValueError("broken header")
        if 0xC0 <= mark & 0xFF <= 0xCF and mark & 0xFF not in (0xC4, 0xC8, 0xCC):
            bits, h, w, n = struct.unpack(">BHHB", read(at + 4, 6))
            return w, h, {1: "L", 3: "Rgb", 4: "Cmyk"}[n], "u16" if bits > 8 else "u8"
        at += 2 + size if mark != 0xFFFF else 1  # fill bytes may come before a marker


def _tiff(read: Ranged) -> tuple:
    order = "<" if read(0, 2) == b"II" else ">"
    at = struct.unpack(f"{order}I", read(4, 4))[0]
    n = struct.unpack(f"{order}H", read(at, 2))[0]
    tags: dict[int, int] = {}
    entries = read(at + 2, 12 * n)
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", entries, 12 * i)
        value = struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", entries, 12 * i + 8)[0]
        if tag == 258 and count > 2:  # several bits per sample stand elsewhere
            value = struct.unpack(f"{order}H", read(value, 2))[0]
        tags[tag] = value
    return tags[256], tags[257], {1: "L", 2: "La", 3: "Rgb", 4: "Rgba"}[tags.get(277, 1)], {8: "u8", 16: "u16", 32: "f32"}.get(tags.get(258, 1), "u8")


def _webp(read: Ranged) -> tuple:
    head = read(12, 18)
    if head[:4] == b"VP8X":
        return int.from_bytes(head[12:15], "little") + 1, int.from_bytes(head[15:18], "little") + 1, "Rgba" if head[8] & 0x10 else "Rgb", "u8"
    if head[:4] == b"VP8L":
        v = int.from_bytes(head[9:13], "little")
        return (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1, "Rgba" if v >> 28 & 1 else "Rgb", "u8"
    return *(x & 0x3FFF for x in struct.unpack_from("<HH", head, 14)), "Rgb", "u8"


def _pnm(read: Ranged) -> tuple:
    text = read(0, HEAD).decode("latin-1")
    kind = text[1]
    if kind == "7":
        field = {k: v for k, v in re.findall(r"(?m)^(WIDTH|HEIGHT|DEPTH|MAXVAL)\s+(\d+)", text)}
        return int(field["WIDTH"]), int(field["HEIGHT"]), {"1": "L", "2": "La", "3": "Rgb", "4": "Rgba"}[field["DEPTH"]], "u16" if int(field["MAXVAL"]) > 255 else "u8"
    numbers = re.match(r"P\d(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?", text)
    return int(numbers[1]), int(numbers[2]), "Rgb" if kind in "36" else "L", "u16" if kind not in "14" and int(numbers[3] or 0) > 255 else "u8"


def _hdr(read: Ranged) -> tuple:
    found = re.search(r"-Y (\d+) \+X (\d+)\n", read(0, HEAD).decode("latin-1"))
    return int(found[2]), int(found[1]), "Rgb", "f32"


def _exr(read: Ranged) -> tuple:
    at = 8
    while (name := read(at, 96).split(b"\0")[:2])[0]:
        at += len(name[0]) + len(name[1]) + 2
        size = struct.unpack("<I", read(at, 4))[0]
        if name[0] == b"dataWindow":
            x0, y0, x1, y1 = struct.unpack("<4i", read(at + 4, 16))
            return x1 - x0 + 1, y1 - y0 + 1, None, "f32"
        at += 4 + size
    raise ValueError("broken header")


def _avif(read: Ranged) -> tuple:
    head = read(0, 8 * HEAD)
    at = head.index(b"ispe")
    return *struct.unpack_from(">II", head, at + 8), None, None


READERS: dict[str, Callable[[Ranged], tuple]] = {
    "png": _png, "bmp": _bmp, "jpeg": _jpeg, "tiff": _tiff, "webp": _webp, "pnm": _pnm, "hdr": _hdr, "exr": _exr, "avif": _avif,
    "gif": lambda read: (*struct.unpack("<HH", read(6, 4)), "Rgba", "u8"),
    "farbfeld": lambda read: (*struct.unpack(">II", read(8, 8)), "Rgba", "u16"),
    "qoi": lambda read: (*struct.unpack(">II", (head := read(4, 9))[:8]), {3: "Rgb", 4: "Rgba"}[head[8]], "u8"),
    "ico": lambda read: (*((v + 255) % 256 + 1 for v in read(6, 2)), "Rgba", "u8"),
    "tga": lambda read: (*struct.unpack("<HH", read(12, 4)), {8: "L", 16: "Rgb", 24: "Rgb", 32: "Rgba"}[read(16, 1)[0]], "u8"),
}


class Window:
    """Ranged reads of a file that begin with its head, and how many bytes they took."""

    def __init__(self, source, length: int):
        self.source, self.length = source, length
        self.head = source.read_at(min(HEAD, length), 0) if length else b""
        self.taken = len(self.head)

    def __call__(self, at: int, n: int) -> bytes:
        if at + n <= len(self.head):
            return self.head[at : at + n]
        n = max(0, min(n, self.length - at))
        self.taken += n
        return self.source.read_at(n, at) if n else b""


@dataclass
class Files(InputPartition):
    folder: str | None  # all files below it
    paths: tuple[tuple[str, int], ...] = ()


class _Reader(DataSourceReader):
    def __init__(self, path: str, pattern: str, given: str | None):
        self.path, self.pattern, self.given = path, pattern, given

    def _store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return fs, store, root.rstrip("/") or "/"

    def _wanted(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return not name.startswith(("_", ".")) and fnmatch.fnmatch(name, self.pattern)

    def partitions(self) -> list[InputPartition]:
        fs, store, root = self._store()
        if store.get_file_info(root).type == fs.FileType.File:
            return [Files(None, ((root, store.get_file_info(root).size),))]
        found = store.get_file_info(fs.FileSelector(root))  # one level: what is below a folder is listed by its task
        folders = [x.path for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith(("_", "."))]
        own = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and self._wanted(x.path))
        return [*(Files(f) for f in sorted(folders)), *(Files(None, tuple(own[i : i + FILES])) for i in range(0, len(own), FILES))]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, store, _ = self._store()
        decoders, own_headers, signatures = hooks.from_option(self.given)
        paths = partition.paths
        if partition.folder is not None:
            below = store.get_file_info(fs.FileSelector(partition.folder, recursive=True))
            hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(partition.folder) :].split("/"))
            paths = sorted((x.path, x.size) for x in below if x.type == fs.FileType.File and self._wanted(x.path) and not hidden(x.path))
        for path, length in paths:
            name, found, error, taken = None, (None,) * 4, None, 0
            try:
                with store.open_input_file(path) as source:
                    window = Window(source, length)
                    ended = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else None
                    name = hooks.guess(window.head, signatures) or (ended if ended in decoders else None) or guess_format(window.head) or {e: f for f, exts, *_ in formats.FORMATS for e in exts.split()}.get(ended)
                    own = hooks.resolve(own_headers[name]) if name in own_headers else None if name in decoders else READERS.get(name)
                    if own is None:
                        error = "unknown format"
                    else:
                        found = own(window)
                    taken = window.taken
            except (ValueError, KeyError, IndexError, TypeError, struct.error, OSError, ImportError, AttributeError) as e:
                error, found = f"broken header: {e}" if name else str(e), (None,) * 4
            yield (path, length, name, *found, taken, error)


class PictureHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("glob", "*"), self.options.get("hooks"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PictureHeaders)


def read(spark: SparkSession, path: str, **options: str):
    """Rows of SCHEMA for the files below `path`; hooks registered so far are used."""
    register(spark)
    return spark.read.format(FORMAT).options(**{"hooks": hooks.as_option(), **options}).load(path)
