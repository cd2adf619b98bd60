"""Picture files as rows, and rows as encoded pictures.

A file that cannot be decoded, or exceeds a limit, gives a row with an error instead of failing the job.
Sizes that a header states are read by column functions, so limits hold before a file is decoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelry.operators import frames, generate
from pixelry.plans.raster import Raster
from pixelry.sources import codecs, formats, headers, metadata, profiles
from pixelry.sources import hooks as registry
from pixelry.sources.saving import save

__all__ = ["compose", "decode", "decode_frames", "encode", "encode_frames", "files", "rasters", "read", "read_corrected", "save", "sizes"]

Decoder = Callable[[bytes, int], codecs.Picture]

PICTURES = "picture_id string, format string, w int, h int, layout string, kind string, samples array<int>, error string"


def decode(files: DataFrame, max_alloc: int | None = 512 << 20, max_width: int | None = None, max_height: int | None = None, hooks: dict[str, Decoder] | None = None, floats: bool = False) -> DataFrame:
    """Pictures of `files` (path, content and format).

    hooks: further decoders by format, which come first; those of the registry come next.  floats: samples are floats, and formats of whole
    numbers give errors; else it is the other way round.
    """
    most, known, size = max_alloc if max_alloc is not None else 1 << 62, {**registry.decoders(), **(hooks or {})}, metadata.dimensions(F.col("content"))
    fits = F.coalesce(formats.within_limits(size["w"], size["h"], F.lit(1), max_width, max_height, max_alloc), F.lit(True))
    types = {"picture_id": pa.string(), "format": pa.string(), "w": pa.int32(), "h": pa.int32(), "layout": pa.string(), "kind": pa.string(), "samples": pa.list_(pa.float32() if floats else pa.int32()), "error": pa.string()}

    def decoder(name: str) -> Decoder:
        return registry.resolve(known[name]) if isinstance(known[name], str) else known[name]

    def found(raw: bytes, name: str | None, fit: bool) -> dict:
        if not fit:
            raise ValueError("limits")
        row = dict(zip(("w", "h", "layout", "kind", "samples"), decoder(name)(raw, most) if name in known else codecs.decode(name, raw, most), strict=True))
        if (row["kind"] == "f32") != floats:
            raise ValueError("samples of another type")
        if (max_width is not None and row["w"] > max_width) or (max_height is not None and row["h"] > max_height):
            raise ValueError("limits")
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw, name, fit in zip(*(batch.column(i) for i in range(4)), strict=True):
                row = {"picture_id": path.as_py(), "format": name.as_py()}
                try:
                    row |= found(raw.as_py() or b"", row["format"], fit.as_py())
                except ValueError as e:
                    row["error"] = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in types.items()], names=list(types))

    return files.select("path", "content", "format", fits.alias("fits")).mapInArrow(run, PICTURES.replace("array<int>", "array<float>") if floats else PICTURES)


FRAME = "picture_id string, frame_no int, w int, h int, loops int, left int, top int, width int, height int, dispose string, blend string, numer long, denom long, samples array<int>, error string"


def decode_frames(files: DataFrame, max_alloc: int = 512 << 20) -> DataFrame:
    """A row for each frame of the animations among `files` (path, content and format), with its own region's Rgba samples; or one with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FRAME.split(", ")]
        types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in FRAME.split(", ")]
        for batch in batches:
            for path, raw, name in zip(*(batch.column(i) for i in range(3)), strict=True):
                try:
                    w, h, loops, frames = codecs.decode_frames(name.as_py(), raw.as_py() or b"", max_alloc)
                    rows = [{"picture_id": path.as_py(), "frame_no": i, "w": w, "h": h, "loops": loops, **f} for i, f in enumerate(frames)]
                except ValueError as e:
                    rows = [{"picture_id": path.as_py(), "error": str(e)}]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(names, types, strict=True)], names=names)

    return files.select("path", "content", "format").mapInArrow(run, FRAME)


def compose(decoded: DataFrame, blended: bool) -> DataFrame:
    """Canvas pixels of all frames of `decode_frames`; blended: by the rule of APNG, else by that of GIF."""
    good = decoded.where("error is null")
    own = good.select("picture_id", "frame_no", "width", "samples", F.explode(F.sequence(F.lit(0), F.expr("width * height - 1"))).alias("p"))
    pixels = own.select("picture_id", "frame_no", F.expr("p % width").alias("x"), F.expr("p div width").cast("int").alias("y"), *(F.element_at("samples", F.col("p") * 4 + i + 1).alias(f"c{i}") for i in range(4)))
    return (frames.compose_blended if blended else frames.compose_transparent)(good.drop("samples", "error", "numer", "denom", "loops"), pixels)


def files(spark: SparkSession, path: str, guess: bool = False, stream: bool = False) -> DataFrame:
    """The files at `path` with their format: by extension, with guess first by content, where registered signatures come first.  stream: files as they arrive."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    found = reader.format("binaryFile").load(path)
    ended = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    name = F.coalesce(F.when(ended.isin(*registry.decoders()), ended) if registry.decoders() else F.lit(None).cast("string"), formats.from_path(F.col("path")))
    return found.withColumn("format", F.coalesce(registry.guessed(F.col("content")), formats.guess_format(F.col("content")), name) if guess else name)


def read(spark: SparkSession, path: str, guess: bool = False, max_alloc: int | None = 512 << 20, max_width: int | None = None, max_height: int | None = None, stream: bool = False) -> DataFrame:
    """Pictures of the files at `path`."""
    return decode(files(spark, path, guess, stream), max_alloc, max_width, max_height)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, w, h of the files at `path`, from ranged reads of their headers; null where a header does not tell."""
    return headers.read(spark, path).select("path", "w", "h")


def rasters(pictures: DataFrame, layout: str, kind: str = "u8") -> Raster:
    """The pixel relation of the pictures of one layout and sample type."""
    return generate.from_raw(pictures.where((F.col("layout") == layout) & (F.col("kind") == kind)), "samples", layout, kind)


def read_corrected(spark: SparkSession, path: str, layout: str = "Rgb", kind: str = "u8", target: tuple[str, str] = ("srgb", "srgb"), guess: bool = False, orient: bool = True) -> Raster:
    """The pictures of one layout and sample type at `path`, in one colour space by their embedded profiles, and upright by their EXIF blocks."""
    found = files(spark, path, guess)
    return profiles.corrected(rasters(decode(found), layout, kind), profiles.spaces(metadata.blocks(found)), target, orient)


def encode(r: Raster, name: str, **options) -> DataFrame:
    """picture_id, content and error of each picture in a format; options: of the format's writer."""
    layout, kind = r.layout, r.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for picture_id, w, h, samples in zip(*(batch.column(i) for i in range(4)), strict=True):
                content = error = None
                try:
                    content = codecs.encode(name, w.as_py(), h.as_py(), layout, kind, samples.values.to_numpy().astype(np.float64 if kind == "f32" else np.int64), **options)
                except ValueError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([picture_id.as_py()], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["picture_id", "content", "error"])

    return generate.into_raw(r).mapInArrow(run, "picture_id string, content binary, error string")


def encode_frames(decoded: DataFrame, loops: int = 0, level: int = -1) -> DataFrame:
    """picture_id, content and error: the frames of each picture (rows as of `decode_frames`) as one animated PNG; a picture with a frame that has an error gives the first such error."""
    own = F.struct("frame_no", "left", "top", "width", "height", "dispose", "blend", "numer", "denom", "samples")
    good = F.col("error").isNull()
    listed = decoded.groupBy("picture_id").agg(F.max(F.when(good, F.col("w"))).alias("w"), F.max(F.when(good, F.col("h"))).alias("h"), F.array_sort(F.collect_list(F.when(good, own))).alias("frames"), F.min(F.when(~good, F.struct(F.coalesce("frame_no", F.lit(-1)), "error"))).alias("failed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for picture_id, w, h, frames, failed in zip(*(batch.column(i) for i in range(5)), strict=True):
                content, error = None, failed.as_py()
                try:
                    content = None if error else codecs.write_animation(w.as_py(), h.as_py(), frames.as_py(), loops, level)
                except ValueError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([picture_id.as_py()], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["picture_id", "content", "error"])

    return listed.select("picture_id", "w", "h", "frames", "failed.error").mapInArrow(run, "picture_id string, content binary, error string")
