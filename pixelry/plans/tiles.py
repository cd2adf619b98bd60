"""The tile relation: one row for each tile of a picture, its samples packed as bytes.

Rows: picture_id, w, h (size of the picture), tx, ty and samples, the tile's lines one after the other,
channels interleaved.  Pixels are packed to fragments of tiles before the exchange, so it moves a few bytes
a pixel; operators that work on tiles can follow one another without going back to pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelry.functions import samples as S
from pixelry.plans.raster import KEY, LAYOUTS, Raster

#: Places of a tile along each axis: rows of tiles are small enough for thousands of them in a batch.
TILE = 64
#: Pixels, and sums of output tiles, that a task holds before it hands them on; points of a tile that one task looks up.
HELD_PIXELS, HELD_SUMS, HOT_POINTS = 1 << 20, 256, 1 << 20
#: Bytes of tiles in a batch that a task hands on.
HELD_BYTES = 1 << 20
DTYPES = {"u8": "u1", "u16": "<u2", "f32": "<f4", "i32": "<i4"}
ROW = "picture_id string, w int, h int, tx int, ty int, samples binary"


@dataclass(frozen=True)
class Tiles:
    rows: DataFrame
    layout: str = "Rgb"
    kind: str = "u8"
    space: tuple[str, str] = ("srgb", "srgb")
    size: int = TILE  # places of a tile along each axis

    @property
    def n(self) -> int:
        return LAYOUTS[self.layout]

    def over(self, rows: DataFrame) -> Tiles:
        return replace(self, rows=rows)


def edges(w: int, h: int, tx: int, ty: int, size: int = TILE) -> tuple[int, int, int, int]:
    """x0, y0, x1, y1 of a tile: the last ones of a line or column may be smaller."""
    return tx * size, ty * size, min(w, (tx + 1) * size), min(h, (ty + 1) * size)


def _packed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group of it begins (and the end)."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    change[:1] = True
    return order, np.append(np.flatnonzero(change), len(order))


def pieces(pixels: DataFrame, names: list[str], dtype: str, size: int = TILE, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of tiles (picture_id, w, h, tx, ty and the integer columns `more`) with place and v: pixels of a task, packed by tile.

    place: the pixels' places in the tile, line by line, of four bytes; v: their samples.
    """
    n, step = len(names), np.dtype(dtype).itemsize * len(names)

    def packed(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        ids = t.column("picture_id").combine_chunks().dictionary_encode()
        w, h, x, y, *rest = (t.column(c).to_numpy() for c in ("w", "h", "x", "y", *more))
        code = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order, at = _grouped([code, h, w, *rest, y // size, x // size])
        first, count = order[at[:-1]], np.diff(at)
        place = ((y % size) * size + x % size).astype("<u4")[order]
        v = np.stack([t.column(c).to_numpy() for c in names], 1).astype(dtype)[order]
        pack = lambda a, each: pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((np.append(0, np.cumsum(count)) * each).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])
        cols = [ids.take(pa.array(first)).cast(pa.string()), *(pa.array(c.astype(np.int32)[first]) for c in (w, h, x // size, y // size, *rest)), pack(place, 4), pack(v, step)]
        return pa.RecordBatch.from_arrays(cols, names=["picture_id", "w", "h", "tx", "ty", *more, "place", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held, count = [*held, batch], count + batch.num_rows
            if count >= HELD_PIXELS:
                yield packed(held)
                held, count = [], 0
        if count:
            yield packed(held)

    return pixels.select(*KEY, *more, *names).mapInArrow(run, "picture_id string, w int, h int, tx int, ty int, " + "".join(f"{c} int, " for c in more) + "place binary, v binary")


def unpacked(piece: dict, dtype: str, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, columns and samples of the pixels of a piece."""
    place = np.frombuffer(piece["place"], "<u4").astype(np.int64)
    return place // size, place % size, np.frombuffer(piece["v"], dtype).reshape(-1, n)


def from_raster(r: Raster, size: int = TILE) -> Tiles:
    """The tiles of a raster: pixels of a task are packed by tile, and the pieces of each tile meet in one exchange.

    Places that have no pixel are zero; of several pixels of one place one stays.
    """
    names, dtype, n = list(r.names), DTYPES[r.kind], LAYOUTS[r.layout]

    def whole(parts: list[dict], w: int, h: int, tx: int, ty: int) -> np.ndarray:
        x0, y0, x1, y1 = edges(w, h, tx, ty, size)
        out = np.zeros((y1 - y0, x1 - x0, n), dtype)
        for p in parts:
            y, x, v = unpacked(p, dtype, n, size)
            out[y, x] = v
        return out

    return Tiles(gathered(pieces(r.pixels, names, dtype, size), whole), r.layout, r.kind, r.space, size)


def gathered(parts: DataFrame, make: Callable[[list[dict], int, int, int, int], np.ndarray]) -> DataFrame:
    """A row for each tile, from all of its parts: rows with the tile's key."""
    key = ("picture_id", "w", "h", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done, size = None, [], [], 0

        def finish() -> int:
            samples = make(held, *now[1:]).tobytes()
            done.append((*now, samples))
            return len(samples)

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), *[pa.int32()] * 4, pa.binary()), strict=True)], names=[*key, "samples"])

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in key)
                if own != now:
                    if held:
                        size += finish()
                        if size >= HELD_BYTES:
                            yield out()
                            size = 0
                    now, held = own, []
                held.append(row)
        if held:
            finish()
        if done:
            yield out()

    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, ROW)


def to_raster(t: Tiles) -> Raster:
    names, dtype, n, real, edge = [f"c{i}" for i in range(t.n)], DTYPES[t.kind], t.n, t.kind == "f32", t.size
    sample = pa.float32() if real else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 16):  # of at most 16 tiles at once
                batch = whole.slice(start, 16)
                rows = batch.drop_columns("samples").to_pylist()
                places = [edges(r["w"], r["h"], r["tx"], r["ty"], edge) for r in rows]
                sizes = [(y1 - y0) * (x1 - x0) for x0, y0, x1, y1 in places]
                v = np.concatenate([np.frombuffer(x.as_buffer(), dtype).reshape(-1, n) for x in batch.column("samples")])
                ids = batch.column("picture_id").take(pa.array(np.repeat(np.arange(len(rows)), sizes)))
                same = [pa.array(np.repeat(np.array([r[c] for r in rows], np.int32), sizes)) for c in ("w", "h")]
                at = [np.arange(size, dtype=np.int32) for size in sizes]
                x = np.concatenate([x0 + a % (x1 - x0) for a, (x0, _, x1, _) in zip(at, places, strict=True)]).astype(np.int32)
                y = np.concatenate([y0 + a // (x1 - x0) for a, (x0, y0, x1, _) in zip(at, places, strict=True)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, *same, pa.array(x), pa.array(y), *(pa.array(v[:, i].astype(np.float32 if real else np.int32), sample) for i in range(n))], names=[*KEY, *names])

    schema = "picture_id string, w int, h int, x int, y int, " + ", ".join(f"{c} {'float' if real else 'int'}" for c in names)
    return Raster(t.rows.mapInArrow(run, schema), t.layout, t.kind, t.space)


def with_halo(t: Tiles, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """ROW, with samples of each tile and so many places around it (less at the picture's edges): tiles give their borders to their neighbours.

    Reaches are at most a tile's size, so a tile has nine parts at most.
    """
    if max(left, top, right, bottom) > t.size:
        raise ValueError("a halo is at most a tile wide")
    dtype, n, size = DTYPES[t.kind], t.n, t.size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w, h, tx, ty = (row[c] for c in ("w", "h", "tx", "ty"))
                x0, y0, x1, y1 = edges(w, h, tx, ty, size)
                v = np.frombuffer(row["samples"], dtype).reshape(y1 - y0, x1 - x0, n)
                out = []
                for oy in (ty - 1, ty, ty + 1):
                    for ox in (tx - 1, tx, tx + 1):
                        a0, b0, a1, b1 = edges(w, h, ox, oy, size)
                        if a0 < 0 or b0 < 0 or a0 >= w or b0 >= h:
                            continue
                        c0, d0, c1, d1 = max(x0, a0 - left), max(y0, b0 - top), min(x1, a1 + right), min(y1, b1 + bottom)
                        if c0 < c1 and d0 < d1:
                            out.append({**{k: row[k] for k in ("picture_id", "w", "h")}, "tx": ox, "ty": oy, "x": c0, "y": d0, "wide": c1 - c0, "v": v[d0 - y0 : d1 - y0, c0 - x0 : c1 - x0].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("picture_id", pa.string()), *((k, pa.int32()) for k in ("w", "h", "tx", "ty", "x", "y", "wide")), ("v", pa.binary())]))

    def whole(parts: list[dict], w: int, h: int, tx: int, ty: int) -> np.ndarray:
        x0, y0, x1, y1 = edges(w, h, tx, ty, size)
        x0, y0, x1, y1 = max(0, x0 - left), max(0, y0 - top), min(w, x1 + right), min(h, y1 + bottom)
        out = np.zeros((y1 - y0, x1 - x0, n), dtype)
        for p in parts:
            v = np.frombuffer(p["v"], dtype).reshape(-1, p["wide"], n)
            out[p["y"] - y0 : p["y"] - y0 + len(v), p["x"] - x0 : p["x"] - x0 + p["wide"]] = v
        return out

    return gathered(t.rows.mapInArrow(cut, ROW.replace("samples binary", "x int, y int, wide int, v binary")), whole)


#: Kernel of a distance (numpy) and its support.
KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {
    "triangle": (lambda t: np.maximum(0.0, 1 - np.abs(t)), 1.0),
    "catmull_rom": (lambda t: np.where(np.abs(t) < 1, (1.5 * np.abs(t) - 2.5) * t * t + 1, np.where(np.abs(t) < 2, ((-0.5 * np.abs(t) + 2.5) * np.abs(t) - 4) * np.abs(t) + 2, 0.0)), 2.0),
    "gaussian": (lambda t: np.exp(-2 * t * t), 3.0),
    "lanczos3": (lambda t: np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0), 3.0),
}


@lru_cache(maxsize=256)
def band(filter_name: str, size: int, new_size: int, start: int, stop: int) -> tuple[int, np.ndarray]:
    """First output place, and the matrix (output places x source places start..stop) of the weights that these source places have."""
    if size == new_size:
        return start, np.eye(stop - start)
    kernel, support = KERNELS[filter_name]
    ratio = size / new_size
    spread = max(ratio, 1.0)
    reach = spread * support + 1
    first, last = max(0, int(np.floor((start - reach) / ratio - 0.5))), min(new_size - 1, int(np.ceil((stop + reach) / ratio - 0.5)))
    o = np.arange(first, last + 1)
    centre = (o + 0.5) * ratio
    low = np.maximum(0, np.minimum(size - 1, np.floor(centre - spread * support))).astype(np.int64)
    high = np.maximum(low + 1, np.minimum(size, np.ceil(centre + spread * support))).astype(np.int64)
    out = np.zeros((len(o), stop - start))
    for k in range(len(o)):
        i = np.arange(low[k], high[k])
        weight = kernel((i + 0.5 - centre[k]) / spread)
        inside = (i >= start) & (i < stop)
        out[k, i[inside] - start] = weight[inside] / weight.sum()
    used = np.flatnonzero(((low < stop) & (high > start)))
    if not len(used):
        return first, out[:0]
    return int(o[used[0]]), out[used[0] : used[-1] + 1]


def rounded(v: np.ndarray, kind: str) -> np.ndarray:
    """Nearest samples of real values, clamped to the type."""
    if kind == "f32":
        return np.clip(v, 0.0, 1.0).astype("<f4")
    return np.clip(np.floor(np.round(v, 6) + 0.5), 0, S.MAX[kind]).astype(DTYPES[kind])


def resize(t: Tiles, new_w: int | Column, new_h: int | Column, filter_name: str) -> Tiles:
    """Pictures of any sizes to a size (numbers, or columns of w and h), in doubles, rounded once.

    A tile's share of the result is a product of the two axes' banded matrices with its samples; shares of a
    task are summed by output tile before the exchange, so a picture shrunk to a few pixels sends only these.
    """
    dtype, n, kind, size = DTYPES[t.kind], t.n, t.kind, t.size
    sized = t.rows.select("*", *((c if isinstance(c, Column) else F.lit(c)).cast("int").alias(k) for k, c in (("_w", new_w), ("_h", new_h)))).where("_w > 0 and _h > 0")
    schema = pa.schema([("picture_id", pa.string()), *((k, pa.int32()) for k in ("w", "h", "tx", "ty", "x", "y", "wide")), ("v", pa.binary())])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            rows = [{"picture_id": k[0], "w": k[1], "h": k[2], "tx": k[3], "ty": k[4], "x": x, "y": y, "wide": v.shape[1], "v": v.tobytes()} for k, (x, y, v) in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                w, h, to_w, to_h = (row[c] for c in ("w", "h", "_w", "_h"))
                x0, y0, x1, y1 = edges(w, h, row["tx"], row["ty"], size)
                v = np.frombuffer(row["samples"], dtype).reshape(y1 - y0, x1 - x0, n).astype(np.float64)
                left, across = band(filter_name, w, to_w, x0, x1)
                top, down = band(filter_name, h, to_h, y0, y1)
                v = np.einsum("oy,yxc->oxc", down, v, optimize=True)
                v = np.einsum("px,oxc->opc", across, v, optimize=True)
                for ty in range(top // size, (top + v.shape[0] - 1) // size + 1):
                    for tx in range(left // size, (left + v.shape[1] - 1) // size + 1):
                        a0, b0, a1, b1 = edges(to_w, to_h, tx, ty, size)
                        c0, d0, c1, d1 = max(left, a0), max(top, b0), min(left + v.shape[1], a1), min(top + v.shape[0], b1)
                        share = v[d0 - top : d1 - top, c0 - left : c1 - left]
                        key = (row["picture_id"], to_w, to_h, tx, ty)
                        if key in sums:
                            x, y, old = sums[key]
                            e0, f0 = min(x, c0), min(y, d0)
                            both = np.zeros((max(y + old.shape[0], d1) - f0, max(x + old.shape[1], c1) - e0, n))
                            both[y - f0 : y - f0 + old.shape[0], x - e0 : x - e0 + old.shape[1]] += old
                            both[d0 - f0 : d1 - f0, c0 - e0 : c1 - e0] += share
                            sums[key] = [e0, f0, both]
                        else:
                            sums[key] = [c0, d0, share]
                if len(sums) >= HELD_SUMS:
                    yield out()
        if sums:
            yield out()

    def whole(parts: list[dict], w: int, h: int, tx: int, ty: int) -> np.ndarray:
        x0, y0, x1, y1 = edges(w, h, tx, ty, size)
        total = np.zeros((y1 - y0, x1 - x0, n))
        for p in parts:
            v = np.frombuffer(p["v"]).reshape(-1, p["wide"], n)
            total[p["y"] - y0 : p["y"] - y0 + len(v), p["x"] - x0 : p["x"] - x0 + p["wide"]] += v
        return rounded(total, kind)

    return t.over(gathered(sized.mapInArrow(shares, ROW.replace("samples binary", "x int, y int, wide int, v binary")), whole))


def sample(t: Tiles, points: DataFrame, x: Column, y: Column, bilinear: bool) -> DataFrame:
    """points (with picture_id) and the channels at the places x, y of their picture; null outside of 0..w-1 and 0..h-1.

    A tile (with one place more to the right and below) is followed by its points in one sorted exchange, so
    all four neighbours are looked up inside one task, which holds one tile.  Tiles with very many points
    are repeated, and their points dealt over them.
    """
    names, dtype, n, kind, size = [f"c{i}" for i in range(t.n)], DTYPES[t.kind], t.n, t.kind, t.size
    place = lambda c: F.expr(f"cast(floor({c}{'' if bilinear else ' + 0.5D'}) div {size} as int)")
    asked = points.select("picture_id", F.struct(*points.columns).alias("_point"), x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    key = ["picture_id", "tx", "ty"]
    dealt = asked.select("*", place("_x").alias("tx"), place("_y").alias("ty"))
    hot = dealt.where("_x >= 0 and _y >= 0").groupBy(*key).count().where(F.col("count") > HOT_POINTS).select(*key, F.ceil(F.col("count") / HOT_POINTS).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    held = (with_halo(t, 0, 0, 1, 1) if bilinear else t.rows).join(hot, key, "left")
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kind_of = dealt.schema["_point"].dataType
    tiles = held.select(*key, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"), F.lit(0).alias("kind"), "w", "h", "samples", nothing("_x", "double"), nothing("_y", "double"), nothing("_point", kind_of))
    rows = dealt.join(hot, key, "left").select(*key, F.pmod(F.monotonically_increasing_id(), blocks).cast("int").alias("salt"), F.lit(1).alias("kind"), nothing("w", "int"), nothing("h", "int"), nothing("samples", "binary"), "_x", "_y", "_point")
    both = tiles.unionByName(rows).repartition(*key, "salt").sortWithinPartitions(*key, "salt", "kind")

    def found(tile: tuple | None, qx: np.ndarray, qy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples at places, and whether they are outside."""
        if tile is None:
            return np.zeros((len(qx), n)), np.ones(len(qx), bool)
        _, tx, ty, w, h, raw = tile
        more = 1 if bilinear else 0
        x0, y0, x1, y1 = edges(w, h, tx, ty, size)
        v = np.frombuffer(raw, dtype).reshape(min(h, y1 + more) - y0, min(w, x1 + more) - x0, n).astype(np.float64)
        outside = ~((qx >= 0) & (qy >= 0) & (qx <= w - 1) & (qy <= h - 1))
        qx, qy = np.where(outside, x0, qx), np.where(outside, y0, qy)
        if not bilinear:
            return v[np.floor(qy + 0.5).astype(int) - y0, np.floor(qx + 0.5).astype(int) - x0], outside
        px, py = np.floor(qx).astype(int), np.floor(qy).astype(int)
        dx, dy = (qx - px)[:, None], (qy - py)[:, None]
        nx, ny = np.minimum(px + 1, w - 1) - x0, np.minimum(py + 1, h - 1) - y0
        px, py = px - x0, py - y0
        mixed = v[py, px] * (1 - dx) * (1 - dy) + v[ny, px] * (1 - dx) * dy + v[py, nx] * dx * (1 - dy) + v[ny, nx] * dx * dy
        return rounded(mixed, kind), outside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            ids, salt = batch.column("picture_id"), batch.column("salt").to_numpy()
            tx, ty, kinds = (batch.column(c).fill_null(-1).to_numpy() for c in ("tx", "ty", "kind"))
            qx, qy = (batch.column(c).fill_null(float("nan")).to_numpy() for c in ("_x", "_y"))
            code = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change = np.ones(len(kinds), bool)
            change[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 0) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1]) | (code[1:] != code[:-1]) | (salt[1:] != salt[:-1])
            first = np.flatnonzero(change)
            for a, b in zip(first.tolist(), np.append(first[1:], len(kinds)).tolist(), strict=True):
                own = (ids[a].as_py(), int(tx[a]), int(ty[a]))
                if kinds[a] == 0:
                    tile = (*own, *(batch.column(c)[a].as_py() for c in ("w", "h", "samples")))
                    continue
                v, outside = found(tile if tile is not None and tile[:3] == own else None, qx[a:b], qy[a:b])
                cols = [pa.array(v[:, i].astype(np.float32 if kind == "f32" else np.int32), mask=outside) for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("_point").slice(a, b - a), *cols], names=["_point", *names])

    schema = T.StructType([T.StructField("_point", kind_of), *(T.StructField(c, T.FloatType() if kind == "f32" else T.IntegerType()) for c in names)])
    return both.mapInArrow(run, schema).select("_point.*", *names)
