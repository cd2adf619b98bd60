"""Palettes: trained for each picture from its own colours, and the nearest colours of palettes.

Training groups a picture's pixels to cells of colour space (at most CELLS of them, with their weight and
mean colours), then cuts the cells into boxes where they are spread widest, and moves the boxes' means a few
times to the middle of what is nearest to them.  Lookups search a k-d tree, tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelry.plans import tiles
from pixelry.plans.raster import Raster

#: Cells of colour space of a picture, as bits; points of a leaf of a k-d tree; rounds that move the colours.
CELL_BITS, LEAF, ROUNDS = 15, 16, 4


class Tree:
    """Nearest colours by squared distance, the least index of equals."""

    def __init__(self, colours: np.ndarray, index: np.ndarray | None = None):
        self.colours = np.asarray(colours, np.float64)
        self.index = np.arange(len(self.colours)) if index is None else np.asarray(index)

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """Index of each point's nearest colour; -1 where there are no colours."""
        self.points = np.asarray(points, np.float64)
        self.far = np.full(len(points), np.inf)
        self.best = np.full(len(points), np.iinfo(np.int64).max)
        if not len(self.colours):
            return np.full(len(points), -1)
        self._search(np.arange(len(self.colours)), np.arange(len(points)))
        return self.best

    def _search(self, own: np.ndarray, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if len(own) <= LEAF:
            for k in own.tolist():
                d = ((self.points[asked] - self.colours[k]) ** 2).sum(1)
                better = (d < self.far[asked]) | ((d == self.far[asked]) & (self.index[k] < self.best[asked]))
                self.far[asked[better]], self.best[asked[better]] = d[better], self.index[k]
            return
        spread = np.ptp(self.colours[own], axis=0)
        axis = int(spread.argmax())
        order = own[np.argsort(self.colours[own, axis], kind="stable")]
        half = len(order) // 2
        low, high = order[:half], order[half:]
        edge_low, edge_high = self.colours[low[-1], axis], self.colours[high[0], axis]
        at = self.points[asked, axis]
        first_low = at < (edge_low + edge_high) / 2
        self._search(low, asked[first_low])
        self._search(high, asked[~first_low])
        # the other side, where its nearest place is no further than the best so far
        other = np.maximum(0, edge_high - at[first_low]) ** 2 <= self.far[asked[first_low]]
        self._search(high, asked[first_low][other])
        other = np.maximum(0, at[~first_low] - edge_low) ** 2 <= self.far[asked[~first_low]]
        self._search(low, asked[~first_low][other])


def _cut(v: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n colours at most: the box with the most weighted spread is cut at its mean along its widest axis, again and again."""
    boxes = [np.arange(len(v))]

    def spread(box: np.ndarray) -> tuple[float, int, float]:
        w = weight[box][:, None]
        mean = (v[box] * w).sum(0) / w.sum()
        each = ((v[box] - mean) ** 2 * w).sum(0)
        return float(each.max()), int(each.argmax()), float(mean[each.argmax()])

    spreads = [spread(boxes[0])]
    while len(boxes) < n:
        k = max(range(len(boxes)), key=lambda i: spreads[i][0])
        most, axis, middle = spreads[k]
        if most <= 1e-9:
            break
        low = v[boxes[k], axis] <= middle
        one, two = boxes[k][low], boxes[k][~low]
        boxes[k : k + 1], spreads[k : k + 1] = [one, two], [spread(one), spread(two)]
    return np.stack([(v[b] * weight[b][:, None]).sum(0) / weight[b].sum() for b in boxes])


def train(r: Raster, n: int = 256) -> DataFrame:
    """picture_id, idx and c0..: a palette of at most n colours (integers) for each picture.

    Pictures with at most n colours get these; a picture's colours are in rising order.
    """
    if not 1 <= n <= 256 or r.kind == "f32":
        raise ValueError("a palette has 1 to 256 colours of whole numbers")
    names, bits = list(r.names), CELL_BITS // len(r.names)
    shift = max(0, (8 if r.kind == "u8" else 16) - bits)
    exact = r.pixels.groupBy("picture_id", *names).count()
    exact = exact.join(exact.groupBy("picture_id").agg(F.count("*").alias("_all")), "picture_id")
    cells = exact.groupBy("picture_id", *(F.when(F.col("_all") <= n, F.col(c)).otherwise(F.shiftright(c, shift)).alias(f"_{c}") for c in names))
    cells = cells.agg(F.sum("count").alias("n"), *(F.sum(F.col(c).cast("double") * F.col("count")).alias(c) for c in names))
    packed = cells.groupBy("picture_id").agg(F.collect_list(F.struct("n", *names)).alias("cells"))  # 2^CELL_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for picture, found in zip(batch.column("picture_id").to_pylist(), batch.column("cells"), strict=True):
                at = found.values
                weight = at.field("n").to_numpy().astype(np.float64)
                v = np.stack([at.field(c).to_numpy() for c in names], 1) / weight[:, None]
                order = np.lexsort(v.T[::-1])
                v, weight = v[order], weight[order]
                colours = v if len(v) <= n else _cut(v, weight, n)
                for _ in range(ROUNDS if len(v) > n else 0):
                    own = Tree(colours).nearest(v)
                    total = np.bincount(own, weight, len(colours))
                    sums = np.stack([np.bincount(own, weight * v[:, i], len(colours)) for i in range(v.shape[1])], 1)
                    colours = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], colours)
                whole = np.unique(np.floor(colours + 0.5).astype(np.int32), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([picture] * len(whole), pa.string()), pa.array(np.arange(len(whole), dtype=np.int32)), *(pa.array(whole[:, i]) for i in range(len(names)))], names=["picture_id", "idx", *names])

    return packed.mapInArrow(run, "picture_id string, idx int, " + ", ".join(f"{c} int" for c in names))


def index_of(r: Raster, palettes: DataFrame) -> Raster:
    """Index of the nearest colour in the palette of a pixel's own picture (picture_id, idx, c0..), by an equi-join of tiles with palettes.

    The least index of equals; -1 where a picture has no palette.  The result has no colour space.
    """
    t = tiles.from_raster(r)
    names, dtype, n = list(r.names), tiles.DTYPES[r.kind], t.n
    held = palettes.groupBy("picture_id").agg(F.collect_list(F.struct("idx", *names)).alias("palette"))  # 256 rows, or what a user gives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, found in zip(batch.column("samples").to_pylist(), batch.column("palette"), strict=True):
                v = np.frombuffer(raw, dtype).reshape(-1, n)
                if not found.is_valid:
                    out.append(np.full(len(v), -1, "<i4"))
                    continue
                own, back = np.unique(v, axis=0, return_inverse=True)
                at = found.values
                tree = Tree(np.stack([at.field(c).to_numpy() for c in names], 1), at.field("idx").to_numpy())
                out.append(tree.nearest(own)[back.reshape(-1)].astype("<i4"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("picture_id", "w", "h", "tx", "ty")), pa.array([o.tobytes() for o in out], pa.binary())], names=["picture_id", "w", "h", "tx", "ty", "samples"])

    rows = t.rows.join(held, "picture_id", "left").mapInArrow(run, tiles.ROW)
    return tiles.to_raster(tiles.Tiles(rows, "L", "i32", ("unspecified", "unspecified")))


def lookup(r: Raster, palettes: DataFrame, layout: str = "Rgb") -> Raster:
    """Colours of indices, by the palette of each picture; an index that it lacks gives a null colour."""
    names = [c for c in palettes.columns if c not in ("picture_id", "idx")]
    joined = r.pixels.join(palettes.select("picture_id", F.col("idx").alias("c0"), *(F.col(c).alias(f"_{c}") for c in names)), ["picture_id", "c0"], "left")
    return Raster(Raster(joined, "L").select([F.col(f"_{c}") for c in names], layout=layout).pixels, layout, "u8")


def reduce_colors(r: Raster, n: int = 256) -> Raster:
    """Each picture in at most n colours of its own."""
    palettes = train(r, n)
    return r.over(lookup(index_of(r, palettes), palettes, r.layout).pixels)
