"""Approximate nearest neighbours by cross-polytope hashing, exactly reranked.

Vectors are made unit vectors, turned by pseudo-rotations (random signs and a fast Hadamard transform, three
times) and assigned to the nearest signed axis; further rotations refine the bucket until one holds about
LEAF rows.  A query probes the best buckets of each table.  How many are needed is measured on a bounded
sample of queries, against their true neighbours among all rows.  A crowded bucket, as a group of near
copies makes it, is hashed again by what its members differ by from its centre, and exact copies count as
one point, so no bucket grows with a group; what is crowded after that is dealt out in blocks and searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelry.llm.textbuf import binary_array, buffers, dropped, mix, saved, small

TABLES = 6
#: Points of a bucket on average; beyond CROWD a bucket is hashed again, at most ROUNDS times, then dealt in blocks of CROWD.
LEAF, CROWD, ROUNDS = 64, 1024, 3
#: Queries on which the number of probes is fitted, and the share of their neighbours that must be found.
SAMPLE, RECALL = 128, 0.97
#: Members from which a crowded bucket's centre is taken.
CENTRE_ROWS = 64
#: Pairs that a task holds before it keeps only the best of each query.
HELD = 1 << 20
#: A point or query in a bucket of a table; rank is 0 for points and the place among its probes for queries.
NAMES = ["table", "key", "rank", "no", "id", "v"]
ROW = "table int, key long, rank int, no long, id long, v binary"


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in log2(d) steps of sums and differences."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def rotated(x: np.ndarray, *seed: int) -> np.ndarray:
    """A pseudo-rotation of unit vectors (padded with zeros to a power of two)."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), d), np.float32)
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (3, d))
    for s in signs:
        padded = _hadamard(padded * s)
    return padded


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision and without overflow; zero rows stay zero."""
    x = x.astype(np.float64)
    most = np.abs(x).max(1, keepdims=True, initial=0)
    x = np.divide(x, most, out=np.zeros_like(x), where=most > 0)
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=x, where=length > 0)


def _axes(bits: int, d: int) -> list[int]:
    """Axes used of each rotation, so that their signed axes make 2^bits buckets; 0 bits need none."""
    full = 1 + max(0, d - 1).bit_length()
    return [1 << (min(full, bits - i) - 1) for i in range(0, bits, full)]


def codes(x: np.ndarray, bits: int, *seed: int) -> np.ndarray:
    """The bucket of each unit vector."""
    out = np.zeros(len(x), np.int64)
    for level, axes in enumerate(_axes(bits, x.shape[1])):
        y = rotated(x, *seed, level)[:, :axes]
        best = np.abs(y).argmax(1)
        out = out * (2 * axes) + 2 * best + (y[np.arange(len(y)), best] < 0)
    return out


def probes(x: np.ndarray, bits: int, most: int, *seed: int) -> np.ndarray:
    """The `most` (or all) best buckets of each vector, best first: by how far it is from being assigned there."""
    at, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for level, axes in enumerate(_axes(bits, x.shape[1])):
        y = rotated(x, *seed, level)[:, :axes]
        top = np.abs(y).max(1, keepdims=True)
        own = (np.stack([top - y, top + y], 2).reshape(len(y), -1)) ** 2
        cost = (cost[:, :, None] + own[:, None, :]).reshape(len(x), -1)
        at = (at[:, :, None] * (2 * axes) + np.arange(2 * axes)).reshape(len(x), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :most]  # the best whole buckets begin with the best first parts
        cost, at = np.take_along_axis(cost, order, 1), np.take_along_axis(at, order, 1)
    return at


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    raw, offs = buffers(column)
    return raw.view(dtype).reshape(len(offs) - 1, -1) if len(offs) > 1 else np.zeros((0, 1), dtype)


def _packed(x: np.ndarray) -> pa.Array:
    size = x.shape[1] * x.itemsize
    return binary_array(np.ascontiguousarray(x).view(np.uint8).reshape(-1), np.arange(len(x) + 1, dtype=np.int64) * size)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, no: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k nearest points, nearest first, ties to the smaller id; a repeated pair counts once."""
    order = np.lexsort((no, ids, score, query))
    q, p = query[order], no[order]
    # a pair found twice has one score, so its rows are neighbours
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (p[1:] != p[:-1])
    order, q = order[new], q[new]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def nearest_pairs(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of points and distance of all pairs among which each query's k nearest are.

    Products give the distances up to rounding; pairs that may be among the nearest get theirs from the
    differences, in double precision.
    """
    q, p = queries.astype(np.float64), points.astype(np.float64)
    scale = np.ldexp(1.0, int(np.frexp(max(np.abs(q).max(initial=0), np.abs(p).max(initial=0)))[1]))  # a power of two: rounding stays as it is
    qs, ps = q / scale, p / scale
    squares = (qs * qs).sum(1)[:, None] + (ps * ps).sum(1)[None] - 2 * (qs @ ps.T)
    if len(p) > k:
        edge = np.partition(squares, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero(squares <= edge + 1e-12 * q.shape[1])
    else:
        i, j = (x.reshape(-1) for x in np.indices(squares.shape))
    difference = qs[i] - ps[j]
    return i, j, np.sqrt((difference * difference).sum(1)) * scale


def vectors(df: DataFrame, id_column: str, column: str) -> tuple[DataFrame, str]:
    """id and packed vector of the rows that take part, and the numpy type of the components.

    Left out: rows without an id, null and zero vectors, those with null or non-finite components, and those
    of another length than most have (of equally frequent lengths, the larger counts).
    """
    dtype = "f8" if "double" in dict(df.dtypes)[column] else "f4"
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast(f"array<{'double' if dtype == 'f8' else 'float'}>").alias("v")).where("id is not null and size(v) > 0")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common[0].d if common else 1
    rows = rows.where(F.size("v") == d)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten()
            x = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat).astype(dtype).reshape(-1, d)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("id"))[good]), _packed(x[good])], names=["id", "v"])

    return rows.mapInArrow(packed, "id long, v binary"), dtype


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    """no, id (the least), v and ids: each vector with a number and its k + 1 smallest ids, which are all that results can name.

    The window's limit is applied before the exchange, so a vector that many rows have is never gathered.
    """
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rank") <= k + 1)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.monotonically_increasing_id().alias("no"), F.col("ids")[0].alias("id"), "v", "ids")


def _true_neighbours(sample: list, points: DataFrame, k: int, dtype: str) -> list:
    """Rows s, v: the k nearest other points of each sample query, by a scan of all points."""
    held = np.stack([np.frombuffer(r.v, dtype) for r in sample])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "score", "id", "no", "v"]
        kept = None
        for batch in batches:
            x = _matrix(batch.column("v"), dtype)
            s, j, score = nearest_pairs(held, x, k + 1)
            some = pa.RecordBatch.from_arrays([pa.array(s), pa.array(score), *(batch.column(c).take(pa.array(j)) for c in names[2:])], names=names)
            kept = some if kept is None else pa.concat_batches([kept, some])
            kept = kept.take(pa.array(_best(*(np.asarray(kept.column(c)) for c in names[:4]), k + 1)))
        if kept is not None:
            yield kept

    near = points.select("id", "no", "v").mapInArrow(scanned, "s long, score double, id long, no long, v binary")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy("score", "id", "no"))).where(F.col("rank") <= k + 1)
    return near.where("score > 0").select("s", "v").collect()  # at most k + 1 for each sample query


def fitted_probes(queries: DataFrame, points: DataFrame, bits: int, k: int, dtype: str, tables: int = TABLES, recall: float = RECALL, most_queries: int = SAMPLE) -> int:
    """Buckets to probe in each table so that the true neighbours of a sample of queries are found to the share `recall`."""
    sample = queries.orderBy(F.xxhash64("v"), "v").limit(most_queries).collect()
    true = _true_neighbours(sample, points, k, dtype) if sample else []
    if not true:
        return 1
    q = unit(np.stack([np.frombuffer(r.v, dtype) for r in sample]))
    p, s = unit(np.stack([np.frombuffer(r.v, dtype) for r in true])), np.array([r.s for r in true])
    homes = [codes(p, bits, t) for t in range(tables)]
    most = 256
    while True:
        most = min(most, 1 << bits)
        rank = np.full(len(true), 1 << bits)
        for t in range(tables):
            at = np.concatenate([probes(q[i : i + 16], bits, most, t) for i in range(0, len(q), 16)])
            hit = at[s] == homes[t][:, None]
            rank = np.where(hit.any(1), np.minimum(rank, hit.argmax(1)), rank)
        needed = int(np.sort(rank)[int(np.ceil(recall * len(rank))) - 1]) + 1
        if needed <= most:
            return needed
        most *= 4


def _hashed(rows: DataFrame, bits: int, tables: int, dtype: str, most: int | None = None) -> DataFrame:
    """ROW: a row for each table, or (most given) for each probed bucket, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = unit(_matrix(batch.column("v"), dtype))
                for t in range(tables):
                    at = codes(x, bits, t)[:, None] if most is None else probes(x, bits, most, t)
                    back = pa.array(np.repeat(np.arange(len(x)), at.shape[1]))
                    rank = np.tile(np.arange(at.shape[1], dtype=np.int32), len(x))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, t, np.int32)), pa.array(at.reshape(-1)), pa.array(rank), *(batch.column(c).take(back) for c in ("no", "id", "v"))], names=NAMES)

    return rows.mapInArrow(run, ROW)


def _centres(points: DataFrame, crowded: DataFrame, dtype: str) -> DataFrame:
    """crowded with the mean of CENTRE_ROWS members of each bucket."""
    members = points.join(small(crowded), ["table", "key"]).withColumn("n_th", F.row_number().over(Window.partitionBy("table", "key").orderBy(F.xxhash64("no"), "no"))).where(F.col("n_th") <= CENTRE_ROWS)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.stack([np.frombuffer(v, dtype) for v in vs]).astype(np.float64).mean(0) for vs in batch.column("vs").to_pylist()]
            centre = _packed(np.stack(found)) if found else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("table"), batch.column("key"), batch.column("n"), centre], names=["table", "key", "n", "centre"])

    return members.groupBy("table", "key", "n").agg(F.collect_list("v").alias("vs")).mapInArrow(mean, "table int, key long, n long, centre binary")


def _rehashed(rows: DataFrame, level: int, dtype: str, most: int | None = None) -> DataFrame:
    """Rows of crowded buckets (with n and centre) in buckets by their difference from the centre; a query's lesser probes get fewer of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = unit(_matrix(batch.column("v"), dtype).astype(np.float64) - _matrix(batch.column("centre"), "f8"))
                table, key, n, rank = (np.asarray(batch.column(c)) for c in ("table", "key", "n", "rank"))
                bits = np.ceil(np.log2(n / LEAF)).astype(int)
                share = np.ones(len(x), int) if most is None else np.maximum(1, most // (rank + 1))
                for b, t, m in sorted({*zip(bits.tolist(), table.tolist(), share.tolist(), strict=True)}):
                    some = np.flatnonzero((bits == b) & (table == t) & (share == m))
                    at = codes(x[some], b, t, level)[:, None] if most is None else probes(x[some], b, m, t, level)
                    back = np.repeat(some, at.shape[1])
                    child = mix(mix(key[back].astype(np.uint64) + np.uint64(level)) + at.reshape(-1).astype(np.uint64)).astype(np.int64)
                    take = pa.array(back)
                    yield pa.RecordBatch.from_arrays([batch.column("table").take(take), pa.array(child), pa.array(np.tile(np.arange(at.shape[1], dtype=np.int32), len(some)) + rank[back]), *(batch.column(c).take(take) for c in ("no", "id", "v"))], names=NAMES)

    return rows.mapInArrow(run, ROW)


def _in_buckets(k: int, dtype: str):
    """Sorted rows (points of a bucket before its queries) to the nearest points that each query has in a task's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held, now, ids, nos, at = 0, None, [], [], []

        def best() -> list[np.ndarray]:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            keep = _best(*cols, k)
            return [c[keep] for c in cols]

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "score", "id", "no"])

        for batch in batches:
            table, key, salt, kind, id_, no = (np.asarray(batch.column(c)) for c in ("table", "key", "salt", "kind", "id", "no"))
            x = _matrix(batch.column("v"), dtype)
            change = np.ones(len(key), bool)
            change[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])
            first = np.flatnonzero(change)
            for a, b in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                if now != (bucket := (table[a], key[a], salt[a])):
                    now, ids, nos, at = bucket, [], [], []
                if kind[a] == 0:
                    ids, nos, at = [*ids, id_[a:b]], [*nos, no[a:b]], [*at, x[a:b]]
                elif ids:
                    ids, nos, at = ([np.concatenate(v)] for v in (ids, nos, at))
                    for c in range(a, b, 256):
                        i, j, score = nearest_pairs(x[c : min(b, c + 256)], at[0], k)
                        held.append((no[c + i], score, ids[0][j], nos[0][j]))
                        n_held += len(i)
                        if n_held > HELD:
                            held[:] = [best()]
                            n_held = len(held[0][0])
                            if n_held > HELD // 2:  # many queries: what there is goes on, the rest is compared later
                                yield out(held.pop())
                                n_held = 0
        if held:
            yield out(best())

    return run


def _found(left: DataFrame, right: DataFrame, k: int, dtype: str) -> DataFrame:
    """query, no, id, score: each query's k nearest points of the buckets that it probes.

    A bucket of over CROWD points is dealt out in blocks, each of which meets all queries of the bucket.
    """
    crowded = left.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    crowded = saved(crowded.select("table", "key", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks")), "crowded")
    blocks = F.coalesce("blocks", F.lit(1))
    left = left.join(small(crowded), ["table", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("no"), blocks).cast("int"))
    right = right.join(small(crowded), ["table", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), blocks - 1)))
    sides = [x.select("table", "key", "salt", F.lit(kind).alias("kind"), "no", "id", "v") for kind, x in enumerate((left, right))]
    both = sides[0].unionByName(sides[1]).repartition("table", "key", "salt").sortWithinPartitions("table", "key", "salt", "kind")
    found = both.mapInArrow(_in_buckets(k, dtype), "query long, score double, id long, no long")
    found = found.groupBy("query", "no", "id").agg(F.min("score").alias("score"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "id", "no"))).where(F.col("rank") <= k).drop("rank")
    out = saved(found, "found")
    dropped(crowded)
    return out


def search(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = 10, every: int = 100, tables: int = TABLES, recall: float = RECALL, most_queries: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    score is the Euclidean distance of the vectors as given, in double precision; ties go to the smaller id.
    Left out are the rows that `vectors` names; repeated rows count once, and rows of one id with different
    vectors are queries each by itself, none of which finds another (so it may get that many fewer).  A query
    with at most k other rows gets them all; a table without queries gives no rows; further columns are
    ignored.  Candidates are all rows: each is indexed, and no bucket is cut off.  The number of probes is fitted
    on at most `most_queries` queries.
    """
    rows, dtype = vectors(df, id_column, column)
    rows = saved(rows, "vectors")
    points = saved(_first_ids(rows, k), "points")
    asked = saved(rows.where(F.col("id") % every == 0).distinct(), "asked")
    queries = saved(asked.groupBy("v").agg(F.min("id").alias("id")).withColumn("no", F.monotonically_increasing_id()), "queries")
    n = points.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
    most = fitted_probes(queries, points, bits, k, dtype, tables, recall, most_queries)
    made = [rows, points, asked, queries]

    first = left = saved(_hashed(points.drop("ids"), bits, tables, dtype), "hashed")
    right = saved(_hashed(queries, bits, tables, dtype, most), "probed")
    made += [left, right]
    for level in range(1, ROUNDS + 1):
        crowded = saved(left.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD), "crowded")
        made.append(crowded)
        if not crowded.take(1):
            break
        centres = saved(_centres(left, crowded, dtype), "centres")
        kept = [x.join(small(crowded.drop("n")), ["table", "key"], "left_anti") for x in (left, right)]
        split = [_rehashed(x.join(small(centres), ["table", "key"]), level, dtype, m) for x, m in ((left, None), (right, most))]
        left, right = (saved(a.select(NAMES).unionByName(b), "hashed") for a, b in zip(kept, split, strict=True))
        made += [centres, left, right]
    found = _found(left, right, k + 1, dtype)
    made.append(found)
    # queries that met too few points meet all of them, in the buckets of one table
    full = found.groupBy("query").count().where(F.col("count") >= min(k + 1, n))
    short = saved(queries.join(full, queries.no == full["query"], "left_anti"), "short")
    made.append(short)
    if short.take(1):
        rest = _found(first.where("table = 0"), _hashed(short, bits, 1, dtype, 1 << bits), k + 1, dtype)
        made.append(rest)
        found = found.join(rest.select("query").distinct(), "query", "left_anti").unionByName(rest)

    copies = points.where(F.size("ids") > 1).select("no", "ids")
    named = found.join(small(copies), "no", "left").select("query", "score", F.explode(F.coalesce("ids", F.array("id"))).alias("vec_id"))
    askers = queries.select("v", F.col("no").alias("query")).join(asked.withColumnRenamed("id", "query_id"), "v").select("query", "query_id")
    ranked = named.join(askers, "query").where("vec_id <> query_id").groupBy("query", "query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query", "query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    ranked = saved(ranked.select("query_id", "rank", "vec_id", "score"), "neighbours")
    dropped(*made)
    return ranked
