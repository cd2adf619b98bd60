"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text scores every document.

Units are the bytes of the text, n-grams of up to ORDER bytes packed exactly into 64-bit keys, one
model for each language.  Tasks count the n-grams of trusted documents in arrays and emit sorted
counts; Spark sums them by key, and each order's probabilities come from joins of its counts with its
context totals and with the order below, each order being written before the next one starts.  A
document's cross-entropy is the mean of its bytes' negative log-probabilities, shrunk towards its
language's mean as if it had PRIOR_BYTES more bytes; perplexity is 2 to that power.  A document is
rejected when its perplexity exceeds a quantile of the held-out trusted documents of its language: QUANTILE,
or less where these are so few that fewer than OUTLIERS of them would lie above it (LEAST_QUANTILE at
least), since the highest few are documents that should not have been trusted.

The model table grows with the variety of the text.  It is broadcast in as many pieces as hold about
BROADCAST_NGRAMS rows each: driver and workers hold one piece at a time, and a task scores some MiB of text
against one piece after the other, so that documents are read once and never shuffled.  A model of more
than BROADCAST_PIECES pieces is joined with the documents' n-grams by shuffles, which take several times
the input's size on disk.

Defined cases: a null or empty text has the perplexity of its language's mean and is kept; a language
without trusted text, or with none among the held-out documents (a null language counts as one), has
no threshold: its perplexity and threshold are null and the document is kept; repeated rows count as
often as they occur; perplexity, threshold and kept replace columns of that name, all others are kept.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelry.llm.textbuf import buffers, dropped, free_name, mix, saved, slices, small, tidy, with_columns

ORDER = 6
PRIOR_BYTES = 150
QUANTILE, LEAST_QUANTILE, OUTLIERS = 0.99, 0.95, 3
#: One trusted document in so many sets the thresholds and is not trained on.
HOLD_OUT = 5
#: Rows of a piece of the model, and pieces up to which it is broadcast.
BROADCAST_NGRAMS, BROADCAST_PIECES = 6_000_000, 32
#: Bytes of text that a task scores against a piece before it loads the next one.
HELD_BYTES = 16 << 20
#: Counts (16 bytes each) of a language that a task gathers before it sums them; counts of all languages before it emits them.
MERGE, EMIT = 750_000, 4_000_000
#: Rows of labels up to which they are broadcast (16 bytes each).
BROADCAST_LABELS = 1_000_000
_MASK = [np.uint64((1 << (8 * k)) - 1) for k in range(9)]


def ngram_keys(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Key of the ORDER bytes that end at each byte; before a text stand line feeds."""
    n = len(buf)
    inside = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    key = np.zeros(n, np.uint64)
    for back in range(ORDER - 1, -1, -1):
        item = np.full(n, 0x0A, np.uint64)
        item[back:] = buf[: n - back]
        if back:
            item[inside < back] = 0x0A
        key = (key << np.uint64(8)) | item
    return key


def _languages(part: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in part.column(part.schema.get_field_index(column)).to_pylist()]


def count_ngrams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, key, c: summed counts of the ORDER-grams of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(x: str) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(c) for c in zip(*held[x], strict=True))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
            held[x] = [(keys[first], np.add.reduceat(counts, first))]
            return held[x][0]

        def out(x: str):
            keys, counts = merged(x)
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(k)), pa.array(k.view(np.int64)), pa.array(counts[i : i + 100_000])], names=["lang", "key", "c"])

        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = buffers(part.column(1))
                langs = np.array(_languages(part, "lang"), object)
                for x in sorted(set(langs)):
                    rows = np.flatnonzero(langs == x)
                    b, o = buffers(part.column(1).take(pa.array(rows)))
                    if len(b):
                        keys, counts = np.unique(ngram_keys(b, o), return_counts=True)
                        held.setdefault(x, []).append((keys, counts))
                        if sum(len(k) for k, _ in held[x]) > MERGE:
                            merged(x)
            if sum(len(k) for parts in held.values() for k, _ in parts) > EMIT:
                for x in list(held):
                    yield from out(x)
                    del held[x]
        for x in held:
            yield from out(x)

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(run, "lang string, key long, c long")
    return rows.groupBy("lang", "key").agg(F.sum("c").alias("c"))


def model(counts: DataFrame) -> DataFrame:
    """lang, length, kind, key, value: kind "p" has log2 of an n-gram's interpolated probability, kind "b" log2 of a context's backoff weight.

    The result is a table in the shared folder; those that it was made from are removed.
    """
    tables, made = {ORDER: counts}, []
    for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct bytes to the left
        tables[k] = saved(tables[k + 1].groupBy("lang", F.expr(f"key & {(1 << (8 * k)) - 1}L").alias("key")).agg(F.count("*").alias("c")), "continuations")
    out, below = None, None
    for k in range(1, ORDER + 1):
        t = tables[k]
        sums = t.groupBy("lang").agg(*(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
        d = [F.greatest(F.lit(0.1), F.least(F.lit(i - 0.05), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1)))) for i in (1, 2, 3)]
        discounts = saved(sums.select("lang", *(x.alias(f"d{i}") for i, x in enumerate(d, 1))), "discounts")  # a row for each language
        t = t.join(small(discounts), "lang").withColumn("d", F.expr("case when c = 1 then d1 when c = 2 then d2 else d3 end")).withColumn("ctx", F.expr("shiftright(key, 8)"))
        ctx = saved(t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")), "contexts")
        p = t.join(ctx, ["lang", "ctx"]).withColumn("suffix", F.expr(f"key & {(1 << (8 * (k - 1))) - 1}L"))
        if below is None:
            p = p.withColumn("lower", F.lit(1 / 256))
        else:
            p = p.join(below.select("lang", F.col("key").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        below = saved(p.select("lang", "key", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p")), "probabilities")
        rows = below.select("lang", F.lit(k).alias("length"), F.lit("p").alias("kind"), "key", F.log2("p").cast("float").alias("value"))
        rows = rows.unionByName(ctx.select("lang", F.lit(k - 1).alias("length"), F.lit("b").alias("kind"), F.col("ctx").alias("key"), F.log2("gamma").cast("float").alias("value")))
        out = rows if out is None else out.unionByName(rows)
        made += [ctx, below]
        dropped(discounts, *([tables[k]] if k < ORDER else []))
    found = saved(out, "model")
    dropped(*made)
    return found


class Table:
    """Map from 64-bit keys to floats, over arrays that are sorted by the mixed key; a directory finds the few entries that begin alike."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and whether each key is there."""
        wanted = mix(keys)
        slot = (wanted >> self.shift).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        out, found = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        left = np.flatnonzero(at < stop)
        while len(left):
            place = at[left]
            hit = self.keys[place] == wanted[left]
            out[left[hit]], found[left[hit]] = self.values[place[hit]], True
            left = left[~hit & (place + 1 < stop[left])]
            at[left] += 1
        return out, found


class Scorer:
    def __init__(self, rows: dict[str, dict[tuple[int, str], tuple[bytes, bytes]]]):
        self.rows, self.tables = rows, {}

    def log2(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """log2 probability of the last byte of each ORDER-gram, backing off along known contexts."""
        if lang not in self.tables:
            none = b"", b""  # a piece may lack n-grams of some length
            arrays = {(k, kind): self.rows[lang].get((k, kind), none) for k in range(ORDER + 1) for kind in "pb"}
            self.tables[lang] = {k: Table(np.frombuffer(keys, np.uint64), np.frombuffer(values, np.float32)) for k, (keys, values) in arrays.items()}
        tables = self.tables[lang]
        out, found = tables[ORDER, "p"].find(keys)
        out, left = out.astype(np.float64), np.flatnonzero(~found)
        uniq, back = np.unique(keys[left], return_inverse=True)
        got, open_ = np.zeros(len(uniq)), np.arange(len(uniq))
        for k in range(ORDER - 1, -1, -1):
            weight, _ = tables[k, "b"].find((uniq[open_] >> np.uint64(8)) & _MASK[k])
            got[open_] += weight
            if k == 0:
                got[open_] += np.log2(1 / 256)
                break
            p, hit = tables[k, "p"].find(uniq[open_] & _MASK[k])
            got[open_] += p
            open_ = open_[~hit]
        out[left] = got[back]
        return out


class Piece:
    """Rows of the model by language, length and kind.  A worker keeps them in a temporary file without a name and loads them when they are wanted."""

    def __init__(self, rows: dict):
        self.rows = rows

    def __reduce__(self):
        return Stored, (self.rows,)


class Stored:
    def __init__(self, rows: dict):
        self.file = tempfile.TemporaryFile()
        pickle.dump(rows, self.file, pickle.HIGHEST_PROTOCOL)
        self.file.flush()

    def load(self) -> dict:
        self.file.seek(0)
        return pickle.load(self.file)


def _piece_of(before: np.ndarray, pieces: int) -> np.ndarray:
    """Piece by the last two bytes of the context (odd factor: they are spread over 16 bits)."""
    return ((before * 40503) & 0xFFFF) * pieces >> 16


def _piece(table: DataFrame, at: int, pieces: int) -> DataFrame:
    """Rows of the n-grams and contexts of a piece, with all that backing off from them needs: those too short to name the two bytes are in every piece."""
    if pieces == 1:
        return table
    short = "length < case when kind = 'b' then 2 else 3 end"
    before = "(case when kind = 'b' then key else shiftright(key, 8) end & 65535)"
    return table.where(f"{short} or shiftright((({before} * 40503) & 65535) * {pieces}, 16) = {at}")


def _packed(table: DataFrame, pieces: int) -> list:
    """The model (12 bytes a row) as a broadcast variable for each piece: for each language, length and kind the mixed keys, sorted, and their values."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        mixed = mix(rows.column("key").to_numpy().view(np.uint64))
        order = np.argsort(mixed)
        blobs = [mixed[order].tobytes(), rows.column("value").to_numpy()[order].tobytes()]
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.string()), *(pa.array([x], pa.binary()) for x in blobs)], names=["lang", "length", "kind", "keys", "values"])

    shared = []
    for at in range(pieces):
        out: dict[str, dict[tuple[int, str], tuple[bytes, bytes]]] = {}
        for r in _piece(table, at, pieces).groupBy("lang", "length", "kind").applyInArrow(pack, "lang string, length int, kind string, keys binary, values binary").toLocalIterator():
            out.setdefault(r.lang, {})[r.length, r.kind] = bytes(r["keys"]), bytes(r["values"])
        shared.append(table.sparkSession.sparkContext.broadcast(out if pieces == 1 else Piece(out)))
        del out
        tidy()
    return shared


def _score_by_broadcast(docs: DataFrame, shared: list, lang: str, text: str, made: tuple[str, str]) -> DataFrame:
    pieces = len(shared)

    def make():
        loaded: dict[int, Scorer] = {}

        def scorer(at: int) -> Scorer:
            if at not in loaded:
                loaded.clear()
                loaded[at] = Scorer(shared[at].value if pieces == 1 else shared[at].value.load())
            return loaded[at]

        def add(part: pa.RecordBatch, at: int, bits: np.ndarray, size: np.ndarray) -> None:
            """Add to bits what the n-grams of the piece give; null without a model."""
            column, langs = part.column(part.schema.get_field_index(text)), np.array(_languages(part, lang), object)
            for x in set(langs):
                chosen = np.flatnonzero(langs == x)
                buf, offs = buffers(column.take(pa.array(chosen)))
                size[chosen] = np.diff(offs)
                if x not in scorer(at).rows:
                    bits[chosen] = np.nan
                    continue
                keys, sums = ngram_keys(buf, offs), np.zeros(len(buf) + 1)
                if pieces == 1:
                    np.cumsum(scorer(at).log2(x, keys), out=sums[1:])
                else:
                    own = np.flatnonzero(_piece_of(((keys >> np.uint64(8)) & _MASK[2]).astype(np.int64), pieces) == at)
                    sums[own + 1] = scorer(at).log2(x, keys[own])
                    np.cumsum(sums, out=sums)
                bits[chosen] += sums[offs[:-1]] - sums[offs[1:]]

        def score(part: pa.RecordBatch) -> list[pa.Array]:
            bits, size = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
            for at in sorted(range(pieces), key=lambda i: i not in loaded):  # first the one that the last text left
                row = 0
                for some in slices(part, text):
                    rows = slice(row, row + some.num_rows)
                    add(some, at, bits[rows], size[rows])
                    row += some.num_rows
            return [pa.array(bits, mask=np.isnan(bits)), pa.array(size)]

        return score

    held = {} if pieces == 1 else {"most": HELD_BYTES, "gather": True}
    return with_columns(docs, text, [T.StructField(made[0], T.DoubleType()), T.StructField(made[1], T.LongType())], make, **held)


def _score_by_join(docs: DataFrame, table: DataFrame, lang: str, text: str, made: tuple[str, str]) -> DataFrame:
    """The same sums by shuffles: documents' distinct n-grams meet the model order by order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = buffers(part.column(2))
                owner = np.repeat(np.arange(part.num_rows), np.diff(offs))
                keys = ngram_keys(buf, offs)
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.zeros(0, np.int64)
                who = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))))], names=["row", "lang", "key", "c"])

    row, model_lang, total = (free_name([*docs.columns, *made], x) for x in ("row", "model_lang", "sum_bits"))
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    left = numbered.select(F.col(row).alias("row"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(run, "row long, lang string, key long, c long").withColumn("bits", F.lit(0.0))
    left = left.join(table.select("lang").distinct(), "lang", "left_semi")
    done = None
    for k in range(ORDER, -1, -1):
        value = lambda kind, key: table.where((F.col("length") == k) & (F.col("kind") == kind)).select("lang", F.col("key").alias(key), F.col("value").cast("double").alias(kind))  # noqa: B023,E731
        if k < ORDER:
            left = left.withColumn("ctx", F.expr(f"shiftright(key, 8) & {(1 << (8 * k)) - 1}L")).join(value("b", "ctx"), ["lang", "ctx"], "left").withColumn("bits", F.col("bits") + F.coalesce("b", F.lit(0.0))).drop("ctx", "b")
        if k == 0:
            ended = left.withColumn("p", F.lit(-8.0))
        else:
            left = left.withColumn("own", F.expr(f"key & {(1 << (8 * k)) - 1}L")).join(value("p", "own"), ["lang", "own"], "left").drop("own")
            ended, left = left.where("p is not null"), left.where("p is null").drop("p")
        ended = ended.select("row", (-F.col("c") * (F.col("bits") + F.col("p"))).alias("bits"))
        done = ended if done is None else done.unionByName(ended)
    sums = done.groupBy(F.col("row").alias(row)).agg(F.sum("bits").alias(total))
    known = table.select(F.col("lang").alias(model_lang)).distinct()
    scored = numbered.drop(*made).join(sums, row, "left").join(known, F.coalesce(F.col(lang).cast("string"), F.lit("")) == F.col(model_lang), "left")
    scored = scored.withColumn(made[0], F.when(F.col(model_lang).isNotNull(), F.coalesce(total, F.lit(0.0))))
    return scored.withColumn(made[1], F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")).drop(row, model_lang, total)


def _packed_if_few(table: DataFrame, most: int) -> list | None:
    n = table.count()
    return None if n > most * BROADCAST_PIECES else _packed(table, max(1, -(-n // max(1, most))))


def score(docs: DataFrame, table: DataFrame, lang: str = "lang", text: str = "text", most: int = BROADCAST_NGRAMS) -> DataFrame:
    """docs with bits (negative log2 likelihood; null without a model) and n_bytes, which replace columns of that name.  most: rows of a piece of the model."""
    return _score(docs, table, _packed_if_few(table, most), lang, text)


def _score(docs: DataFrame, table: DataFrame, packed, lang: str, text: str, made: tuple[str, str] = ("bits", "n_bytes")) -> DataFrame:
    held = docs.withColumn(text, F.col(text).cast("string"))
    return _score_by_join(held, table, lang, text, made) if packed is None else _score_by_broadcast(held, packed, lang, text, made)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = BROADCAST_NGRAMS) -> DataFrame:
    """docs with perplexity, threshold and kept.  labels: doc_id and quality (1: trusted, if toxic is not 1); most: rows of a piece of the model."""
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("perplexity", "threshold", "kept") or c in (doc_id, text, lang)))
    good = labels.where("quality = 1 and coalesce(toxic, 0) <> 1 and doc_id is not null").select(F.col("doc_id").alias(doc_id)).distinct()
    trusted = docs.select(doc_id, text, lang).join(small(good, BROADCAST_LABELS), doc_id, "left_semi")
    held_out = F.expr(f"pmod(xxhash64(`{doc_id}`), {HOLD_OUT}) = 0")
    counts = saved(count_ngrams(trusted.where(~held_out), lang, text), "counts")
    table = model(counts)
    packed = _packed_if_few(table, most)
    own = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    known = saved(_score(trusted.where(held_out), table, packed, lang, text).select(own.alias("model_lang"), "bits", "n_bytes").where("bits is not null and n_bytes > 0"), "held-out")
    shrunk = lambda bits, n_bytes, mean: F.pow(F.lit(2.0), (F.col(bits) + PRIOR_BYTES * F.col(mean)) / (F.col(n_bytes) + PRIOR_BYTES))
    mean = known.groupBy("model_lang").agg((F.sum("bits") / F.sum("n_bytes")).alias("mean_bits"))
    steps = round(1000 * (QUANTILE - LEAST_QUANTILE))  # quantiles to choose from, by the number of documents
    quantiles = F.percentile_approx(shrunk("bits", "n_bytes", "mean_bits"), [LEAST_QUANTILE + i / 1000 for i in range(steps + 1)], 100_000)
    step = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(1000 * (1 - OUTLIERS / F.count("*") - LEAST_QUANTILE)).cast("int")))
    limits = known.join(mean, "model_lang").groupBy("model_lang").agg(F.first("mean_bits").alias("mean_bits"), F.get(quantiles, step).alias("threshold"))
    bits, n_bytes, model_lang, mean_bits = made = [free_name(docs.columns, x) for x in ("bits", "n_bytes", "model_lang", "mean_bits")]
    limits = saved(limits.select(F.col("model_lang").alias(model_lang), F.col("mean_bits").alias(mean_bits), "threshold"), "limits")
    dropped(counts, known, *([] if packed is None else [table]))
    scored = _score(docs, table, packed, lang, text, (bits, n_bytes)).join(small(limits), own == F.col(model_lang), "left")
    scored = scored.withColumn("perplexity", shrunk(bits, n_bytes, mean_bits)).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return scored.drop(*made)
