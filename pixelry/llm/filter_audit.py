"""Interaction audit of five filters: what every order of applying them keeps, removes and loses.

A document's outcome under any order depends only on the set of filters that it fails, a mask of five bits.
Documents are counted once by part, mask and label; these histograms, stacked as rows, are multiplied by
integer matrices of 32 masks by 600 places (120 orders of five steps), which hold what becomes of a mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelry.llm.textbuf import dropped, saved, small

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

RESULT = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in OUTCOMES)])


def outcome_matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: 32 x 600 matrices of 0 and 1; column 5 * order + step - 1."""
    masks = np.arange(MASKS)[:, None, None]
    own = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])[None]
    until = np.bitwise_or.accumulate(own, axis=2)
    before = until & ~own
    fails, gone = (masks & own) > 0, (masks & before) > 0
    found = {"kept": (masks & until) == 0, "removed": fails & ~gone, "redundant": fails & gone, "unique": np.broadcast_to(masks == own, fails.shape)}
    return {k: v.reshape(MASKS, -1).astype(np.int64) for k, v in found.items()}


def filter_conditions(text: Column) -> list[Column]:
    """What makes a text fail filters A to D; E looks at the other documents."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [n_words < 100, 100 * n_distinct < 80 * n_words, 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and mask of filters A to D of each row, from one reading of the texts."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filter_conditions(F.col("text")))]
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good and n_toxic: documents of each set of failed filters, and those labelled good and toxic."""
    rows = saved(failures(docs), "failures")
    copies = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "copies")
    marked = rows.join(small(copies), "digest", "left").withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0))
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id meet no label, and are kept out of the join, where they would all go to one task
    known = marked.where("doc_id is not null").select("doc_id", "part", "mask").join(small(flags.where("good = 1 or toxic = 1")), "doc_id", "left")
    none = marked.where("doc_id is null").select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    every = known.select("part", "mask", "good", "toxic").unionByName(none)
    counted = every.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"))
    out = saved(counted, "histograms")
    dropped(rows, copies)
    return out


def outcomes(counts: DataFrame) -> DataFrame:
    """The result rows of each part, by products of its stacked histograms with the outcome matrices."""
    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("masks"))  # 32 at most

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = outcome_matrices()
        order = np.repeat(np.array(ORDERS, object), STEPS)
        step = np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
        own = np.array([FILTERS.index(o[s - 1]) for o, s in zip(order, step, strict=True)])
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                h = np.zeros((3, MASKS), np.int64)
                for x in masks:
                    h[:, x["mask"]] = x["n"], x["n_good"], x["n_toxic"]
                removed = h @ m["removed"]
                shapley = np.zeros(len(FILTERS), np.int64)
                np.add.at(shapley, own, removed[0])
                found = [h[0] @ m["kept"], removed[0], h[0] @ m["redundant"], h[0] @ m["unique"], removed[1], removed[2], shapley[own]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(order), pa.string()), pa.array(order, pa.string()), pa.array(step), *map(pa.array, found)], names=RESULT.names)

    return stacked.mapInArrow(multiplied, RESULT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (language), order of the filters and step.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; further columns are ignored.  A null text is
    empty, a null language the part ''.  A row fails E if a smaller doc_id has the same text; of rows that
    share the smallest id none does, and rows without an id neither fail it nor make others fail.  Labels
    that repeat an id count once, as 1 if any row says so; null labels are no 1.  An empty table gives no
    rows, since it has no parts.
    """
    return outcomes(histograms(docs, labels))
