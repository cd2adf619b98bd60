"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

The token counts of the cells (source, language, topic) are raked until their sums over each of the
three agree with the target shares; a document's inclusion probability is its cell's raked share over
its actual share, scaled so that the expected number of sampled tokens is the budget, at most 1.
Whether a document is taken depends on its id alone, by a hash, so a rerun takes the same ones.

Cells are few next to documents: up to CELLS_ON_DRIVER of them are raked in arrays on the driver, more
in DataFrame operations, to the same weights.

Defined cases: nulls in source, language or topic are values of their own; a document without tokens
(null or empty text) has weight and probability 0 and is not sampled; equal ids share their fate; an
empty table gives an empty result; cells that a target gives no share have weight 0.  Where no weights can
meet all targets (a value whose cells other targets rule out), fitting stops after ROUNDS and a warning
states the largest difference that is left.  topic, n_tokens, weight, probability and sampled replace
columns of that name (but a topic column is used as it is, if no other is given); all others are kept.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelry.llm.textbuf import dropped, free_name, saved

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are tokens ^ EXPONENT, made to sum to 1, unless they are given.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET = 0.8
SEED = 17
ROUNDS, TOLERANCE = 100, 1e-9
CELLS_ON_DRIVER = 200_000
BROADCAST_CELLS = 200_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def surface_topic(text: Column) -> Column:
    """A coarse topic from the form of a text: table, notice, note, long form or prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike("(?i)licensed under|released under|all rights reserved"), "notice")
        .when(F.length(text) < 300, "note")
        .when(F.length(text) > 8000, "long")
        .otherwise("prose")
    )


def _targets(cells: DataFrame, given: dict[str, dict[str, float]] | None) -> dict[str, DataFrame]:
    """value and share for each dimension."""
    out = {}
    for dim in DIMENSIONS:
        sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
        if given and dim in given:
            shares = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given[dim].items()], f"{dim} string, raw double")
            sums = sums.join(shares, sums[dim].eqNullSafe(shares[dim]), "left").select(sums[dim], F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            sums = sums.select(dim, F.pow(F.col("t").cast("double"), F.lit(EXPONENTS[dim])).alias("raw"))
        total = sums.agg(F.sum("raw")).collect()[0][0] or 0.0
        out[dim] = sums.select(dim, (F.col("raw") / total if total else F.lit(0.0)).alias("share"))
    return out


def rake(counts: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell shares with the given marginal shares, by iterative proportional fitting from `counts`."""
    w = counts / counts.sum() if counts.sum() else counts.astype(float)
    for _ in range(rounds):
        worst = 0.0
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, w, len(share))
            factor = np.divide(share, now, out=np.zeros_like(share), where=now > 0)
            worst = max(worst, float(np.abs(now - share)[now > 0].max(initial=0)))
            w = w * factor[code]
        if worst < tolerance:
            break
    else:
        _warn(worst)
    return w


def _warn(left: float) -> None:
    if left > 1e-6:
        warnings.warn(f"the targets were not met after {ROUNDS} rounds: a share is off by {left:.2g}", RuntimeWarning, stacklevel=3)


def scale(ratio: np.ndarray, counts: np.ndarray, budget: float) -> float:
    """Factor f with sum(counts * min(1, f * ratio)) = budget, or the least that takes all that can be taken."""
    full = np.sort(1 / ratio[ratio > 0])
    if not len(full):
        return 0.0
    order = np.argsort(-ratio)
    r, c = ratio[order], counts[order].astype(float)
    certain, rest = 0.0, float((r * c).sum())
    for x, n in zip(r, c, strict=True):
        if x <= 0 or rest <= 0:
            break
        f = (budget - certain) / rest
        if f * x <= 1:
            return max(f, 0.0)
        certain, rest = certain + n, rest - x * n
    return float(full[-1])


def _weights_on_driver(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    rows = cells.collect()
    codes, shares = [], []
    for dim in DIMENSIONS:
        found = {r[dim]: r.share or 0.0 for r in targets[dim].collect()}
        names = {v: i for i, v in enumerate(found)}
        codes.append(np.array([names[r[dim]] for r in rows], np.int64))
        shares.append(np.array(list(found.values()), float))
    counts = np.array([r.tokens for r in rows], float)
    raked = rake(counts, codes, shares)
    ratio = np.divide(raked, counts / max(counts.sum(), 1), out=np.zeros_like(raked), where=counts > 0)
    f = scale(ratio, counts, budget * counts.sum())
    out = [(*(r[d] for d in DIMENSIONS), float(x), float(min(1.0, f * x))) for r, x in zip(rows, ratio, strict=True)]
    return cells.sparkSession.createDataFrame(out, ", ".join(f"{d} string" for d in DIMENSIONS) + ", weight double, probability double")


def _weights_distributed(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    total = cells.agg(F.sum("tokens")).collect()[0][0] or 0
    now = cells.withColumn("w", F.col("tokens") / max(total, 1))
    for _ in range(ROUNDS):
        worst = 0.0
        for dim in DIMENSIONS:
            sums = now.groupBy(dim).agg(F.sum("w").alias("now"))
            t = targets[dim]
            factors = saved(sums.join(t, sums[dim].eqNullSafe(t[dim])).select(sums[dim].alias("value"), F.expr("coalesce(share / nullif(now, 0), 0)").alias("factor"), F.expr("case when now > 0 then abs(now - share) end").alias("error")), "factors")
            worst = max(worst, factors.agg(F.max("error")).collect()[0][0] or 0.0)
            now = now.join(factors.select("value", "factor"), now[dim].eqNullSafe(F.col("value"))).withColumn("w", F.col("w") * F.col("factor")).drop("value", "factor")
        before, now = now, saved(now, "raked")
        if hasattr(before, "saved_path"):
            dropped(before)
        if worst < TOLERANCE:
            break
    else:
        _warn(worst)
    now = now.withColumn("weight", F.expr(f"case when tokens > 0 then w * {max(total, 1)} / tokens else 0 end"))
    now = saved(now, "weights")
    certain, f = 0.0, 0.0
    for _ in range(ROUNDS):  # cells that reach probability 1 leave the rest to the others
        s = now.agg(F.sum(F.when(F.col("weight") * f >= 1, F.col("tokens")).otherwise(0)).alias("certain"), F.sum(F.when(F.col("weight") * f < 1, F.col("tokens") * F.col("weight"))).alias("rest"), F.max(F.expr("1 / nullif(weight, 0)")).alias("top")).collect()[0]
        nxt = (budget * total - s.certain) / s.rest if s.rest else (s.top or 0.0)
        if f and abs(nxt - f) <= 1e-12 * f:
            break
        f = max(f, min(nxt, s.top or 0.0))
    return now.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("weight") * f).alias("probability"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = SEED, cells_on_driver: int = CELLS_ON_DRIVER) -> DataFrame:
    """docs with topic, n_tokens, weight, probability and sampled (all rows; source and lang are columns of docs)."""
    made = ("topic", "n_tokens", "weight", "probability", "sampled")
    body = F.col(text).cast("string")
    kept = [c for c in docs.columns if c.lower() not in made or (c == "topic" and topic is None)]
    docs = docs.select(*(F.col(c).cast("string").alias(c) if c in DIMENSIONS else F.col(c) for c in kept))
    if topic is not None or "topic" not in docs.columns:
        docs = docs.withColumn("topic", surface_topic(body) if topic is None else topic)
    docs = docs.withColumn("n_tokens", tokens(body))
    cells = saved(docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    few = cells.limit(cells_on_driver + 1).count() <= cells_on_driver
    shares = {d: saved(t, "targets") for d, t in _targets(cells, targets).items()} if not few else _targets(cells, targets)
    weights = (_weights_on_driver if few else _weights_distributed)(cells, shares, budget)
    if few and cells_on_driver <= BROADCAST_CELLS:
        weights = F.broadcast(weights)
    names = {c: free_name(docs.columns, f"cell_{c}") for c in (*DIMENSIONS, "weight", "probability")}
    keyed = weights.select(*(F.col(c).alias(n) for c, n in names.items()))
    same = docs["source"].eqNullSafe(keyed[names["source"]]) & docs["lang"].eqNullSafe(keyed[names["lang"]]) & docs["topic"].eqNullSafe(keyed[names["topic"]])
    out = docs.join(keyed, same, "left")
    some = F.col("n_tokens") > 0
    out = out.withColumn("weight", F.when(some, F.col(names["weight"])).otherwise(0.0)).withColumn("probability", F.when(some, F.col(names["probability"])).otherwise(0.0))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) / float(1 << 53)
    return out.withColumn("sampled", draw < F.col("probability")).drop(*names.values())
