"""Connected components of an edge table by alternating star contractions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelry.llm.textbuf import dropped, saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node and component (the least node of its component) of every node that an edge names.

    Each round links every node's larger neighbours to its least neighbour, then its smaller ones and
    itself to the least of these; the edge count never grows and stars remain after O(log^2 n) rounds.
    The minimum of a node's neighbours is a pre-aggregated grouping, so a node with very many edges is
    never gathered.  Rounds are cut by tables in the shared folder.  Self-loops and repeated edges are
    allowed; edges with a null end are left out; an empty table gives an empty result.  The result is a
    table in the shared folder, too.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = clean.where("u = v").select(F.col("u").alias("node")).distinct()
    now = saved(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, saved(small, "edges")
        dropped(before)
        state = now.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).collect()[0].n
        if state is None or (state == 1 and not now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").take(1)):
            break
    else:
        raise RuntimeError("components did not converge")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct()
    alone = loops.join(stars.select("node").unionByName(roots), "node", "left_anti")
    out = saved(stars.unionByName(roots.unionByName(alone).withColumn("component", F.col("node"))), "components")
    dropped(now)
    return out
