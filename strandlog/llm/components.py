"""Connected components by alternating large and small stars, on edges that never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm._common import stage, unstage


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    out = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    kids = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return kids.unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a long, b long), in any direction and with repeats, to (node, root): the smallest node reachable.

    Nodes without an edge to another node are left out; edges with a null end and
    self-links are ignored; no edges give no rows. Each round is staged and the one before it
    deleted, so a lost executor costs one round at most. Hubs are pre-aggregated (min) before the
    shuffle, and the joins are plain shuffled joins that AQE can split.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")
    )
    e = stage(e.distinct(), name)
    mark = None
    while True:
        before, e = e, stage(_small(_large(e)), name)
        unstage(before)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not now[0] or now == mark:
            break
        mark = now
    kids = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    tops = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return kids.unionByName(tops)
