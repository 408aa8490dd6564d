"""Comparison of two repositories, by manifests and by operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators.stats import label


def manifests(local: DataFrame, target: DataFrame) -> DataFrame:
    """bundle_number and what holds for it: missing (locally), extra, or, for common ones, the first of hash, content and cursor that differs, else same."""
    a = local.select(F.col("bundle_number").alias("a"), F.col("hash").alias("h1"), F.col("content_hash").alias("c1"), F.col("cursor").alias("u1"))
    b = target.select(F.col("bundle_number").alias("b"), F.col("hash").alias("h2"), F.col("content_hash").alias("c2"), F.col("cursor").alias("u2"))
    j = a.join(b, F.col("a") == F.col("b"), "full_outer")
    kind = (
        F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("h1") != F.col("h2"), "hash")
        .when(F.col("c1") != F.col("c2"), "content").when(F.col("u1") != F.col("u2"), "cursor").otherwise("same")
    )
    return j.select(F.coalesce("a", "b").alias("bundle_number"), kind.alias("kind"))


def operations(local: DataFrame, target: DataFrame) -> DataFrame:
    """cid, positions and kind (missing_local, missing_remote, position) of operations that differ; of a repeated cid the last position counts."""
    last = lambda df, name: df.where("cid is not null").groupBy(F.col("cid").alias(f"{name}_cid")).agg(F.max("position").alias(name))
    j = last(local, "local").join(last(target, "remote"), F.col("local_cid") == F.col("remote_cid"), "full_outer")
    kind = F.when(F.col("local_cid").isNull(), "missing_local").when(F.col("remote_cid").isNull(), "missing_remote").when(F.col("local") != F.col("remote"), "position")
    return j.select(F.coalesce("local_cid", "remote_cid").alias("cid"), "local", "remote", kind.alias("kind")).where("kind is not null")


def chain_break(compared: DataFrame) -> DataFrame:
    """first_break, last_good and the length of the run of broken bundles that starts at the first one."""
    bad = compared.where("kind in ('hash', 'content')")
    run = label(bad, "bundle_number")
    first = run.agg(F.min("first").alias("first_break"), F.min_by("last", "first").alias("last"))
    good = compared.where("kind in ('same', 'cursor')").select(F.col("bundle_number").alias("g"))
    last_good = good.join(F.broadcast(first), F.col("g") < F.col("first_break")).agg(F.max("g").alias("last_good"))
    return first.join(F.broadcast(last_good)).select("first_break", "last_good", (F.col("last") - F.col("first_break") + 1).alias("run"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("bundle_number").join(right.select("bundle_number"), "bundle_number", "left_anti")


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("bundle_number").intersect(right.select("bundle_number"))


def links(bundles: DataFrame) -> DataFrame:
    """bundle_number, parent_ok and cursor_ok: a bundle's parent is the hash, its cursor the end time of the one before; both empty for the first."""
    w = Window.orderBy("bundle_number")
    t = bundles.select(
        "bundle_number", "parent", "cursor", F.lag("bundle_number").over(w).alias("n"), F.lag("hash").over(w).alias("h"), F.lag("end_time").over(w).alias("e")
    )
    root = F.col("bundle_number") == 1
    there = F.col("n") == F.col("bundle_number") - 1
    return t.select(
        "bundle_number",
        F.when(root, F.col("parent") == "").otherwise(F.coalesce(there & (F.col("parent") == F.col("h")), F.lit(False))).alias("parent_ok"),
        F.when(root, F.col("cursor") == "").otherwise(F.coalesce(there & (F.col("cursor") == F.col("e")), F.lit(False))).alias("cursor_ok"),
    )


def verified(ops: DataFrame, bundles: DataFrame) -> DataFrame:
    """bundle_number, valid and errors of the manifest's bundles against their operations: hash, count, times and DIDs."""
    from strandlog.sources.manifest import content

    c = content(ops).select(F.col("bundle").alias("b"), F.col("content_hash").alias("c2"), F.col("operation_count").alias("n2"), F.col("start_time").alias("s2"), F.col("end_time").alias("e2"), F.col("did_count").alias("d2"))
    j = bundles.join(c, F.col("bundle_number") == F.col("b"), "left")
    checks = {"missing": F.col("b").isNull(), "content_hash": F.col("content_hash") != F.col("c2"), "operation_count": F.col("operation_count") != F.col("n2"),
              "start_time": F.col("start_time") != F.col("s2"), "end_time": F.col("end_time") != F.col("e2"), "did_count": F.col("did_count") != F.col("d2")}
    errors = F.array_join(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]), lambda x: x.isNotNull()), ",")
    return j.select("bundle_number", (errors == "").alias("valid"), errors.alias("errors"))
