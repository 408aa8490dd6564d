"""Scans, filters, lookups and exports of an operation log (bundle, position, global_pos, did, cid, nullified, created_at, raw, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.coords import bundle_intervals, operation_intervals, pruned, within


def instant(created_at: Column | str = "created_at") -> Column:
    """The time of an RFC 3339 string; null if it does not parse."""
    return F.try_to_timestamp(F.col(created_at) if isinstance(created_at, str) else created_at)


def payload_path(*keys: str) -> Column:
    """The text of a member of raw's operation; null if it or a parent is missing or null. Keys may hold any character but a quote."""
    return F.get_json_object("raw", "$" + "".join(f"['{k}']" for k in ("operation", *keys)))


def simple_path(path: str) -> Column:
    """The text at a dotted path: strings bare, other values as JSON; arrays have no members."""
    return F.get_json_object("raw", "$" + "".join(f"['{k}']" for k in path.split(".")))


def query_path(ops: DataFrame, path: str) -> DataFrame:
    """global_pos and value of every operation that has one at the path."""
    return ops.select("global_pos", simple_path(path).alias("value")).where("value is not null")


def query_stats(ops: DataFrame, value: Column) -> DataFrame:
    """operations, matches, total_bytes and matched_bytes of a query; a line counts with its line end."""
    return ops.select("raw", value.alias("v")).agg(
        F.count(F.lit(1)).alias("operations"), F.count("v").alias("matches"),
        F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.octet_length("v") + 1), F.lit(0)).alias("matched_bytes"),
    )


def bundles(ops: DataFrame, spec: str, last: int | None = None) -> DataFrame:
    """Operations of the bundles of a spec; without `last`, the log's own last bundle is what head and latest count from."""
    if last is None:
        last = ops.agg(F.max("bundle")).first()[0] or 0
    return ops.where(within("bundle", bundle_intervals(spec, last)))


def operations(ops: DataFrame, spec: str, size: int, last: int | None = None, prune: bool = True) -> DataFrame:
    found = operation_intervals(spec, last)
    return ops.where(pruned(found, size) if prune else within("global_pos", found))


def filtered(ops: DataFrame, did: str | None = None, kind: str | None = None, nullified: bool = False, after: str | None = None, before: str | None = None) -> DataFrame:
    """Operations of a DID, of a type, from a time on and up to one; nullified ones only if asked for."""
    out = ops if nullified else ops.where("not nullified")
    if did is not None:
        out = out.where(F.col("did") == did)
    if kind is not None:
        out = out.where(F.coalesce(payload_path("type"), F.get_json_object("raw", "$.operation")) == kind)
    if after is not None:
        out = out.where(F.col("created_at") >= after)
    return out if before is None else out.where(F.col("created_at") <= before)


def find_cid(ops: DataFrame, cid: str) -> DataFrame:
    """The first operation with a CID in log order."""
    return ops.where(F.col("cid") == cid).orderBy("global_pos").limit(1)


def containing(ops: DataFrame, text: str) -> DataFrame:
    return ops.where(F.get_json_object("raw", "$.operation").contains(text) | F.col("did").contains(text))


def safety_lag(ops: DataFrame, server_time: str, lag: str = "1 second") -> DataFrame:
    """Operations at least `lag` older than the server's time; those whose time does not parse are kept."""
    cutoff = F.expr(f"to_timestamp('{server_time}') - interval {lag}")
    return ops.where((instant() <= cutoff) | instant().isNull())


def batch_get(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """The operations at the requested (bundle, position)s; each bundle is scanned once."""
    return ops.join(requests.distinct(), ["bundle", "position"])


def batch_resolve(ops: DataFrame, dids: DataFrame) -> DataFrame:
    return ops.join(dids.distinct(), "did")


def shown(ops: DataFrame) -> DataFrame:
    """global_pos, did, type (or `unknown`), handle (or the first name without at://) and pds endpoint."""
    name = F.regexp_replace(F.get_json_object("raw", "$.operation.alsoKnownAs[0]"), "^at://", "")
    endpoint = F.get_json_object("raw", "$.operation.services.atproto_pds.endpoint")
    return ops.select("global_pos", "did", F.coalesce(payload_path("type"), F.lit("unknown")).alias("type"), F.coalesce(payload_path("handle"), name).alias("handle"), endpoint.alias("pds"))


def log_fields(ops: DataFrame) -> DataFrame:
    t = instant()
    return ops.select(
        "bundle", "position", "global_pos", F.when(F.col("nullified"), "nullified").otherwise("active").alias("status"), "cid", "created_at", "nullified",
        F.date_format(t, "yyyy-MM-dd").alias("date_short"), F.unix_timestamp(t).alias("timestamp"),
    )


def export(ops: DataFrame, count: int | None = None, reverse: bool = False) -> DataFrame:
    """Raw lines in log order, or against it; a count makes it a top-k, not a sort."""
    out = ops.select("global_pos", "raw").orderBy(F.desc("global_pos") if reverse else "global_pos")
    return out if count is None else out.limit(count)


def export_stats(ops: DataFrame) -> DataFrame:
    return ops.agg(F.count(F.lit(1)).alias("records_written"), F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)).alias("bytes_written"))


def sealed_and_pending(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log whose last bundle is not sealed yet: (its sealed bundles, the pending operations, of bundle 0)."""
    last = ops.agg(F.max("bundle").alias("last"))
    both = ops.join(F.broadcast(last))  # one row
    return both.where("bundle < last").drop("last"), both.where("bundle = last").withColumn("bundle", F.lit(0)).drop("last")


def without_boundary(batch: DataFrame, boundary: DataFrame) -> DataFrame:
    """batch without the CIDs of boundary; operations without a CID stay."""
    return batch.join(boundary.select("cid").where("cid is not null").distinct(), "cid", "left_anti").select(batch.columns)


def only_new(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """The first operation of each CID in batch that existing does not have; those without a CID are skipped."""
    first = batch.where("cid is not null").withColumn("_k", F.row_number().over(Window.partitionBy("cid").orderBy("global_pos"))).where("_k = 1").drop("_k")
    return without_boundary(first, existing)


def boundary_cids(ops: DataFrame) -> DataFrame:
    """(bundle, cid) of the trailing operations of each bundle that share its last time."""
    w = Window.partitionBy("bundle").orderBy(F.desc("position"))
    last = F.first("created_at").over(w)
    t = ops.select("bundle", "position", "cid", "created_at").withColumn("last", last)
    broken = F.max((F.col("created_at") != F.col("last")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("broken", broken).where("broken = 0 and cid is not null").select("bundle", "cid")


def order_violations(ops: DataFrame) -> DataFrame:
    """global_pos, created_at and the larger time before it in its bundle, of operations out of time order. Bundles are compared at their seams too."""
    w = Window.partitionBy("bundle").orderBy("position")
    t = ops.select("bundle", "global_pos", "position", "created_at", F.lag("created_at").over(w).alias("before"))
    ends = ops.groupBy((F.col("bundle") + 1).alias("b")).agg(F.max_by("created_at", "position").alias("end"))
    t = t.join(ends, F.col("bundle") == F.col("b"), "left").withColumn("before", F.coalesce("before", F.when(F.col("position") == 0, F.col("end"))))
    return t.where("created_at < before").select("global_pos", "created_at", "before")
