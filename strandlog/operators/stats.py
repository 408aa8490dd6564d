"""Statistics and inspection of operations and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import scalar as S
from strandlog.operators.log import instant, payload_path


def rows() -> Column:
    return F.count(F.lit(1))


def label(df: DataFrame, number: str) -> DataFrame:
    """first, last of each run of consecutive numbers."""
    island = F.col(number) - F.row_number().over(Window.orderBy(number))
    return df.select(number).distinct().withColumn("_g", island).groupBy("_g").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_g")


def summary(bundles: DataFrame) -> DataFrame:
    s = lambda c: F.sum(c).cast("long")
    a = bundles.agg(
        rows().alias("bundles"), F.min("bundle_number").alias("first_bundle"), F.max("bundle_number").alias("last_bundle"), s("operation_count").alias("operations"),
        s("compressed_size").alias("compressed"), s("uncompressed_size").alias("uncompressed"),
    )
    return a.select(
        "*", F.when(F.col("uncompressed") > 0, (1 - F.col("compressed") / F.col("uncompressed")) * 100).otherwise(0.0).alias("ratio"),
        (F.col("operations") / F.col("bundles")).alias("avg_operations"), (F.col("compressed") / F.col("bundles")).alias("avg_compressed"),
    )


def operation_types(ops: DataFrame) -> DataFrame:
    """n, share (percent) and nullified of each operation type; a missing one is `unknown`."""
    g = ops.groupBy(F.coalesce(payload_path("type"), F.lit("unknown")).alias("type")).agg(rows().alias("n"), F.count_if("nullified").alias("nullified"))
    return g.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def did_counts(ops: DataFrame) -> DataFrame:
    """dids, and those with one and with more operations, the most of one, the mean; exact."""
    return ops.groupBy("did").agg(rows().alias("n")).agg(
        rows().alias("dids"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("most"), F.avg("n").alias("mean")
    )


def timeline(bundles: DataFrame) -> DataFrame:
    a = bundles.agg(F.min("start_time").alias("earliest"), F.max("end_time").alias("latest"), F.sum("operation_count").cast("long").alias("operations"), rows().alias("bundles"))
    days = (F.unix_timestamp(instant("latest")) - F.unix_timestamp(instant("earliest"))) / 86400.0
    a = a.withColumn("days", days)
    rate = lambda c: F.when(F.col("days") > 0, F.col(c) / F.col("days"))
    return a.withColumn("operations_per_day", rate("operations")).withColumn("bundles_per_day", rate("bundles"))


def per_date(bundles: DataFrame) -> DataFrame:
    return bundles.groupBy(F.substring("start_time", 1, 10).alias("date")).agg(F.sum("operation_count").cast("long").alias("operations"))


def totals(ops: DataFrame) -> DataFrame:
    """Totals of an inspection; types are counted only where there is one."""
    return ops.agg(rows().alias("operations"), F.count_if("nullified").alias("nullified"), F.countDistinct("did").alias("dids"), F.count(payload_path("type")).alias("typed"), F.countDistinct(payload_path("type")).alias("types"))


def names(ops: DataFrame) -> DataFrame:
    """Each at:// name of an operation, up to a slash."""
    aka = F.from_json(F.get_json_object("raw", "$.operation.alsoKnownAs"), "array<string>")
    n = ops.select(F.explode(aka).alias("name")).where(F.col("name").startswith("at://"))
    return n.select(F.substring_index(F.expr("substr(name, 6)"), "/", 1).alias("name"))


def domains(ops: DataFrame) -> DataFrame:
    """Names by their last two labels, and those with an underscore."""
    parts = F.split("name", r"\.")
    domain = F.when(F.size(parts) >= 2, F.concat_ws(".", F.slice(parts, -2, 2)))
    return names(ops).groupBy(domain.alias("domain")).agg(rows().alias("n"), F.count_if(F.col("name").contains("_")).alias("invalid"))


def endpoints(ops: DataFrame) -> DataFrame:
    e = F.get_json_object("raw", "$.operation.services.atproto_pds.endpoint")
    host = F.substring_index(F.regexp_replace(e, "^https?://", ""), "/", 1)
    return ops.select(host.alias("host")).where("host is not null").groupBy("host").agg(rows().alias("n"))


def service_total(ops: DataFrame) -> DataFrame:
    keys = F.json_object_keys(F.get_json_object("raw", "$.operation.services"))
    return ops.agg(F.coalesce(F.sum(F.size(F.coalesce(keys, F.array()))), F.lit(0)).cast("long").alias("services"))


def top(counts: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k largest counts; ties by key."""
    return counts.where(F.col(key).isNotNull()).select(key, "n").orderBy(F.desc("n"), key).limit(k)


def hourly(ops: DataFrame) -> DataFrame:
    """active_hours, peak_hour (ties: the earliest) and its operations, and active minutes."""
    minutes = ops.groupBy(F.date_trunc("minute", instant()).alias("m")).agg(rows().alias("n")).where("m is not null")
    hours = minutes.groupBy(F.date_trunc("hour", "m").alias("h")).agg(F.sum("n").alias("n"), rows().alias("minutes"))
    best = F.max(F.struct("n", (-F.unix_timestamp("h")).alias("t")))
    a = hours.agg(rows().alias("active_hours"), F.sum("minutes").alias("active_minutes"), best.alias("best"))
    return a.select("active_hours", "active_minutes", F.date_format(F.timestamp_seconds(-F.col("best.t")), "yyyy-MM-dd HH:00").alias("peak_hour"), F.col("best.n").alias("peak_operations"))


def sizes(ops: DataFrame) -> DataFrame:
    n = F.octet_length("raw")
    return ops.agg(F.sum(n).alias("total"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.expr("sum(octet_length(raw)) div count(1)").alias("average"))


def rate(ops: DataFrame) -> DataFrame:
    """Operations per whole minute from the first to the last one; 0 below a minute."""
    a = ops.agg(rows().alias("operations"), F.min_by("created_at", "global_pos").alias("a"), F.max_by("created_at", "global_pos").alias("b"))
    minutes = F.floor((F.unix_micros(instant("b")) - F.unix_micros(instant("a"))) / 60_000_000)
    return a.select("operations", F.when((F.col("operations") > 1) & (minutes > 0), F.col("operations") / minutes).otherwise(0.0).alias("per_minute"))


def percentiles(df: DataFrame, value: str) -> DataFrame:
    """n, mean, least, most, p50, p95, p99 (of the sorted values, that at floor(p * n)) and the population's standard deviation.

    Exact, by one sort of the distinct values' counts, not of the values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(rows().alias("c"))
    n = F.sum("c").over(Window.partitionBy())
    upto = F.sum("c").over(Window.orderBy("v"))
    c = counts.withColumns({"n": n, "upto": upto})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("v")))
    mean = F.sum(F.col("v") * F.col("c")) / F.sum("c")
    return c.agg(
        F.max("n").alias("n"), mean.alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("v") * F.col("v") * F.col("c")) / F.sum("c") - mean * mean)).alias("stddev"),
    )


def pending_stats(pending: DataFrame) -> DataFrame:
    return pending.agg(
        rows().alias("operations"), F.countDistinct("did").alias("dids"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"), F.min("created_at").alias("first_time"), F.max("created_at").alias("last_time")
    )


def status(bundles: DataFrame, pending: DataFrame, size: int) -> DataFrame:
    """One row: what is sealed, what is pending, how full the next bundle is, and whether the manifest is sound."""
    from strandlog.sources.manifest import check_sequence

    b = bundles.agg(rows().alias("bundles"), F.max("bundle_number").alias("last_bundle"), F.sum("operation_count").cast("long").alias("operations"), F.max_by("hash", "bundle_number").alias("head_hash"))
    p = pending.agg(rows().alias("pending"))
    v = check_sequence(bundles).select("valid")
    out = b.join(F.broadcast(p)).join(F.broadcast(v))  # one row each
    return out.withColumn("fill", F.col("pending") * 100.0 / size).withColumn("health", F.when(~F.col("valid"), "broken").when(F.col("bundles") == 0, "empty").otherwise("ok"))


def listed(bundles: DataFrame) -> DataFrame:
    """The fields of a bundle listing."""
    a, b = instant("start_time"), instant("end_time")
    return bundles.select(
        F.col("bundle_number").alias("bundle"), "hash", F.left("hash", F.lit(12)).alias("hash_short"), F.col("content_hash").alias("content"), "parent",
        F.date_format(b, "yyyy-MM-dd").alias("date_short"), F.unix_timestamp(b).alias("timestamp"), F.col("operation_count").alias("ops"), F.col("did_count").alias("dids"),
        F.col("compressed_size").alias("size"), F.col("uncompressed_size").alias("uncompressed"),
        F.when(F.col("compressed_size") > 0, F.round(F.col("uncompressed_size") / F.col("compressed_size"), 2)).otherwise(0.0).alias("ratio"),
        (F.unix_timestamp(b) - F.unix_timestamp(a)).alias("timespan"), F.col("start_time").alias("start"), F.col("end_time").alias("end"),
    )


def fields(bundles: DataFrame, now: Column | str | None = None) -> DataFrame:
    """Every field of a bundle listing under its name and its other names; ages are as of now (default: the current time)."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp") if isinstance(now, str) else now
    a, b = instant("start_time"), instant("end_time")
    utc = lambda c: F.coalesce(F.date_format(instant(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col(c))
    short = lambda c: F.left(c, F.lit(12))
    age, span = F.unix_timestamp(now) - F.unix_timestamp(b), F.unix_timestamp(b) - F.unix_timestamp(a)
    mb = lambda c: S.fixed(F.col(c) / F.lit(1048576.0), 2)
    ratio = F.when(F.col("compressed_size") > 0, S.fixed(F.col("uncompressed_size") / F.col("compressed_size"), 2)).otherwise("0")
    named = {
        ("bundle",): F.col("bundle_number"), ("hash",): F.col("hash"), ("hash_short",): short("hash"), ("content",): F.col("content_hash"), ("content_short",): short("content_hash"),
        ("parent",): F.col("parent"), ("parent_short",): short("parent"), ("date", "time"): utc("end_time"), ("date_short",): F.coalesce(F.date_format(b, "yyyy-MM-dd"), F.col("end_time")),
        ("timestamp", "unix"): F.coalesce(F.unix_timestamp(b), F.lit(0)), ("age",): F.coalesce(S.format_duration_compact(age), F.lit("unknown")), ("age_seconds",): F.coalesce(age, F.lit(0)),
        ("ops", "operations"): F.col("operation_count"), ("dids",): F.col("did_count"), ("size", "compressed"): F.col("compressed_size"), ("size_mb",): mb("compressed_size"),
        ("size_h", "size_human"): S.format_bytes_compact(F.col("compressed_size")), ("uncompressed",): F.col("uncompressed_size"), ("uncompressed_mb",): mb("uncompressed_size"),
        ("uncompressed_h", "uncompressed_human"): S.format_bytes_compact(F.col("uncompressed_size")), ("ratio",): ratio,
        ("timespan", "duration"): F.coalesce(S.format_duration_compact(span), F.lit("unknown")), ("timespan_seconds",): F.coalesce(span, F.lit(0)),
        ("start",): utc("start_time"), ("end",): utc("end_time"), ("created",): utc("created_at"),
    }
    return bundles.select(*(c.alias(n) for names, c in named.items() for n in names))


def rollback(ops: DataFrame, target: int) -> DataFrame:
    """Operations, DIDs and bundles after bundle `target`, which a rollback to it gives up."""
    return ops.where(F.col("bundle") > target).agg(F.countDistinct("bundle").alias("bundles"), rows().alias("operations"), F.countDistinct("did").alias("dids"))


def rollback_of_manifest(bundles: DataFrame, target: int) -> DataFrame:
    gone = bundles.where(F.col("bundle_number") > target)
    return gone.agg(
        rows().alias("bundles"), F.sum("operation_count").cast("long").alias("operations"), F.sum("compressed_size").cast("long").alias("bytes"), F.min("start_time").alias("from_time"), F.max("end_time").alias("to_time")
    )

