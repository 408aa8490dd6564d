"""Manifests: the description of a log's bundles, from a file or from the operations themselves."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.coords import BUNDLE_SIZE
from strandlog.schema import MANIFEST
from strandlog.sources.bundles import embedded_metadata, lines_of
from strandlog.sources.store import Store

GENESIS = "genesis:"


def content(ops: DataFrame) -> DataFrame:
    """What follows from a bundle's own operations: times, counts, sizes and the hash of its lines in order."""
    return ops.groupBy("bundle").agg(
        F.min_by("created_at", "position").alias("start_time"), F.max_by("created_at", "position").alias("end_time"),
        F.count(F.lit(1)).cast("int").alias("operation_count"), F.countDistinct("did").cast("int").alias("did_count"),
        F.sum(F.octet_length("raw") + 1).alias("uncompressed_size"),
        F.expr("sha2(concat(listagg(raw, '\\n') within group (order by position), '\\n'), 256)").alias("content_hash"),
    )


def chained(bundles: DataFrame, genesis: str = GENESIS, parent: str = "", cursor: str = "") -> DataFrame:
    """bundles (one row a bundle) with parent, hash and cursor: each hash is that of the parent's and the own content hash.

    parent and cursor are those of the first of them: the hash and the end time of the bundle before it.

    A chain is a fold over the bundles in order, so one task goes through the manifest, one
    short row for each bundle.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bundles.schema.fields)

    def run(batches):
        before, since = parent, cursor
        for b in batches:
            hashes, parents, cursors = [], [], []
            for h, end in zip(b.column("content_hash").to_pylist(), b.column("end_time").to_pylist(), strict=True):
                parents.append(before)
                cursors.append(since)
                before = hashlib.sha256(f"{before + ':' if before else genesis}{h}".encode()).hexdigest()
                since = end
                hashes.append(before)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parents, pa.string()), pa.array(hashes, pa.string()), pa.array(cursors, pa.string())], names=[*b.schema.names, "parent", "hash", "cursor"])

    return bundles.repartition(1).sortWithinPartitions("bundle").mapInArrow(run, schema + ", parent string, hash string, cursor string")


def content_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """content of the bundle files in a folder, with the files' length and compressed_hash. One task reads a file and gives its row; nothing is shuffled."""

    def run(batches):
        for b in batches:
            for i, (bundle, data) in enumerate(zip(b.column("bundle").to_pylist(), b.column("content"), strict=True)):
                data = data.as_py()
                try:
                    lines = lines_of(data)
                except Exception as e:
                    raise ValueError(f"bundle {bundle}: {e}") from e
                if lines:
                    text = ("\n".join(lines) + "\n").encode()
                    own = [pa.array([hashlib.sha256(data).hexdigest()]), pa.array([len(text)], pa.int64()), pa.array([hashlib.sha256(text).hexdigest()]), pa.array([lines], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([b.column("bundle").slice(i, 1), b.column("length").slice(i, 1), *own], names=["bundle", "length", "compressed_hash", "uncompressed_size", "content_hash", "lines"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9][0-9][0-9][0-9][0-9][0-9].jsonl.zst").load(folder)
    found = found.select(F.regexp_extract("path", r"([0-9]{6})\.jsonl\.zst$", 1).cast("int").alias("bundle"), "length", "content")
    found = found.mapInArrow(run, "bundle int, length long, compressed_hash string, uncompressed_size long, content_hash string, lines array<string>")
    own = found.withColumn("o", F.expr("transform(lines, x -> from_json(x, 'did string, createdAt string, created_at string'))"))
    time = lambda k: F.expr(f"coalesce(element_at(o, {k}).createdAt, element_at(o, {k}).created_at)")
    return own.select(
        "bundle", time(1).alias("start_time"), time(-1).alias("end_time"), F.size("lines").alias("operation_count"), F.expr("size(array_distinct(filter(o.did, x -> x is not null)))").alias("did_count"),
        "uncompressed_size", "content_hash", "length", "compressed_hash",
    )


def from_operations(ops: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """The manifest of sealed operations. Sizes of files are only known of files; here they are a tenth of the lines'."""
    return from_content(content(ops), genesis)


def from_content(bundles: DataFrame, genesis: str = GENESIS) -> DataFrame:
    c = chained(bundles, genesis)
    return c.select(
        F.col("bundle").alias("bundle_number"), "start_time", "end_time", "operation_count", "did_count", "hash", "content_hash", "parent",
        F.sha2(F.concat(F.lit("file:"), "content_hash"), 256).alias("compressed_hash"), F.expr("uncompressed_size div 10").alias("compressed_size"),
        "uncompressed_size", "cursor", F.col("end_time").alias("created_at"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The bundles of a manifest file."""
    m = spark.read.option("multiLine", True).schema(f"version string, origin string, last_bundle int, bundles array<struct<{MANIFEST.replace(' ', ':').replace(',:', ',')}>>").json(path)
    return m.select(F.inline("bundles"))


def rebuild(spark: SparkSession, folder: str, size: int = BUNDLE_SIZE, origin: str | None = None) -> DataFrame:
    """The manifest of the bundle files in a folder: hashes of the files and of their lines, chained anew.

    A file is read and described by one task; only the short rows of the chain are shuffled.
    Every file has to name the same origin in its metadata (that given, if one is), and the
    numbers have to go from 1 on without gaps; else ValueError. What comes to the driver is
    one row of counts.
    """
    found = embedded_metadata(spark, folder)
    own = found.select("bundle", F.get_json_object("metadata", "$.origin").alias("origin"))
    r = own.agg(F.count_distinct("origin").alias("n"), F.min("origin").alias("one"), F.min("bundle").alias("first"), F.max("bundle").alias("last"), F.count_distinct("bundle").alias("bundles")).first()
    if r.n > 1 or r.n and origin is not None and r.one != origin:
        raise ValueError(f"bundle files of another origin: {r.n} origins, one of them {r.one!r}")
    if r.bundles and (r.first != 1 or r.last != r.bundles):
        raise ValueError(f"{r.bundles} bundle files, numbered {r.first} to {r.last}")
    c = chained(content_of_files(spark, folder))
    return c.select(
        F.col("bundle").alias("bundle_number"), "start_time", "end_time", "operation_count", "did_count", "hash", "content_hash", "parent",
        "compressed_hash", F.col("length").alias("compressed_size"), "uncompressed_size", "cursor", F.col("end_time").alias("created_at"),
    )


def check_sequence(bundles: DataFrame, last_bundle: int | None = None) -> DataFrame:
    """first, last, n, gaps, and whether the numbers go from 1 to the last one without gaps."""
    w = Window.orderBy("bundle_number")
    gap = bundles.select("bundle_number", (F.col("bundle_number") - F.lag("bundle_number").over(w)).alias("step"))
    out = gap.agg(
        F.min("bundle_number").alias("first"), F.max("bundle_number").alias("last"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("step") != 1).cast("long")), F.lit(0)).alias("gaps")
    )
    agrees = F.lit(True) if last_bundle is None else F.col("last") == last_bundle
    return out.withColumn("valid", F.coalesce((F.col("first") == 1) & (F.col("gaps") == 0) & agrees, F.lit(last_bundle in (None, 0))))


def write(bundles: DataFrame, path: str, origin: str = "", version: str = "1.0") -> None:
    """Writes a manifest as one file, replaced as a whole, to any store. One short row a bundle comes to the driver."""
    rows = [r.asDict() for r in bundles.orderBy("bundle_number").toLocalIterator()]
    whole = {"version": version, "origin": origin, "last_bundle": rows[-1]["bundle_number"] if rows else 0, "updated_at": rows[-1]["created_at"] if rows else None,
             "total_size_bytes": sum(r["compressed_size"] for r in rows), "total_uncompressed_size_bytes": sum(r["uncompressed_size"] for r in rows), "bundles": rows}
    folder, _, name = path.rpartition("/")
    Store(bundles.sparkSession, folder or ".").put(name, json.dumps(whole).encode())
