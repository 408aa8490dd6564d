"""Verification of bundle files against a manifest."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators.compare import links
from strandlog.sources.bundles import lines_of, metadata_of

#: What each mode reads: sizes and embedded metadata; the files' hashes too; their lines too.
MODES = ("fast", "compressed", "full")


def files(spark: SparkSession, folder: str, manifest: DataFrame, mode: str = "full") -> DataFrame:
    """bundle_number, valid and errors (comma-separated) of the manifest's bundles against the files in a folder.

    fast compares sizes and the metadata that files state, without a hash; compressed hashes
    the files too; full decompresses them, and counts and hashes their lines. One task reads a
    file; nothing is shuffled but one short row a bundle.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode!r}")

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("b", "said", "hash", "n", "content", "broken")}
            for bundle, content in zip(b.column("bundle").to_pylist(), b.column("content"), strict=True):
                data, meta, broken = content.as_py(), None, None
                n = own = None
                try:
                    meta = metadata_of(data)
                    if mode == "full":
                        lines = lines_of(data)
                        n, own = len(lines), hashlib.sha256(("\n".join(lines) + "\n").encode()).hexdigest()
                except Exception as e:
                    broken = type(e).__name__
                row = (bundle, None if meta is None else json.dumps(meta), hashlib.sha256(data).hexdigest() if mode != "fast" else None, n, own, broken)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            cols = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, b.column("length")], names=[*out, "length"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.zst").load(folder)
    found = found.select(F.regexp_extract("path", r"([0-9]{6})\.jsonl\.zst$", 1).cast("int").alias("bundle"), "content", "length")
    found = found.mapInArrow(run, "b int, said string, hash string, n int, content string, broken string, length long")
    j = manifest.select("bundle_number", "operation_count", "content_hash", "compressed_hash", "compressed_size").join(found, F.col("bundle_number") == F.col("b"), "left")
    said = lambda k: F.get_json_object("said", f"$.{k}")
    checks = {
        "missing": F.col("b").isNull(), "unreadable": F.col("broken").isNotNull(), "size": F.col("length") != F.col("compressed_size"), "compressed_hash": F.col("hash") != F.col("compressed_hash"),
        "content_hash": F.col("content") != F.col("content_hash"), "operation_count": F.col("n") != F.col("operation_count"),
        "metadata_number": said("bundle_number").cast("int") != F.col("bundle_number"), "metadata_hash": said("content_hash") != F.col("content_hash"), "metadata_count": said("operation_count").cast("int") != F.col("operation_count"),
    }
    errors = F.array_join(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull()), ",")
    return j.select("bundle_number", (errors == "").alias("valid"), errors.alias("errors"))


def repository(spark: SparkSession, folder: str, manifest: DataFrame, mode: str = "full") -> tuple[DataFrame, DataFrame | None]:
    """(files' verification, links of the chain): the second pass is made only if every file is valid. Rows are as short, and as many, as a manifest's."""
    found = files(spark, folder, manifest, mode)
    first = spark.createDataFrame(found.collect(), found.schema)
    return first, links(manifest) if first.where("not valid").isEmpty() else None
