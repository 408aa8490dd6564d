"""Maintenance of a folder of bundle files and its manifest: init, clean, delete, roll back, migrate, clone."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.coords import FILE_NAME, file_name
from strandlog.operators.stats import rollback_of_manifest
from strandlog.schema import MANIFEST
from strandlog.sources import bundles, manifest
from strandlog.sources.store import Store

NAME = "manifest.json"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.read(spark, f"{folder.rstrip('/')}/{NAME}")


def init(spark: SparkSession, folder: str, origin: str = "", force: bool = False) -> None:
    """An empty repository; one that is there stays, unless forced."""
    store = Store(spark, folder)
    if store.exists(NAME) and not force:
        raise FileExistsError(f"{folder} has a manifest already")
    store.make()
    manifest.write(spark.createDataFrame([], MANIFEST), f"{store.folder}/{NAME}", origin)


def on_disk(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(m[1]) for n in Store(spark, folder).sizes() if (m := FILE_NAME.match(n)))


def clean(spark: SparkSession, folder: str, preview: bool = False) -> dict[str, int]:
    """Names and sizes of temporary files that failed writes left; they are deleted, but for a preview."""
    store = Store(spark, folder)
    found = store.sizes("*.tmp")
    if not preview:
        for name in found:
            store.delete(name)
    return found


def delete(spark: SparkSession, folder: str, numbers: list[int]) -> list[int]:
    """Deletes the bundle files of some numbers; returns those that were there. The manifest stays as it is."""
    store, there = Store(spark, folder), set(on_disk(spark, folder))
    gone = sorted(there & set(numbers))
    for n in gone:
        store.delete(file_name(n))
    return gone


def rollback(spark: SparkSession, folder: str, to: int, keep_files: bool = False) -> dict:
    """Cuts the manifest off after bundle `to` and, unless they are kept, deletes the files after it; returns what was given up.

    The manifest is replaced first: a roll-back that fails later leaves files that it does not name.
    """
    rows = read_manifest(spark, folder)
    plan = rollback_of_manifest(rows, to).first().asDict()
    kept = rows.where(F.col("bundle_number") <= to).orderBy("bundle_number").collect()  # a manifest is one short row a bundle, and is written as one file
    manifest.write(spark.createDataFrame(kept, MANIFEST), f"{folder.rstrip('/')}/{NAME}")
    plan["deleted"] = [] if keep_files else delete(spark, folder, [n for n in on_disk(spark, folder) if n > to])
    return plan


def _fs(folder: str):
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _replace(fs, name: str, data: bytes) -> None:
    with fs.open_output_stream(tmp := f"{name}.{uuid.uuid4().hex}.tmp", compression=None) as f:
        f.write(data)
    fs.move(tmp, name)


def migrate(spark: SparkSession, folder: str, frame_ops: int = bundles.FRAME_OPS, force: bool = False, preview: bool = False) -> DataFrame:
    """Packs bundle files without frames anew: bundle, state (migrated, kept, would migrate), old_size, new_size, compressed_hash.

    A file's lines have to have the same hash before and after; the old file stays as .bak until
    the new one has been read back. A task works on one file at a time. The rows are stored
    nowhere: collect them, and rebuild the manifest from the files.
    """

    def run(batches):
        fs, root = _fs(folder)
        for b in batches:
            out = []
            for bundle, content in zip(b.column("bundle").to_pylist(), b.column("content"), strict=True):
                data = content.as_py()
                meta = bundles.metadata_of(data)
                if meta and meta.get("frame_offsets") and not force:
                    out.append((bundle, "kept", len(data), len(data), hashlib.sha256(data).hexdigest()))
                    continue
                lines = bundles.lines_of(data)
                digest = hashlib.sha256(("\n".join(lines) + "\n").encode()).hexdigest()
                new = bundles.pack(lines, {"format": "jsonl-zst-frames/1", "bundle_number": bundle, "origin": (meta or {}).get("origin", ""), "operation_count": len(lines), "content_hash": digest}, frame_ops)
                if not preview:
                    name = f"{root.rstrip('/')}/{file_name(bundle)}"
                    _replace(fs, name + ".bak", data)
                    _replace(fs, name, new)
                    with fs.open_input_stream(name, compression=None) as f:
                        again = bundles.lines_of(f.read())
                    if again != lines:
                        fs.move(name + ".bak", name)
                        raise ValueError(f"bundle {bundle} reads otherwise after its migration; the old file is back")
                    fs.delete_file(name + ".bak")
                out.append((bundle, "would migrate" if preview else "migrated", len(data), len(new), hashlib.sha256(new).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bundle", "state", "old_size", "new_size", "compressed_hash"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.zst").load(folder)
    found = found.select(F.regexp_extract("path", r"([0-9]{6})\.jsonl\.zst$", 1).cast("int").alias("bundle"), "content")
    return found.mapInArrow(run, "bundle int, state string, old_size long, new_size long, compressed_hash string")


def to_fetch(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """The manifest's bundles whose files are not on disk."""
    there = spark.createDataFrame([(n,) for n in on_disk(spark, folder)], "n int")
    return rows.join(there, F.col("bundle_number") == F.col("n"), "left_anti")


def clone(spark: SparkSession, rows: DataFrame, fetch: Callable[[int], bytes], folder: str, tries: int = 3, parallel: int = 4, origin: str = "") -> DataFrame:
    """Fetches the manifest's bundles that are not on disk, `parallel` at a time, and writes the manifest; returns bundle and error (null: fetched).

    fetch(n), which runs on the executors, gives a file's bytes; what does not have the
    manifest's hash counts as a failure, and is fetched again up to `tries` times. Bundles that
    are there already are not fetched: a clone that was broken off goes on where it was.
    """
    Store(spark, folder).make()

    def run(batches):
        fs, root = _fs(folder)
        for b in batches:
            errors = []
            for n, want in zip(b.column("bundle_number").to_pylist(), b.column("compressed_hash").to_pylist(), strict=True):
                error = "not tried"
                for _ in range(tries):
                    try:
                        data = fetch(n)
                        if hashlib.sha256(data).hexdigest() != want:
                            raise ValueError("the file's hash is not the manifest's")
                        _replace(fs, f"{root.rstrip('/')}/{file_name(n)}", data)
                        error = None
                        break
                    except Exception as e:
                        error = str(e)[:300] or type(e).__name__
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("bundle_number"), pa.array(errors, pa.string())], names=["bundle", "error"])

    todo = to_fetch(spark, rows, folder).select("bundle_number", "compressed_hash").repartition(parallel, "bundle_number")
    got = todo.mapInArrow(run, "bundle int, error string").collect()  # one short row a bundle, as the manifest
    there = set(on_disk(spark, folder))
    kept = [r for r in rows.orderBy("bundle_number").collect() if r["bundle_number"] in there]
    manifest.write(spark.createDataFrame(kept, rows.schema), f"{folder.rstrip('/')}/{NAME}", origin)
    return spark.createDataFrame(got, "bundle int, error string")


def describe(spark: SparkSession, folder: str, number: int, operations: bool = False) -> dict:
    """A bundle's manifest row, with its file's size and metadata and, if asked for, its operations' counts."""
    row = read_manifest(spark, folder).where(F.col("bundle_number") == number).first()
    if row is None:
        raise KeyError(f"no bundle {number}")
    store, name = Store(spark, folder), file_name(number)
    out = row.asDict() | {"file": name, "exists": store.exists(name), "metadata": None}
    if out["exists"]:
        data = store.read(name)
        out |= {"file_size": len(data), "metadata": bundles.metadata_of(data)}
        if operations:
            lines = [json.loads(x) for x in bundles.lines_of(data)]
            out |= {"operations": len(lines), "dids": len({x.get("did") for x in lines}), "nullified": sum(x.get("nullified") is True for x in lines)}
    return out
