"""Bundle files: scans of JSON lines in zstd frames, their embedded metadata, discovery, and the writer."""

from __future__ import annotations

import hashlib
import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.coords import BUNDLE_SIZE, to_global
from strandlog.schema import ENVELOPE

#: First of the 16 magic numbers of zstd's skippable frames (a fixed value of the zstd format).
SKIPPABLE = 0x184D2A50
FRAME_OPS = 100


def frames_of(data: bytes) -> tuple[dict | None, int]:
    """(metadata, place of the first frame) of a bundle file."""
    meta = metadata_of(data)
    return meta, 0 if meta is None else 8 + struct.unpack_from("<I", data, 4)[0]


def lines_of(data: bytes) -> list[str]:
    """The lines of a bundle file that are not empty, frame by frame."""
    import io

    import zstandard

    _, start = frames_of(data)
    text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data[start:]), read_across_frames=True).read().decode()
    return [x for x in text.split("\n") if x]


def _content(spark: SparkSession, folder: str, intervals: list[tuple[int, int]] | None) -> DataFrame:
    """bundle and content of the files in a folder; with intervals, only those bundles' files that are there are opened."""
    names = "[0-9][0-9][0-9][0-9][0-9][0-9]"
    if intervals is not None:
        names = "{" + ",".join(f"{n:06d}" for low, high in intervals for n in range(low, high + 1)) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{names}.jsonl.zst").load(folder)
    return found.select(F.regexp_extract("path", r"([0-9]{6})\.jsonl\.zst$", 1).cast("int").alias("bundle"), "content")


def raw_lines(spark: SparkSession, folder: str, intervals: list[tuple[int, int]] | None = None, errors: bool = False) -> DataFrame:
    """bundle, position, raw of every line that is not empty, of the bundle files in a folder; with intervals, only those bundles' files are opened.

    A file is read and decompressed by one task, and positions are made there: no shuffle. A
    file that cannot be read fails the scan, or, with errors, gives one row with its error
    (and null position and raw), and the scan goes on.
    """

    def run(batches):
        for b in batches:
            for bundle, content in zip(b.column("bundle").to_pylist(), b.column("content"), strict=True):
                error = None
                try:
                    lines = lines_of(content.as_py())
                except Exception as e:
                    if not errors:
                        raise ValueError(f"bundle {bundle}: {e}") from e
                    lines, error = [], str(e)[:200] or type(e).__name__
                n = len(lines) if error is None else 1
                place = pa.array(range(n), pa.int32()) if error is None else pa.nulls(1, pa.int32())
                cols = [pa.array([bundle] * n, pa.int32()), place, pa.array(lines if error is None else [None], pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([error] * n, pa.string())] if errors else [])], names=["bundle", "position", "raw", "error"][: 3 + errors])

    return _content(spark, folder, intervals).mapInArrow(run, "bundle int, position int, raw string" + ", error string" * errors)


def points(spark: SparkSession, folder: str, wanted: list[tuple[int, int]]) -> DataFrame:
    """bundle, position, raw of the operations at the wanted (bundle, position)s: only their files are opened, and only their frames decompressed."""
    by: dict[int, list[int]] = {}
    for bundle, position in wanted:
        by.setdefault(bundle, []).append(position)

    def run(batches):
        for b in batches:
            for bundle, content in zip(b.column("bundle").to_pylist(), b.column("content"), strict=True):
                data = content.as_py()
                places = sorted(set(by[bundle]))
                yield pa.RecordBatch.from_arrays([pa.array([bundle] * len(places), pa.int32()), pa.array(places, pa.int32()), pa.array([operation_at(data, p) for p in places])], names=["bundle", "position", "raw"])

    return _content(spark, folder, [(n, n) for n in sorted(by)]).mapInArrow(run, "bundle int, position int, raw string")


def raw_bytes(spark: SparkSession, folder: str, decompressed: bool = False) -> DataFrame:
    """bundle and content of each bundle file, as it is or decompressed."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("content")[i].as_py()
                yield pa.RecordBatch.from_arrays([b.column("bundle").slice(i, 1), pa.array([("\n".join(lines_of(data)) + "\n").encode()], pa.binary())], names=["bundle", "content"])

    found = _content(spark, folder, None)
    return found.mapInArrow(run, "bundle int, content binary") if decompressed else found


def parsed(lines: DataFrame, size: int = BUNDLE_SIZE, mode: str = "PERMISSIVE") -> DataFrame:
    """Lines with did, cid, nullified, created_at, global_pos and operation (see schema.PAYLOAD).

    createdAt is used, else created_at; nullified is false unless it is true. With mode
    FAILFAST the first line that is no JSON object fails the read.
    """
    o = lines.withColumn("o", F.from_json("raw", ENVELOPE, {"mode": mode}))
    return o.select(
        "bundle", "position", to_global("bundle", "position", size).alias("global_pos"), "o.did", "o.cid", F.coalesce("o.nullified", F.lit(False)).alias("nullified"),
        F.coalesce("o.createdAt", "o.created_at").alias("created_at"), "o.operation", "raw",
    )


def scan(spark: SparkSession, path: str, size: int = BUNDLE_SIZE, mode: str = "PERMISSIVE", intervals: list[tuple[int, int]] | None = None) -> DataFrame:
    return parsed(raw_lines(spark, path, intervals), size, mode)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """bundle, path, length of the bundle files in a folder, by their names."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9][0-9][0-9][0-9][0-9][0-9].jsonl.zst").load(folder)
    return found.select(F.regexp_extract("path", r"([0-9]{6})\.jsonl\.zst$", 1).cast("int").alias("bundle"), "path", "length")


def metadata_of(data: bytes) -> dict | None:
    """The JSON in a file's leading skippable frame; None if it has none."""
    if len(data) < 8:
        return None
    magic, n = struct.unpack_from("<II", data)
    if magic & 0xFFFFFFF0 != SKIPPABLE:
        return None
    return json.loads(data[8 : 8 + n])


def embedded_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """bundle, length, compressed_hash and metadata (JSON, null if there is none) of each bundle file; nothing is decompressed."""

    def run(batches):
        for b in batches:
            content = b.column("content").to_pylist()
            meta = [metadata_of(x) for x in content]
            cols = [b.column("bundle"), b.column("length"), pa.array([hashlib.sha256(x).hexdigest() for x in content]), pa.array([None if m is None else json.dumps(m, sort_keys=True) for m in meta], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["bundle", "length", "compressed_hash", "metadata"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.zst").load(folder)
    found = found.select(F.regexp_extract("path", r"([0-9]{6})\.jsonl\.zst$", 1).cast("int").alias("bundle"), "length", "content")
    return found.mapInArrow(run, "bundle int, length long, compressed_hash string, metadata string")


def pack(lines: list[str], metadata: dict, frame_ops: int = FRAME_OPS) -> bytes:
    """A bundle file: a skippable frame of metadata (with the frames' offsets), then frames of frame_ops lines each."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
    frames = [z.compress(("\n".join(lines[k : k + frame_ops]) + "\n").encode()) for k in range(0, len(lines), frame_ops)]
    offsets = [0]
    for f in frames:
        offsets.append(offsets[-1] + len(f))
    meta = json.dumps(metadata | {"frame_count": len(frames), "frame_size": frame_ops, "frame_offsets": offsets}).encode()
    return struct.pack("<II", SKIPPABLE, len(meta)) + meta + b"".join(frames)


def operation_at(data: bytes, position: int) -> str:
    """One line of a bundle file's bytes, by decompressing its frame alone (all of them if the file states no offsets)."""
    import io

    import zstandard

    meta = metadata_of(data)
    start = 8 + struct.unpack_from("<I", data, 4)[0] if meta is not None else 0
    if meta and meta.get("frame_offsets"):
        frame, k = divmod(position, meta["frame_size"])
        a, b = meta["frame_offsets"][frame : frame + 2]
        return zstandard.ZstdDecompressor().decompress(data[start + a : start + b]).decode().split("\n")[k]
    text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data[start:]), read_across_frames=True).read()
    return text.decode().split("\n")[position]


def write(ops: DataFrame, folder: str, origin: str = "", frame_ops: int = FRAME_OPS) -> DataFrame:
    """Writes one file for each bundle of ops (bundle, position, raw) and returns what was written.

    A task holds one bundle at a time; a file is written under another name and renamed, so a
    retried task leaves whole files only. folder has to be one that all executors share.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        from pyarrow import fs as pafs

        lines = table.sort_by("position").column("raw").to_pylist()
        content = hashlib.sha256(("\n".join(lines) + "\n").encode()).hexdigest()
        bundle = key[0].as_py()
        meta = {"format": "jsonl-zst-frames/1", "bundle_number": bundle, "origin": origin, "operation_count": len(lines), "content_hash": content}
        data = pack(lines, meta, frame_ops)
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        name = f"{root.rstrip('/')}/{bundle:06d}.jsonl.zst"
        import uuid

        with fs.open_output_stream(tmp := f"{name}.{uuid.uuid4().hex}.tmp", compression=None) as f:
            f.write(data)
        fs.move(tmp, name)
        return pa.table({"bundle": pa.array([bundle], pa.int32()), "operations": pa.array([len(lines)], pa.int64()), "content_hash": [content], "compressed_hash": [hashlib.sha256(data).hexdigest()], "compressed_size": pa.array([len(data)], pa.int64())})

    return ops.select("bundle", "position", "raw").groupBy("bundle").applyInArrow(run, "bundle int, operations long, content_hash string, compressed_hash string, compressed_size long")
