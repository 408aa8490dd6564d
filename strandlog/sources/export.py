"""Exports of operations as text: JSON lines, indented JSON and comma-separated values."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FORMATS = ("jsonl", "json", "csv")


def _indented(raw: pa.Array) -> pa.Array:
    return pa.array([None if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False) for x in raw.to_pylist()], pa.string())


def text_of(kind: str = "jsonl") -> Column:
    """An operation's text: its line as it is, its JSON indented, or did, operation, time and nullified without quotes, between commas."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind!r}")
    if kind == "jsonl":
        return F.col("raw")
    if kind == "json":
        return arrow_udf(_indented, "string")("raw")
    part = lambda p: F.coalesce(F.get_json_object("raw", p), F.lit(""))
    time = F.coalesce(F.get_json_object("raw", "$.createdAt"), part("$.created_at"))
    op = F.get_json_object("raw", "$.operation")
    # a payload that is a string keeps its quotes
    quoted = F.when(F.to_json(F.try_parse_json("raw")).isNotNull() & F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), "$.operation", "variant")).eqNullSafe("STRING"), F.to_json(F.try_variant_get(F.try_parse_json("raw"), "$.operation", "variant")))
    null = F.coalesce(F.get_json_object("raw", "$.nullified") == "true", F.lit(False))
    return F.concat(part("$.did"), F.lit(","), F.coalesce(quoted, op, F.lit("")), F.lit(","), time, F.lit(","), F.when(null, "true").otherwise("false"))


def exported(ops: DataFrame, kind: str = "jsonl") -> DataFrame:
    """global_pos and text of each operation."""
    return ops.select("global_pos", text_of(kind).alias("text"))


def write(ops: DataFrame, path: str, kind: str = "jsonl", reverse: bool = False, compression: str = "none") -> DataFrame:
    """Writes the operations' texts in log order, or against it, to text files whose names sort so; returns records_written and bytes_written.

    The rows are range-sorted, so files are written in parallel and their concatenation is the export.
    """
    order = F.desc("global_pos") if reverse else F.asc("global_pos")
    exported(ops, kind).orderBy(order).select("text").write.mode("overwrite").option("compression", compression).text(path)
    return written(ops.sparkSession.read.text(path, lineSep="\n"))


def written(lines: DataFrame) -> DataFrame:
    """Counters of text lines: their number, and their bytes with line ends."""
    return lines.agg(F.count(F.lit(1)).alias("records_written"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes_written"))


def pages(values: DataFrame, out, batch: int = 1000) -> tuple[int, int]:
    """Writes the texts of values (one string column) to out in batches, as they come; returns their number and matched bytes.

    For a terminal or a pipe: rows go through the driver, a partition at a time.
    """
    n = size = 0
    held: list[str] = []
    for (text,) in values.toLocalIterator(prefetchPartitions=True):
        held.append(text)
        n += 1
        size += len(text.encode()) + 1
        if len(held) >= batch:
            out.write("\n".join(held) + "\n")
            held = []
    if held:
        out.write("\n".join(held) + "\n")
    return n, size
