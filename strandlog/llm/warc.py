"""WARC archives as a Spark data source, and de-duplicated archiving of pages.

`spark.read.format("warc")` plans its partitions by file size, reads each record's
headers first, applies pushed-down predicates on header columns, and inflates a
payload only if the record passed and the schema asks for something made from it.
`df.write.format("warc")` writes one archive a task and lists those of the tasks
that were committed, so a retried or speculative task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from strandlog.llm._common import fresh_dir

#: Columns that come from a record's headers alone; predicates on them are pushed down.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "warc_date": "WARC-Date",
    "header_digest": "WARC-Payload-Digest",
}
#: payload is the HTTP body; payload_bytes and payload_sha1 describe the full payload, of revisits as their headers state it.
SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, warc_date string, "
    "header_digest string, payload binary, payload_bytes long, payload_sha1 string"
)
BIN_BYTES = 64 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTH_FIELD = b"WL"  # gzip extra field: the member's length, to seek past it


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """One gzip member that states its own length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + _LENGTH_FIELD + struct.pack("<HQ", 8, total)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(uri: str | None) -> str | None:
    """Header values stay on one line."""
    return None if uri is None else uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(uri: str | None) -> str | None:
    return None if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


@dataclass
class Archives(InputPartition):
    files: list[str]


@dataclass
class Committed(WriterCommitMessage):
    file: str | None
    records: int


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


class _Window:
    """Reads of a file at any place, from a buffer that moves on in steps of STEP."""

    STEP = 1 << 20

    def __init__(self, f):
        self.f, self.at, self.data = f, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from `at` on; fewer at the file's end alone."""
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.f.seek(at)
            self.at, self.data = at, self.f.read(self.STEP)
        return self.data[at - self.at : at - self.at + n]


#: Bytes that are inflated at once in search of the end of a record's headers, and of a payload.
HEAD, PART = 1 << 10, 1 << 18


def records(f, compressed: bool, wanted, with_block) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the records for which wanted(headers) holds; block is None unless with_block(headers).

    Of a gzip member as much as HEAD bytes past its headers is inflated, and the rest only if the
    block is asked for, or, piece by piece, to find the end of a member that does not state it.
    """
    f.seek(0)
    end = f.size()
    at = 0
    window = _Window(f)
    while at < end:
        if not compressed:
            f.seek(at)
            head, start = _head_plain(f, at)
            if head is None:
                return
            h = _parse(head)
            n = int(h.get("content-length", 0))
            at = start + n + 4
            if wanted(h):
                block = None
                if with_block(h):
                    f.seek(start)
                    block = f.read(n)
                yield h, block
            continue
        first = window.get(at, 24)
        skip = None
        if first[3:4] == b"\x04" and first[12:14] == _LENGTH_FIELD:
            skip = struct.unpack("<Q", first[16:24])[0]
        z = zlib.decompressobj(31)
        to = at

        def inflate(most):
            nonlocal to
            left = z.unconsumed_tail
            if not left:
                left = window.get(to, 4096 if most == HEAD else PART)
                if not left:
                    raise ValueError("truncated WARC member")
                to += len(left)
            return z.decompress(left, most)

        data = b""
        while b"\r\n\r\n" not in data and not z.eof:
            data += inflate(HEAD)
        head, _, rest = data.partition(b"\r\n\r\n")
        h = _parse(head)
        ok = wanted(h)
        need = ok and with_block(h)
        if skip is not None and not need:
            at += skip
        else:
            parts = [rest]
            while not z.eof:
                got = inflate(PART)
                if need:
                    parts.append(got)
            at = to - len(z.unused_data)
            rest = b"".join(parts)
        if ok:
            yield h, rest[: int(h.get("content-length", 0))] if need else None


def _head_plain(f, at: int) -> tuple[bytes | None, int]:
    data = b""
    while (cut := data.find(b"\r\n\r\n")) < 0:
        more = f.read(4096)
        if not more:
            return None, at
        data += more
    return data[:cut], at + cut + 4


_LIST = "_archives-"


def _committed(fs: pafs.FileSystem, root: str) -> dict[str, list[str]]:
    """The lists that writes have left in a folder, each with the archives of its write."""
    out = {}
    for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if x.base_name.startswith(_LIST):
            with fs.open_input_stream(x.path) as f:
                out[x.path] = json.loads(f.read())
    return out


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [x.name for x in schema.fields]
        self.arrow = pa.schema([(x.name, {"binary": pa.binary(), "bigint": pa.int64()}.get(x.dataType.simpleString(), pa.string())) for x in schema.fields])
        self.path = options["path"]
        self.bin_bytes = int(options.get("binBytes", BIN_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "eq", f.value))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "start", f.value))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self):
        fs, root = _open(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            found = [fs.get_file_info(root)]
        elif listed := _committed(fs, root):
            found = fs.get_file_info([f"{root.rstrip('/')}/{x}" for names in listed.values() for x in names])
        else:
            found = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        bins, size = [[]], 0
        for x in sorted(found, key=lambda x: x.path):
            if bins[-1] and size + x.size > self.bin_bytes:
                bins.append([])
                size = 0
            bins[-1].append(x.path)
            size += x.size
        return [Archives(x) for x in bins]

    def _value(self, h: dict[str, str], name: str) -> str | None:
        v = h.get(HEADERS[name].lower())
        return _unclean(v) if name == "target_uri" else v

    def _wanted(self, h: dict[str, str]) -> bool:
        for name, kind, to in self.tests:
            v = self._value(h, name)
            if v is None or kind == "eq" and v != to or kind == "in" and v not in to or kind == "start" and not v.startswith(to):
                return False
        return True

    def read(self, partition):
        fs, _ = _open(self.path)
        body = {"payload", "payload_bytes", "payload_sha1"} & set(self.names)
        cols, size = {n: [] for n in self.names}, 0
        for path in partition.files:
            with fs.open_input_file(path) as f:
                for h, block in records(f, path.endswith(".gz"), self._wanted, lambda h: bool(body)):
                    made = self._made(h, block) if body else {}
                    for n in self.names:
                        cols[n].append(made[n] if n in made else self._value(h, n))
                    size += 200 + len(made.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type) for x in self.arrow], schema=self.arrow)
                        cols, size = {n: [] for n in self.names}, 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type) for x in self.arrow], schema=self.arrow)

    def _made(self, h: dict[str, str], block: bytes) -> dict:
        out: dict = {"payload": None, "payload_bytes": None, "payload_sha1": None}
        payload, http = block, {}
        if h.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = _parse(head)
        if h.get("warc-type") == "revisit":
            said = h.get("warc-payload-digest", "")
            if said.startswith("sha1:"):
                out["payload_sha1"] = base64.b32decode(said[5:]).hex()
            if "content-length" in http:
                out["payload_bytes"] = int(http["content-length"])
        else:
            out["payload_bytes"] = len(payload)
            if "payload" in self.names:
                out["payload"] = payload
            if "payload_sha1" in self.names:
                out["payload_sha1"] = hashlib.sha1(payload).hexdigest()
        return out


class WarcWriter(DataSourceArrowWriter):
    """Takes record_type, record_id, target_uri, refers_to, warc_date and payload (the full payload, of revisits too)."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gz = options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        fs, root = _open(self.path)
        name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gz
        out, n = None, 0
        for batch in iterator:
            for row in _rows(batch):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                    out.write(self._pack(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                out.write(self._pack(self._record(row)))
                n += 1
        if out is not None:
            out.close()
        return Committed(name if out is not None else None, n)

    def _pack(self, data: bytes) -> bytes:
        return gzip_member(data) if self.gz else data

    def _record(self, row: dict) -> bytes:
        payload = row["payload"] or b""
        revisit = row["record_type"] == "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return record(
            {
                "WARC-Type": row["record_type"],
                "WARC-Record-ID": row["record_id"],
                "WARC-Date": row["warc_date"],
                "WARC-Target-URI": _clean(row["target_uri"]),
                "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                "WARC-Profile": REVISIT_PROFILE if revisit else None,
                "WARC-Refers-To": row["refers_to"],
                "Content-Type": "application/http; msgtype=response",
            },
            http if revisit else http + payload,
        )

    def commit(self, messages):
        """Lists this write's archives in a file of its own, so that writes to one folder add up; an overwriting one then drops the others'."""
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        before = _committed(fs, root) if self.overwrite else {}
        with fs.open_output_stream(f"{root.rstrip('/')}/{_LIST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(m.file for m in messages if m and m.file)).encode())
        for path, names in before.items():
            fs.delete_file(path)
            for x in names:
                fs.delete_file(f"{root.rstrip('/')}/{x}")

    def abort(self, messages):
        fs, root = _open(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{root.rstrip('/')}/{m.file}")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, payload and refers (the response's page_id, null for a response).

    Of pages with equal payloads of at least min_bytes, that with the largest page_id is
    the response and the others revisit it; smaller payloads are all responses. A null html
    is an empty payload. Rows that repeat the largest page_id are all responses; a null
    page_id never is the largest, and where a group has no other its rows are all responses.
    Columns besides these three are dropped, whatever their names.

    The largest id is pre-aggregated in each task. It is grouped by (digest, length) and
    joined by digest alone, so that the join has an exchange of its own on both sides,
    which AQE may split where one payload has very many pages.
    """
    bytes_of = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    big = F.octet_length("payload") >= min_bytes
    p = pages.select("page_id", "url", bytes_of.alias("payload"))
    most = (
        pages.select("page_id", bytes_of.alias("payload"))
        .where(big)
        .groupBy(F.sha2("payload", 256).alias("_digest"), F.octet_length("payload").alias("_n"))
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1 and _first is not null")
        .select("_digest", "_first")
    )
    own = F.when(big, F.sha2("payload", 256))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_first")), F.col("_first"))
    return p.withColumn("_own", own).join(most, F.col("_own") == F.col("_digest"), "left").select("page_id", "url", "payload", refers.alias("refers"))


def archive(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one WARC record for every row of pages (see with_revisits) to the folder path, beside the archives there.

    A task holds one row's payload at a time beside its Arrow batch, whatever its length. No pages leave an empty list of archives.
    """
    register(pages.sparkSession)
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    with_revisits(pages, min_bytes).select(
        F.when(F.col("refers").isNull(), "response").otherwise("revisit").alias("record_type"),
        uri("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(F.col("refers").isNotNull(), uri("refers")).alias("refers_to"),
        F.lit(date).alias("warc_date"),
        "payload",
    ).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The records under path; columns is the part of SCHEMA that is wanted, and payloads are only inflated if it asks for them.

    Every record has a type. That predicate is always there because Spark keeps the filters
    it last pushed into a Python source with the DataFrame, and asks again only where a query
    has any: without it, a DataFrame that was used with a filter would keep it. Use this
    function rather than the bare format where a DataFrame is used more than once.
    """
    register(spark)
    names = [c.split()[0] for c in columns.split(",")]
    with_type = columns if "record_type" in names else columns + ", record_type string"
    return spark.read.format("warc").schema(with_type).load(path).where("record_type is not null").select(names)


def page_of(uri: str) -> Column:
    """The page_id in a record's id; null where it was null."""
    return F.expr(f"try_cast(regexp_extract({uri}, '<urn:page:(-?[0-9]*)>', 1) as bigint)")


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives pages in the shared folder and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = fresh_dir(spark, "warc")
    archive(pages, path)
    back = read(spark, path, "record_type string, record_id string, refers_to string, payload_bytes long, payload_sha1 string")
    return back.where(F.col("record_type").isin("response", "revisit")).select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        F.col("payload_sha1").alias("payload_digest"),
        "record_type",
        page_of("refers_to").alias("refers_to"),
    )
