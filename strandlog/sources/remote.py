"""Repositories and upstreams over HTTP: manifests, bundle files and lines, documents, and a streaming source of new operations."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from strandlog.schema import MANIFEST

#: Tries of a request, seconds that a Retry-After may ask for at most, seconds before a time-out.
TRIES, LONGEST, TIMEOUT = 5, 60.0, 30.0


class Gone(ValueError):
    """The server has no such thing; asking again does not help."""


def normalized(url: str) -> str:
    """A repository's address without slashes and manifest names at its end."""
    bare = url.rstrip("/")
    for name in ("/index.json", "/plc_bundles.json"):
        bare = re.sub(f"({re.escape(name)})+$", "", bare)
    return bare


def get(url: str, tries: int = TRIES, timeout: float = TIMEOUT, sleep: Callable[[float], None] = time.sleep, first: float = 1.0) -> bytes:
    """The body at a URL. Asked again after 429 (when Retry-After says, LONGEST at most), 5xx and broken connections, with waits that double."""
    for k in range(tries):
        wait = first * 2**k
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "strandlog"}), timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                raise Gone(f"{url}: {e.code}") from e
            if e.code != 429 and e.code < 500:
                raise
            after = e.headers.get("Retry-After", "")
            if e.code == 429 and after.isdigit():
                wait = min(LONGEST, float(after))
            last = e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            last = e
        if k + 1 < tries:
            sleep(wait)
    raise last


@dataclass(frozen=True)
class Remote:
    """A repository behind an address, or in a folder of this machine; its methods run wherever they are called."""

    url: str
    tries: int = TRIES

    def _get(self, name: str) -> bytes:
        base = normalized(self.url)
        if "://" in base:
            return get(f"{base}/{name}", self.tries)
        with open(f"{base}/{name}", "rb") as f:
            return f.read()

    def manifest(self, spark: SparkSession, name: str = "index.json") -> DataFrame:
        """The bundles that the repository's manifest lists: one short row each, read by the driver."""
        rows = json.loads(self._get(name))["bundles"]
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MANIFEST)

    def bundle(self, number: int) -> bytes:
        """A bundle file's bytes: what maintenance.clone asks for."""
        return self._get(f"data/{number}") if "://" in self.url else self._get(f"{number:06d}.jsonl.zst")

    def lines(self, number: int) -> list[str]:
        return [x for x in self._get(f"jsonl/{number}").decode().split("\n") if x]

    def document(self, did: str) -> dict:
        return json.loads(self._get(did))

    def operations(self, spark: SparkSession, numbers: list[int], parallel: int = 4) -> DataFrame:
        """bundle, position, raw of some bundles, fetched as lines by the executors."""
        import pyarrow as pa

        def run(batches):
            for b in batches:
                for n in b.column("bundle").to_pylist():
                    got = self.lines(n)
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(got), pa.int32()), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.string())], names=["bundle", "position", "raw"])

        return spark.createDataFrame([(n,) for n in numbers], "bundle int").repartition(parallel, "bundle").mapInArrow(run, "bundle int, position int, raw string")


def resolve_handle(handle: str, resolver: str, tries: int = TRIES) -> str | None:
    """The DID that a resolver's address knows for a handle; None if it knows none."""
    try:
        return json.loads(get(f"{normalized(resolver)}/xrpc/com.atproto.identity.resolveHandle?handle={urllib.parse.quote(handle)}", tries)).get("did")
    except Gone:
        return None


class Pace:
    """At most `most` requests a `seconds`: acquire() waits for a place."""

    def __init__(self, most: int = 90, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.seconds, self.clock, self.sleep = most, seconds, clock, sleep
        self.free, self.at = float(most), clock()

    def acquire(self) -> None:
        now = self.clock()
        self.free = min(self.most, self.free + (now - self.at) * self.most / self.seconds)
        self.at = now
        if self.free < 1:
            wait = (1 - self.free) * self.seconds / self.most
            self.sleep(wait)
            self.free, self.at = 1.0, self.at + wait
        self.free -= 1


def export_page(url: str, after: str = "", count: int = 1000, **how) -> list[dict]:
    """Operations after a time, as the upstream's export lists them: fields of an operation and raw, its line."""
    query = urllib.parse.urlencode({k: v for k, v in (("after", after), ("count", count)) if v})
    out = []
    for line in get(f"{normalized(url)}/export?{query}", **how).decode().split("\n"):
        if line:
            x = json.loads(line)
            null = x.get("nullified")
            out.append({"did": x.get("did"), "cid": x.get("cid"), "nullified": null is True or isinstance(null, str) and null != "", "created_at": x.get("createdAt") or x.get("created_at"), "raw": line})
    return out


class ExportReader(SimpleDataSourceStreamReader):
    """Pages of an upstream's export. The offset is the time of the last operation that was read; those of equal time come again
    with the next page, and the ingest drops them by their CIDs."""

    def __init__(self, options):
        self.url, self.count = options["url"], int(options.get("count", 1000))
        self.start = options.get("after", "")
        self.pace = Pace(int(options.get("requestsPerMinute", 90)))

    def initialOffset(self):
        return {"after": self.start}

    def read(self, start):
        """The next page; none of it if all of its operations are of the time that has been read. A whole page of that time is asked for again, twice as long."""
        count = self.count
        while True:
            self.pace.acquire()
            rows = export_page(self.url, start["after"], count)
            end = max([start["after"], *(r["created_at"] for r in rows if r["created_at"])])
            if end > start["after"]:
                return iter([(r["did"], r["cid"], r["nullified"], r["created_at"], r["raw"]) for r in rows]), {"after": end}
            if len(rows) < count:
                return iter([]), start
            count *= 2

    def readBetweenOffsets(self, start, end):
        rows = export_page(self.url, start["after"], self.count)
        return iter([(r["did"], r["cid"], r["nullified"], r["created_at"], r["raw"]) for r in rows if not r["created_at"] or r["created_at"] <= end["after"]])


class ExportSource(DataSource):
    """Format `operation_export`; options url, after, count, requestsPerMinute. Its stream is what streaming.seal takes in."""

    @classmethod
    def name(cls):
        return "operation_export"

    def schema(self):
        return "did string, cid string, nullified boolean, created_at string, raw string"

    def simpleStreamReader(self, schema):
        return ExportReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExportSource)
