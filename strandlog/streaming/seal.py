"""Ingest: orders, de-duplicates and seals operations into bundles, as a Structured Streaming sink.

A stream has no built-in window of N rows. Here a micro-batch is merged into the unsealed
tail, and whole bundles are cut off it: the batch's operations behind the safety lag, those
whose CID the tail or the boundary has already, and those older than the last accepted one
are told apart first. The repository is a folder:

    sealed/bundle=N     operations of sealed bundles, as Parquet
    bundles/N.jsonl.zst the same as bundle files
    manifest/batch=B    rows of the manifest of the bundles that batch B sealed, hashes chained
    index/batch=B       their part of the inverted index, by shard: layers of operators.index
    tail/batch=B        the unsealed operations after batch B; the last one counts
    withheld/batch=B    operations that the safety lag keeps back after batch B; they join the next batch
    state/B.json        what batch B did and where the chain is, written last: a batch that is replayed finds it and does nothing

so a batch that failed anywhere before its state file is simply done again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import index as did_index
from strandlog.operators.log import boundary_cids, instant, only_new, without_boundary
from strandlog.schema import MANIFEST
from strandlog.sources import bundles as bundle_files
from strandlog.sources import manifest as manifests

FIELDS = ["did", "cid", "nullified", "created_at", "raw"]
ROW = "did string, cid string, nullified boolean, created_at string, raw string"


class OutOfOrder(ValueError):
    """An operation is older than one that was accepted before it."""


@dataclass
class Sealed:
    """What a batch did: sealed bundles, and numbers of operations. part: 0, or the number of a release after the batch."""

    batch: int
    bundles: list[int] = field(default_factory=list)
    accepted: int = 0
    withheld: int = 0
    pending: int = 0
    caught_up: bool = True
    fetched: int = 0
    known: int = 0
    old: int = 0
    last_bundle: int = 0
    last_hash: str = ""
    last_end: str = ""
    part: int = 0
    written_at: str = field(default="", compare=False)

    @property
    def key(self) -> str:
        return f"{self.batch}-{self.part}" if self.part else str(self.batch)


def ranked(df: DataFrame, path: str, *order) -> DataFrame:
    """df with _k, its rows' number in an order, from 0 on: range-partitioned, sorted, stored at path, and numbered by the partitions' sizes."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")).write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    sizes, ahead, at = dict(stored.groupBy("_p").count().collect()), {}, 0  # one number a partition
    for p in sorted(sizes):
        ahead[p], at = at, at + sizes[p]
    starts = spark.createDataFrame(list(ahead.items()), "q int, ahead long")
    return stored.join(F.broadcast(starts), F.col("_p") == F.col("q")).withColumn("_k", F.col("ahead") + F.col("_i")).drop("_p", "_i", "q", "ahead")


class Repository:
    """files: seal bundle files, the manifest and the index too, not only the operations' table."""

    def __init__(self, spark: SparkSession, path: str, size: int = 10_000, lag: str = "1 second", strict_order: bool = True, files: bool = True, origin: str = ""):
        self.spark, self.path, self.size, self.lag, self.strict_order = spark, path.rstrip("/"), size, lag, strict_order
        self.files, self.origin = files, origin

    # --- files, by Hadoop's interface, so that any store will do

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, name: str) -> bool:
        fs, p = self._fs(name)
        return fs.exists(p)

    def _put(self, name: str, text: str) -> None:
        fs, p = self._fs(name + ".tmp")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(p, self._fs(name)[1])

    def _state(self, key: str) -> Sealed:
        fs, p = self._fs(f"state/{key}.json")
        source = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return Sealed(**json.loads(text))

    def last(self) -> Sealed | None:
        """The state after the last batch: one file's, found by the names."""
        if not self._exists("state"):
            return None
        fs, p = self._fs("state")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n.removesuffix(".json") for n in names if n.endswith(".json")]
        return self._state(max(done, key=lambda k: [int(x) for x in k.split("-")])) if done else None

    def last_bundle(self) -> int:
        state = self.last()
        return state.last_bundle if state else 0

    # --- tables

    def _read(self, name: str, schema: str, there: bool) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def sealed(self) -> DataFrame:
        last = self.last_bundle()
        return self._read("sealed", f"position int, {ROW}, bundle int", last > 0).where(F.col("bundle") <= last)

    def manifest(self) -> DataFrame:
        last = self.last_bundle()
        return self._read("manifest", MANIFEST, last > 0 and self.files).where(F.col("bundle_number") <= last).drop("batch")

    def index(self) -> DataFrame:
        """The sealed operations' inverted index, its layers merged."""
        layers = self._read("index", "batch string, identifier string, locations array<struct<global_pos:long,nullified:boolean>>, shard int", self.last_bundle() > 0 and self.files)
        return did_index.merged(layers)

    def tail(self, state: Sealed | None = None) -> DataFrame:
        state = state or self.last()
        return self._read(f"tail/batch={state.key if state else 0}", f"position int, {ROW}", bool(state and state.pending))

    def withheld(self, state: Sealed | None = None) -> DataFrame:
        state = state or self.last()
        return self._read(f"withheld/batch={state.key if state else 0}", ROW, bool(state and state.withheld))

    def fetch_log(self) -> DataFrame:
        """What each batch did, one row a batch."""
        names = {"bundles": "array<int>", "caught_up": "boolean", "last_hash": "string", "last_end": "string", "written_at": "string"}
        schema = ", ".join(f"{f.name} {names.get(f.name, 'long')}" for f in fields(Sealed))
        if not self._exists("state"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.path}/state")

    # --- ingest

    def accept(self, batch: DataFrame, batch_id: int, server_time: str | None = None, part: int = 0) -> Sealed:
        """Merges one micro-batch (did, cid, nullified, created_at, raw) and what was withheld before, and seals what makes whole bundles."""
        key = Sealed(batch_id, part=part).key
        if self._exists(f"state/{key}.json"):
            return self._state(key)
        state = self.last() or Sealed(-1)
        tail, last = self.tail(state), state.last_bundle
        before = self._read("sealed", f"position int, {ROW}, bundle int", last > 0).where(F.col("bundle") == last)
        now = F.lit(server_time).cast("timestamp") if server_time else F.current_timestamp()
        late = F.coalesce(instant() > now - F.expr(f"interval {self.lag}"), F.lit(False))
        got = batch.select(*FIELDS).withColumn("_from", F.lit(1)).unionByName(self.withheld(state).withColumn("_from", F.lit(0)))
        # stored, so that the time of the lag and the order of arrival are settled once
        got.select("*", late.alias("_late"), F.monotonically_increasing_id().alias("global_pos")).write.mode("overwrite").parquet(f"{self.path}/work/got")
        got = self.spark.read.parquet(f"{self.path}/work/got")
        counts = got.agg(F.count_if(F.col("_late")).alias("late"), F.count_if(F.col("_from") == 1).alias("fetched"), F.count(F.lit(1)).alias("n")).first()
        if counts.late:
            got.where("_late").select(*FIELDS).write.mode("overwrite").parquet(f"{self.path}/withheld/batch={key}")
        ready = got.where("not _late").select(*FIELDS, "global_pos")
        fresh = only_new(without_boundary(ready, boundary_cids(before)), tail)
        newest = tail.select(instant().alias("t")).unionByName(before.select(instant().alias("t"))).agg(F.max("t")).first()[0]
        n_old = 0
        if newest is not None:
            n_old = fresh.where(instant() < F.lit(newest)).count()
            if n_old and self.strict_order:
                raise OutOfOrder(f"{n_old} operations are older than {newest}")
            fresh = fresh.where((instant() >= F.lit(newest)) | instant().isNull())
        fresh = ranked(fresh.withColumn("_t", instant()), f"{self.path}/work/fresh", "_t", "global_pos")
        n_fresh, n_tail = fresh.count(), state.pending
        whole, rest = divmod(n_tail + n_fresh, self.size)
        # order: the tail as it is, then the new operations by time
        both = tail.withColumn("_k", F.col("position").cast("long")).select(*FIELDS, "_k").unionByName(fresh.withColumn("_k", F.col("_k") + n_tail).select(*FIELDS, "_k"))
        placed = both.withColumn("bundle", (F.floor(F.col("_k") / self.size) + last + 1).cast("int")).withColumn("position", (F.col("_k") % self.size).cast("int")).drop("_k")
        out = Sealed(batch_id, list(range(last + 1, last + whole + 1)), n_fresh, counts.late, rest, counts.late > 0 or n_fresh < self.size, counts.fetched, counts.n - counts.late - n_fresh - n_old, n_old, last + whole, state.last_hash, state.last_end, part, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        if whole:
            cut = placed.where(F.col("bundle") <= last + whole).repartition("bundle").sortWithinPartitions("bundle", "position")
            cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bundle").parquet(f"{self.path}/sealed")
            if self.files:
                out.last_hash, out.last_end = self._describe(key, last, whole, state)
        if rest:
            placed.where(F.col("bundle") > last + whole).drop("bundle").write.mode("overwrite").parquet(f"{self.path}/tail/batch={key}")
        self._put(f"state/{key}.json", json.dumps(out.__dict__))
        return out

    def _describe(self, key: str, last: int, whole: int, state: Sealed) -> tuple[str, str]:
        """Bundle files, manifest rows and index layer of the bundles that were just sealed; the hash and end time of the last one."""
        new = self.spark.read.schema(f"position int, {ROW}, bundle int").parquet(f"{self.path}/sealed").where(F.col("bundle").between(last + 1, last + whole))
        new = new.withColumn("global_pos", (F.col("bundle") - 1).cast("long") * self.size + F.col("position"))
        bundle_files.write(new, f"{self.path}/bundles", self.origin).write.mode("overwrite").parquet(f"{self.path}/work/files")
        files = self.spark.read.parquet(f"{self.path}/work/files").select(F.col("bundle").alias("b"), "compressed_hash", "compressed_size")
        c = manifests.chained(manifests.content(new), parent=state.last_hash, cursor=state.last_end).join(files, F.col("bundle") == F.col("b"))
        rows = c.select(
            F.col("bundle").alias("bundle_number"), "start_time", "end_time", "operation_count", "did_count", "hash", "content_hash", "parent",
            "compressed_hash", "compressed_size", "uncompressed_size", "cursor", F.col("end_time").alias("created_at"),
        )
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={key}")
        layer = did_index.build(new).repartition("shard").sortWithinPartitions("identifier")
        layer.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/index/batch={key}")
        end = self.spark.read.parquet(f"{self.path}/manifest/batch={key}").where(F.col("bundle_number") == last + whole).first()
        return end["hash"], end["end_time"]

    def stream(self, source: DataFrame, checkpoint: str, server_time: str | None = None, **trigger):
        """Starts the ingest of a streaming DataFrame; trigger is that of writeStream (availableNow=True once, processingTime for a poll)."""
        writer = source.writeStream.foreachBatch(lambda df, k: self.accept(df, k, server_time) and None).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def release(self, server_time: str | None = None) -> Sealed | None:
        """Takes in what is withheld and behind the lag by now, without a new batch; batches of a stream keep their own numbers."""
        state = self.last()
        if not state or not state.withheld:
            return state
        return self.accept(self.spark.createDataFrame([], ROW), state.batch, server_time, state.part + 1)

    # --- resuming

    def tail_problems(self, server_time: str | None = None, hours: float = 1.0) -> list[str]:
        """What speaks against going on with the tail: `overfull`, `before_last_bundle` or `old` (written over `hours` ago)."""
        state = self.last()
        if not state or not state.pending:
            return []
        found = []
        first, n = self.tail(state).agg(F.min("created_at"), F.count(F.lit(1))).first()
        if n > self.size:
            found.append("overfull")
        if state.last_end and first is not None and first < state.last_end:
            found.append("before_last_bundle")
        now = F.lit(server_time).cast("timestamp") if server_time else F.current_timestamp()
        age = self.spark.range(1).select((F.unix_timestamp(now) - F.unix_timestamp(F.lit(state.written_at or "1970-01-01T00:00:00Z").cast("timestamp"))).alias("s")).first()[0]
        if age > hours * 3600:
            found.append("old")
        return found

    def discard_tail(self) -> None:
        """Forgets the unsealed operations (they have to be fetched again); sealed bundles stay."""
        state = self.last()
        if state:
            state.pending = state.withheld = 0
            fs, p = self._fs(f"state/{state.key}.json")
            fs.delete(p, False)
            self._put(f"state/{state.key}.json", json.dumps(state.__dict__))

    # --- reading

    def replay(self, cursor: int = 0) -> DataFrame:
        """global_pos and raw of all operations from a cursor on: sealed ones, then the tail."""
        state = self.last()
        last = state.last_bundle if state else 0
        pos = ((F.col("bundle") - 1).cast("long") * self.size + F.col("position")).alias("global_pos")
        a = self.sealed().where(F.col("bundle") > cursor // self.size).select(pos, "raw")
        b = self.tail(state).select((F.lit(last).cast("long") * self.size + F.col("position")).alias("global_pos"), "raw")
        return a.unionByName(b).where(F.col("global_pos") >= cursor).orderBy("global_pos")

    def follow(self, cursor: int = 0, poll: float = 0.5, until: Callable[[], bool] = lambda: False) -> Iterator[tuple[int, str]]:
        """(global_pos, raw) from a cursor on, and then, polling, of what is taken in later; ends once until() holds and nothing is left."""
        while True:
            last_round, before = until(), cursor
            if self.cursor() > cursor:
                for pos, raw in self.replay(cursor).toLocalIterator():
                    yield pos, raw
                    cursor = pos + 1
            if last_round and cursor == before:
                return
            if cursor == before:
                time.sleep(poll)

    def cursor(self) -> int:
        state = self.last()
        return state.last_bundle * self.size + state.pending if state else 0
