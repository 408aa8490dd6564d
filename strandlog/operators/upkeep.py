"""A stored inverted index and its upkeep: layers for new operations, and rewriting of the shards that they touch.

The folder holds

    base/v=K/shard=S    entries of shard S, written by version K; index.json says which version of a shard counts
    layers/N/shard=S    entries of later operations
    index.json          versions, layers, counts and hashes of the shards, and the last bundle; replaced as a whole

so what an update or a compaction writes is what it touches, and a failed one leaves files that no state names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import index
from strandlog.sources.store import Store

ENTRIES = "identifier string, locations array<struct<global_pos:long,nullified:boolean>>, shard int"
#: Layers from which an update, or a repair, compacts; bundles from which an update rebuilds; bundles behind up to which a repair updates.
MOST_LAYERS, MOST_BUNDLES, BEHIND = 50, 10, 1000
#: Locations of one identifier, on average in a shard, that a light check reports.
CROWDED = 1280


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def state(self) -> dict:
        if not self.store.exists("index.json"):
            return {"version": 0, "shards": {}, "layers": [], "next": 0, "last_bundle": 0}
        return json.loads(self.store.read("index.json"))

    def _save(self, state: dict) -> None:
        self.store.put("index.json", json.dumps(state).encode())

    def _tables(self, state: dict, shards: list[int] | None = None) -> list[DataFrame]:
        out, by = [], {}
        for s, x in state["shards"].items():
            if shards is None or int(s) in shards:
                by.setdefault(x["version"], []).append(int(s))
        for version, own in by.items():
            base = f"{self.store.folder}/base/v={version}"
            out.append(self.spark.read.schema(ENTRIES).option("basePath", base).parquet(*[f"{base}/shard={s}" for s in sorted(own)]))
        for x in state["layers"]:
            layer = self.spark.read.schema(ENTRIES).parquet(f"{self.store.folder}/layers/{x['id']}")
            out.append(layer if shards is None else layer.where(F.col("shard").isin(shards)))
        return [t.select("shard", "identifier", "locations") for t in out]

    def entries(self, shards: list[int] | None = None) -> DataFrame:
        """shard, identifier and locations, layers merged; of some shards, only their files are read."""
        tables = self._tables(self.state(), shards)
        if not tables:
            return self.spark.createDataFrame([], ENTRIES).select("shard", "identifier", "locations")
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return index.merged(out) if len(tables) > 1 else out

    def lookup(self, dids: DataFrame) -> DataFrame:
        return index.lookup(self.entries(), dids)

    def _write(self, entries: DataFrame, path: str) -> None:
        entries.repartition("shard").sortWithinPartitions("identifier").write.mode("overwrite").partitionBy("shard").option("parquet.bloom.filter.enabled#identifier", "true").parquet(path)

    def _base(self, entries: DataFrame, state: dict) -> dict[str, dict]:
        """Writes entries as the next version; what index.json has to say of its shards (256 short rows)."""
        version = state["version"] = state["version"] + 1
        path = f"{self.store.folder}/base/v={version}"
        self._write(entries, path)
        rows = hashes(self.spark.read.schema(ENTRIES).parquet(path)).collect()
        return {str(r["shard"]): {"version": version, "dids": r["dids"], "locations": r["locations"], "hash": r["hash"]} for r in rows}

    def build(self, ops: DataFrame) -> None:
        """The index of ops (bundle, did, global_pos, nullified), from scratch."""
        state = self.state()
        state["shards"] = self._base(index.build(ops), state)
        state["layers"], state["last_bundle"] = [], ops.agg(F.max("bundle")).first()[0] or 0
        self._save(state)

    def update(self, ops: DataFrame) -> None:
        """A layer of further operations; shards that they do not touch are neither read nor written."""
        state = self.state()
        number = state["next"]
        state["next"] = number + 1
        self._write(index.build(ops), f"{self.store.folder}/layers/{number}")
        layer = self.spark.read.schema(ENTRIES).parquet(f"{self.store.folder}/layers/{number}")
        state["layers"].append({"id": number, "shards": sorted(r[0] for r in layer.select("shard").distinct().collect())})
        state["last_bundle"] = max(state["last_bundle"], ops.agg(F.max("bundle")).first()[0] or 0)
        self._save(state)
        if len(state["layers"]) > MOST_LAYERS:
            self.compact()

    def batch_update(self, log: DataFrame, first: int, last: int) -> str:
        """Takes in bundles first to last of a log: as a layer, or, over MOST_BUNDLES of them, by building anew. Says which."""
        if last - first + 1 > MOST_BUNDLES:
            self.build(log.where(F.col("bundle") <= last))
            return "rebuild"
        self.update(log.where(F.col("bundle").between(first, last)))
        return "update"

    def compact(self, shards: list[int] | None = None) -> list[int]:
        """Merges the layers of some shards (default: all that have any) into new versions of these shards alone; returns them."""
        state = self.state()
        touched = sorted({s for x in state["layers"] for s in x["shards"] if shards is None or s in shards})
        if not touched:
            return []
        state["shards"].update(self._base(self.entries(touched), state))
        # a layer goes when no other shard is in it; else what was merged is merged once more, which changes nothing
        kept = []
        for x in state["layers"]:
            x["shards"] = [s for s in x["shards"] if s not in touched]
            if x["shards"]:
                kept.append(x)
        state["layers"] = kept
        self._save(state)
        return touched

    def integrity(self) -> DataFrame:
        """shard, valid: the stored hashes against those of the shards' entries as they are."""
        state = self.state()
        said = self.spark.createDataFrame([(int(s), x["hash"]) for s, x in state["shards"].items()], "s int, said string")
        base = self._tables(state | {"layers": []})
        now = base[0] if base else self.spark.createDataFrame([], ENTRIES)
        for t in base[1:]:
            now = now.unionByName(t)
        return said.join(hashes(now), F.col("s") == F.col("shard"), "left").select(F.col("s").alias("shard"), F.coalesce(F.col("hash") == F.col("said"), F.lit(False)).alias("valid"))

    def verify(self, log: DataFrame | None = None) -> list[str]:
        """What is wrong: of the state and the files alone or, with a log, against an index built anew."""
        state, found = self.state(), []
        for s, x in state["shards"].items():
            if not self.store.sizes("*.parquet", f"base/v={x['version']}/shard={s}"):
                found.append(f"shard {s}: no files")
            elif x["locations"] > CROWDED * x["dids"]:
                found.append(f"shard {s}: crowded")
        found += [f"layer {x['id']}: no files" for x in state["layers"] if not self.store.exists(f"layers/{x['id']}")]
        if len(state["layers"]) > MOST_LAYERS:
            found.append(f"{len(state['layers'])} layers")
        if log is not None and not found:
            for r in index.differences(self.entries(), log).groupBy("kind").count().orderBy("kind").collect():
                found.append(f"{r[1]} {r[0]}")
        return found

    def repair(self, log: DataFrame) -> str:
        """Mends what verify() finds and takes in bundles that are not indexed; says how: none, compact, update or rebuild."""
        state = self.state()
        last = log.agg(F.max("bundle")).first()[0] or 0
        broken = any("no files" in x for x in self.verify()) or not self.integrity().where("not valid").isEmpty()
        if broken or not state["shards"] and last or last - state["last_bundle"] > BEHIND or last < state["last_bundle"]:
            self.build(log)
            return "rebuild"
        done = "none"
        if last > state["last_bundle"]:
            self.update(log.where(F.col("bundle") > state["last_bundle"]))
            done = "update"
        if len(self.state()["layers"]) > MOST_LAYERS:
            self.compact()
            done = "compact"
        return done


def hashes(entries: DataFrame) -> DataFrame:
    """shard, dids, locations and hash of each shard: the hash is of its entries' hashes, in the order of identifiers, so it fits in memory."""
    own = F.sha2(F.concat(F.col("identifier"), F.lit(":"), F.to_json("locations")), 256)
    rows = entries.select("shard", "identifier", F.size("locations").alias("n"), own.alias("h"))
    # two steps: by leading characters first, so that no group is a whole shard of a large index
    part = rows.groupBy("shard", F.substring("identifier", 1, 3).alias("lead")).agg(F.count(F.lit(1)).alias("dids"), F.sum("n").alias("locations"), F.expr("sha2(listagg(h, '') within group (order by identifier), 256)").alias("h"))
    return part.groupBy("shard").agg(F.sum("dids").alias("dids"), F.sum("locations").alias("locations"), F.expr("sha2(listagg(h, '') within group (order by lead), 256)").alias("hash"))
