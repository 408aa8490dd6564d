"""Histories, states, documents, audits, forks and canonical chains of all DIDs at once.

Histories of one DID are short; they are folded as arrays, one group a DID.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.scalar import key_type, multibase
from strandlog.operators.log import instant, payload_path
from strandlog.schema import ENVELOPE

WINDOW_HOURS = 72

STATE = "struct<rotationKeys:array<string>,verificationMethods:map<string,string>,alsoKnownAs:array<string>,services:map<string,struct<type:string,endpoint:string>>>"



def by_time():
    """Order of a history: by instant (those that do not parse first), then by the log."""
    return [F.coalesce(instant(), F.timestamp_seconds(F.lit(0))), F.col("global_pos")]


def history(ops: DataFrame, did: str) -> DataFrame:
    return ops.where(F.col("did") == did).orderBy(*by_time())


def latest(ops: DataFrame) -> DataFrame:
    """The latest operation of each DID that is not nullified; of equal times the first in the log."""
    best = F.max_by(F.struct("global_pos", "cid", "created_at", "raw"), F.struct(instant(), (-F.col("global_pos")).alias("k")))
    return ops.where("not nullified").groupBy("did").agg(best.alias("b")).select("did", "b.*")


def latest_pending(pending: DataFrame) -> DataFrame:
    return pending.groupBy("did").agg(F.max_by(F.struct("global_pos", "cid"), "position").alias("b")).select("did", "b.*")


_APPLY = """struct(
  coalesce(filter(x.rotationKeys, k -> k is not null), s.rotationKeys) as rotationKeys,
  if(x.signingKey is null, coalesce(map_filter(x.verificationMethods, (k, v) -> v is not null), s.verificationMethods),
    map_concat(map_filter(coalesce(map_filter(x.verificationMethods, (k, v) -> v is not null), s.verificationMethods), (k, v) -> k <> 'atproto'), map('atproto', x.signingKey))) as verificationMethods,
  if(x.handle is not null and size(coalesce(filter(x.alsoKnownAs, k -> k is not null), s.alsoKnownAs)) = 0, array(concat('at://', x.handle)),
    coalesce(filter(x.alsoKnownAs, k -> k is not null), s.alsoKnownAs)) as alsoKnownAs,
  if(x.service is null, coalesce({services}, s.services),
    map_concat(map_filter(coalesce({services}, s.services), (k, v) -> k <> 'atproto_pds'), map('atproto_pds', named_struct('type', 'AtprotoPersonalDataServer', 'endpoint', {service})))) as services)""".format(
    services="transform_values(map_filter(x.services, (k, v) -> v.type is not null and v.endpoint is not null), (k, v) -> named_struct('type', v.type, 'endpoint', if(v.endpoint rlike '^https?://', v.endpoint, concat('https://', v.endpoint))))",
    service="if(x.service rlike '^https?://', x.service, concat('https://', x.service))",
)


def folded(ops: DataFrame) -> DataFrame:
    """did, deactivated and state of each DID: its operations that are not nullified, applied in order.

    A tombstone among them makes the DID deactivated, whatever follows. Fields that are there
    replace, also when empty; signingKey and service set one member; handle only names a DID
    that has no names.
    """
    at = F.struct(*[c.alias(n) for c, n in zip(by_time(), ("t", "k"), strict=True)])
    # lines are parsed where they are read, and the operations are shuffled, not the lines
    t = ops.where("not nullified").select("did", at.alias("at"), F.from_json("raw", ENVELOPE)["operation"].alias("x"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "x")), lambda p, q: F.when(p["at"] < q["at"], -1).when(p["at"] > q["at"], 1).otherwise(0))
    g = t.groupBy("did").agg(F.transform(in_order, lambda o: o["x"]).alias("ops"), F.bool_or(F.coalesce(F.col("x.type") == "plc_tombstone", F.lit(False))).alias("deactivated"))
    zero = f"cast(named_struct('rotationKeys', array(), 'verificationMethods', map(), 'alsoKnownAs', array(), 'services', map()) as {STATE})"
    apply_ = f"cast({_APPLY} as {STATE})"
    return g.select("did", "deactivated", F.expr(f"aggregate(ops, {zero}, (s, x) -> {apply_})").alias("state"))


def flat_state(states: DataFrame) -> DataFrame:
    """A state in comparable columns."""
    entries = lambda c, f: F.array_join(F.array_sort(F.transform(F.map_entries(c), f)), ",")
    return states.select(
        "did", "deactivated", F.array_join("state.rotationKeys", ",").alias("rotation_keys"), F.array_join("state.alsoKnownAs", ",").alias("also_known_as"),
        entries("state.verificationMethods", lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("verification_methods"),
        entries("state.services", lambda e: F.concat(e["key"], F.lit("="), e["value"]["endpoint"])).alias("services"),
    )


def documents(states: DataFrame) -> DataFrame:
    """The W3C document of each DID that is not deactivated: id, context, alsoKnownAs, verificationMethod, service."""
    kinds = F.transform(F.map_values("state.verificationMethods"), key_type)
    context = F.concat(
        F.array(F.lit("https://www.w3.org/ns/did/v1"), F.lit("https://w3id.org/security/multikey/v1")),
        F.when(F.array_contains(kinds, "secp256k1"), F.array(F.lit("https://w3id.org/security/suites/secp256k1-2019/v1"))).otherwise(F.array().cast("array<string>")),
        F.when(F.array_contains(kinds, "p256"), F.array(F.lit("https://w3id.org/security/suites/ecdsa-2019/v1"))).otherwise(F.array().cast("array<string>")),
    )
    methods = F.transform(
        F.map_entries("state.verificationMethods"),
        lambda e: F.struct(F.concat("did", F.lit("#"), e["key"]).alias("id"), F.lit("Multikey").alias("type"), F.col("did").alias("controller"), multibase(e["value"]).alias("publicKeyMultibase")),
    )
    services = F.transform(F.map_entries("state.services"), lambda e: F.struct(F.concat(F.lit("#"), e["key"]).alias("id"), e["value"]["type"].alias("type"), e["value"]["endpoint"].alias("serviceEndpoint")))
    return states.where("not deactivated").select(F.col("did").alias("id"), context.alias("context"), F.col("state.alsoKnownAs").alias("alsoKnownAs"), F.array_sort(methods).alias("verificationMethod"), F.array_sort(services).alias("service"))


def flat_document(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("id").alias("did"), F.array_join("context", " ").alias("context"), F.array_join("alsoKnownAs", ",").alias("also_known_as"),
        F.array_join(F.transform("verificationMethod", lambda m: F.concat(m["id"], F.lit("="), m["publicKeyMultibase"])), ",").alias("methods"),
        F.array_join(F.transform("service", lambda s: F.concat(s["id"], F.lit("="), s["serviceEndpoint"])), ",").alias("services"),
    )


def audit_log(ops: DataFrame) -> DataFrame:
    """global_pos and the JSON entry of each operation; nullified is there only when true."""
    entry = F.to_json(F.struct("did", "cid", F.when(F.col("nullified"), True).alias("nullified"), F.col("created_at").alias("createdAt")))
    return ops.select("global_pos", entry.alias("entry"))


def linear(ops: DataFrame) -> DataFrame:
    """operations, broken links and whether each DID's history is one chain: each prev is the cid before."""
    w = Window.partitionBy("did").orderBy(*by_time())
    t = ops.withColumn("before", F.lag("cid").over(w))
    broken = ~F.col("prev").eqNullSafe(F.col("before"))
    return t.groupBy("did").agg(F.count(F.lit(1)).alias("operations"), F.count_if(broken).alias("broken")).withColumn("linear", F.col("broken") == 0)


def keys_in_force(ops: DataFrame) -> DataFrame:
    """global_pos and the rotation keys in force before each operation (null before the first ones)."""
    w = Window.partitionBy("did").orderBy(*by_time()).rowsBetween(Window.unboundedPreceding, -1)
    keys = F.get_json_object("raw", "$.operation.rotationKeys")
    return ops.select("global_pos", F.last(F.array_join(F.from_json(keys, "array<string>"), ","), True).over(w).alias("keys"))


def fork_points(ops: DataFrame) -> DataFrame:
    """did, prev and number of the operations that share a prev."""
    return ops.where("prev is not null").groupBy("did", "prev").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fork_winners(ops: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    """did, prev and the winner's cid of each fork: in time order, an operation of a lower key index beats the winner so far within `hours` of it."""
    t = ops.where("prev is not null").groupBy("did", "prev").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(*[c.alias(k) for c, k in zip(by_time(), ("t", "g"), strict=True)], F.col("signing_key_index").alias("i"), "cid"))).alias("f")
    )
    fold = f"""aggregate(slice(f, 2, size(f)), f[0], (w, x) -> if(x.i < w.i and x.t <= w.t + interval {hours} hours, x, w))"""
    return t.where("n > 1").select("did", "prev", F.expr(fold)["cid"].alias("winner"), "n")


def canonical(ops: DataFrame) -> DataFrame:
    """(did, step, cid) of each DID's canonical chain: from its first operation on to the first child that is not nullified, else the first child.

    The child of an operation is picked by (did, prev); the walk goes over a DID's own map of
    children, not over a join a step. It takes as many steps as there are children; where
    children lead in a circle, what comes again is left out.
    """
    order = F.struct(F.col("nullified").alias("n"), *[c.alias(k) for c, k in zip(by_time(), ("t", "g"), strict=True)])
    child = ops.where("prev is not null").groupBy("did", "prev").agg(F.min_by("cid", order).alias("next"))
    first = ops.groupBy("did").agg(F.min_by("cid", F.struct(*[c.alias(k) for c, k in zip(by_time(), ("t", "g"), strict=True)])).alias("cid"))
    kids = child.groupBy("did").agg(F.map_from_entries(F.collect_list(F.struct("prev", "next"))).alias("next"))
    t = first.join(kids, "did", "left")
    walk = """array_distinct(aggregate(sequence(1, coalesce(size(next), 0) + 1), array(cid),
      (a, k) -> concat(a, filter(array(try_element_at(next, element_at(a, -1))), x -> x is not null))))"""
    out = t.select("did", F.posexplode(F.expr(walk)).alias("step", "cid"))
    return out.select("did", F.col("step").cast("long").alias("step"), "cid")


def audit_forks(ops: DataFrame) -> DataFrame:
    """did, operations, forks, canonical length, and operations outside of the canonical chain that are not nullified."""
    n = ops.groupBy("did").agg(F.count(F.lit(1)).alias("operations"))
    f = fork_points(ops).groupBy("did").agg(F.count(F.lit(1)).alias("forks"))
    chain = canonical(ops)
    c = chain.groupBy("did").agg(F.count(F.lit(1)).alias("canonical"))
    out = ops.where("not nullified").join(chain.select("did", "cid"), ["did", "cid"], "left_anti").groupBy("did").agg(F.count(F.lit(1)).alias("stray"))
    j = n.join(f, "did", "left").join(c, "did", "left").join(out, "did", "left")
    return j.select("did", "operations", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("forks", "canonical", "stray")])


def handle_lookup(states: DataFrame) -> DataFrame:
    """(handle, did) of the names in the DIDs' states."""
    name = F.explode("state.alsoKnownAs").alias("name")
    return states.where("not deactivated").select(name, "did").where("startswith(name, 'at://')").select(F.expr("substr(name, 6)").alias("handle"), "did")
