"""Signatures of operations: which key signed, which fork wins and why the others do not, and views of it as text.

A signature is ECDSA over SHA-256 of the operation's DAG-CBOR form without it, by a key of one
of two curves that is written as did:key. Keys, curves and the encoding are public formats.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandlog.functions.scalar import fixed
from strandlog.operators.entity import by_time

ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

# Fixed values of the two curves y^2 = x^3 + a x + b over p, with base point g of order n, and of their multicodec prefixes.
CURVES = {
    b"\xe7\x01": {  # secp256k1
        "p": 2**256 - 2**32 - 977, "a": 0, "b": 7, "n": 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141,
        "g": (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8),
    },
    b"\x80\x24": {  # P-256
        "p": 2**256 - 2**224 + 2**192 + 2**96 - 1, "a": -3, "b": 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B, "n": 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551,
        "g": (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5),
    },
}


def add(c: dict, u, v):
    """Sum of two points; None is the point at infinity."""
    if u is None or v is None:
        return u or v
    p = c["p"]
    if u[0] == v[0]:
        if (u[1] + v[1]) % p == 0:
            return None
        s = (3 * u[0] * u[0] + c["a"]) * pow(2 * u[1], -1, p)
    else:
        s = (v[1] - u[1]) * pow(v[0] - u[0], -1, p)
    x = (s * s - u[0] - v[0]) % p
    return x, (s * (u[0] - x) - u[1]) % p


def times(c: dict, k: int, u):
    out = None
    while k:
        if k & 1:
            out = add(c, out, u)
        u, k = add(c, u, u), k >> 1
    return out


@lru_cache(maxsize=4096)
def public_key(did_key: str) -> tuple[bytes, tuple[int, int]] | None:
    """(multicodec prefix, point) of a did:key; None if it is none of the two kinds."""
    text = did_key.removeprefix("did:key:")
    if not text.startswith("z") or any(x not in ALPHABET for x in text[1:]):
        return None
    n = 0
    for x in text[1:]:
        n = n * 58 + ALPHABET.index(x)
    raw = n.to_bytes(-(-n.bit_length() // 8), "big")
    c = CURVES.get(raw[:2])
    if c is None or len(raw) != 35 or raw[2] not in (2, 3):
        return None
    x = int.from_bytes(raw[3:], "big")
    square = (x * x * x + c["a"] * x + c["b"]) % c["p"]
    y = pow(square, (c["p"] + 1) // 4, c["p"])
    if x >= c["p"] or y * y % c["p"] != square:
        return None
    return raw[:2], (x, y if y % 2 == raw[2] % 2 else c["p"] - y)


def cbor(v) -> bytes:
    """DAG-CBOR: lengths in their shortest form, map keys by length and then bytes."""

    def head(kind: int, n: int) -> bytes:
        for k, (bound, size) in enumerate(((24, 0), (1 << 8, 1), (1 << 16, 2), (1 << 32, 4), (1 << 64, 8))):
            if n < bound:
                return bytes([kind << 5 | (n if not k else 23 + k)]) + (n.to_bytes(size, "big") if k else b"")
        raise ValueError("too large a number")

    if v is None or isinstance(v, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[v]
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    if isinstance(v, str):
        raw = v.encode()
        return head(3, len(raw)) + raw
    if isinstance(v, list):
        return head(4, len(v)) + b"".join(map(cbor, v))
    if isinstance(v, dict):
        keys = sorted(v, key=lambda k: (len(k.encode()), k.encode()))
        return head(5, len(v)) + b"".join(cbor(k) + cbor(v[k]) for k in keys)
    raise ValueError(f"no form for {type(v).__name__}")


def verified(operation: dict, did_key: str) -> bool:
    """Whether an operation's signature (64 bytes, base64url, the lower of the two equal forms) is that of a key."""
    key, sig = public_key(did_key), operation.get("sig")
    if key is None or not isinstance(sig, str):
        return False
    try:
        raw = base64.urlsafe_b64decode(sig + "=" * (-len(sig) % 4))
        body = cbor({k: v for k, v in operation.items() if k != "sig"})
    except ValueError:
        return False
    c = CURVES[key[0]]
    n = c["n"]
    r, s = int.from_bytes(raw[:32], "big"), int.from_bytes(raw[32:], "big")
    if len(raw) != 64 or not 0 < r < n or not 0 < s <= n // 2:
        return False
    e, w = int.from_bytes(hashlib.sha256(body).digest(), "big"), pow(s, -1, n)
    point = add(c, times(c, e * w % n, c["g"]), times(c, r * w % n, key[1]))
    return point is not None and point[0] % n == r


def signer_of(raw: str, keys: list[str] | None) -> int | None:
    """Number of the first of the keys that signed a line's operation; None if none did."""
    try:
        operation = json.loads(raw).get("operation")
    except (ValueError, AttributeError):
        return None
    if not isinstance(operation, dict):
        return None
    return next((k for k, key in enumerate(keys or []) if isinstance(key, str) and verified(operation, key)), None)


def own_keys() -> str:
    """The keys that an operation states: rotationKeys, or recoveryKey and signingKey of the older form."""
    listed = "from_json(get_json_object(raw, '$.operation.rotationKeys'), 'array<string>')"
    old = "filter(array(get_json_object(raw, '$.operation.recoveryKey'), get_json_object(raw, '$.operation.signingKey')), k -> k is not null)"
    return f"coalesce({listed}, if(size({old}) > 0, {old}, null))"


def signers(ops: DataFrame) -> DataFrame:
    """did, global_pos, prev, cid, nullified, created_at and signer: the number of the key that signed, of those that its prev stated (of a first operation: its own); null if none did.

    prev's keys come by a join on (did, cid), so branches of a fork are each held against the keys they start from.
    """
    stated = ops.where("cid is not null").groupBy(F.col("did").alias("d"), F.col("cid").alias("c")).agg(F.min_by(F.expr(own_keys()), "global_pos").alias("keys"))
    j = ops.join(stated, (F.col("did") == F.col("d")) & (F.col("prev") == F.col("c")), "left")
    keys = F.when(F.col("prev").isNull(), F.expr(own_keys())).otherwise(F.col("keys"))

    def run(raw: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array([None if x is None else signer_of(x, k) for x, k in zip(raw.to_pylist(), keys.to_pylist(), strict=True)], pa.int32())

    return j.select("did", "global_pos", "prev", "cid", "nullified", "created_at", arrow_udf(run, "int")("raw", keys).alias("signer"))


def audited(ops: DataFrame) -> DataFrame:
    """did, operations, broken (links that are not to the operation before), unsigned (operations that no key in force signed) and valid."""
    w = Window.partitionBy("did").orderBy(*by_time())
    t = signers(ops).withColumn("before", F.lag("cid").over(w))
    t = t.groupBy("did").agg(F.count(F.lit(1)).alias("operations"), F.count_if(~F.col("prev").eqNullSafe(F.col("before"))).alias("broken"), F.count_if(F.col("signer").isNull()).alias("unsigned"))
    return t.withColumn("valid", (F.col("broken") == 0) & (F.col("unsigned") == 0))


def forks(ops: DataFrame, hours: int = 72) -> DataFrame:
    """did, prev, cid, created_at, signer, won and reason of each operation that shares its prev with another, by the fork's earliest time.

    In time order, an operation of a lower key number takes over from the winner so far within
    `hours` of it. ops has signing_key_index, or its signers are found (see signers).
    """
    t = ops.withColumnRenamed("signing_key_index", "signer") if "signing_key_index" in ops.columns else signers(ops)
    at = F.struct(*[c.alias(k) for c, k in zip(by_time(), ("t", "g"), strict=True)])
    t = t.where("prev is not null").select("did", "prev", "cid", "created_at", "signer", at.alias("at"))
    branch = F.struct("at", "cid", "created_at", "signer")
    g = t.groupBy("did", "prev").agg(F.sort_array(F.collect_list(branch)).alias("f"))
    fold = f"aggregate(slice(f, 2, size(f)), f[0], (w, x) -> if(x.signer < w.signer and x.at.t <= w.at.t + interval {hours} hours, x, w))"
    g = g.where("size(f) > 1").withColumn("w", F.expr(fold)).withColumn("since", F.expr("f[0].at.t"))
    x = g.select("did", "prev", "since", "w", F.explode("f").alias("x"))
    gap = (F.unix_timestamp("x.at.t") - F.unix_timestamp("w.at.t")) / 3600.0
    reason = (
        F.when(F.col("x.cid").eqNullSafe(F.col("w.cid")), F.lit(None).cast("string")).when(F.col("x.signer").isNull(), F.lit("no key in force signed it"))
        .when((F.col("x.signer") < F.col("w.signer")) & (gap > hours), F.format_string(f"key %d outranks key %d, but came %s hours later, over {hours}", "x.signer", "w.signer", fixed(gap, 1)))
        .when(F.col("x.signer") > F.col("w.signer"), F.format_string("key %d is outranked by key %d", "x.signer", "w.signer")).otherwise(F.lit("another came first"))
    )
    out = x.select("did", "prev", "x.cid", "x.created_at", "x.signer", F.col("x.cid").eqNullSafe(F.col("w.cid")).alias("won"), reason.alias("reason"), "since")
    return out.orderBy("since", "did", "prev", "created_at").drop("since")


def tree(ops: DataFrame) -> DataFrame:
    """did and text: each operation on a line, indented by its distance from the first along prev, with the fork's verdict."""
    lines = forks(ops).select(F.col("did").alias("d"), F.col("cid").alias("c"), F.when(F.col("won"), " (won)").otherwise(F.concat(F.lit(" (lost: "), "reason", F.lit(")"))).alias("verdict"))
    mark = F.when(F.col("nullified"), "x ").otherwise("- ")
    own = ops.join(lines, (F.col("did") == F.col("d")) & (F.col("cid") == F.col("c")), "left").select(
        "did", F.struct(*[c.alias(k) for c, k in zip(by_time(), ("t", "g"), strict=True)], "cid", "prev", F.concat(mark, "cid", F.lit(" "), "created_at", F.coalesce("verdict", F.lit(""))).alias("line")).alias("o")
    )
    listed = own.groupBy("did").agg(F.sort_array(F.collect_list("o")).alias("o"))
    depth = """aggregate(o, map_from_arrays(array(cast('' as string)), array(0)), (m, x) ->
      map_concat(map_filter(m, (k, v) -> k <> coalesce(x.cid, '')), map(coalesce(x.cid, ''), coalesce(try_element_at(m, x.prev) + 1, 0))))"""
    text = "array_join(transform(o, x -> concat(repeat('  ', coalesce(try_element_at(depths, coalesce(x.cid, '')), 0)), x.line)), '\\n')"
    return listed.withColumn("depths", F.expr(depth)).select("did", F.expr(text).alias("text"))


def linear_view(ops: DataFrame) -> DataFrame:
    """did and text: the history in order, one numbered line an operation, with what its link is to."""
    w = Window.partitionBy("did").orderBy(*by_time())
    t = ops.withColumn("k", F.row_number().over(w)).withColumn("before", F.lag("cid").over(w))
    link = F.when(F.col("prev").isNull(), "first").when(F.col("prev").eqNullSafe(F.col("before")), "follows").otherwise(F.concat(F.lit("branches from "), "prev"))
    line = F.concat(F.col("k").cast("string"), F.lit(". "), "cid", F.lit(" "), "created_at", F.lit(" "), link, F.when(F.col("nullified"), ", nullified").otherwise(""))
    return t.select("did", "k", line.alias("line")).groupBy("did").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def differences(local, remote, path: str = "") -> list[tuple[str, str]]:
    """(path, kind) of what differs between two JSON values: only local, only remote, or changed. Members of objects are compared by name, elements by place."""
    if isinstance(local, dict) and isinstance(remote, dict):
        out = []
        for k in sorted(local.keys() | remote.keys()):
            at = f"{path}.{k}" if path else k
            out += [(at, "remote only")] if k not in local else [(at, "local only")] if k not in remote else differences(local[k], remote[k], at)
        return out
    if isinstance(local, list) and isinstance(remote, list):
        out = []
        for i in range(max(len(local), len(remote))):
            at = f"{path}[{i}]"
            out += [(at, "remote only")] if i >= len(local) else [(at, "local only")] if i >= len(remote) else differences(local[i], remote[i], at)
        return out
    return [] if local == remote and isinstance(local, bool) == isinstance(remote, bool) else [(path, "changed")]


def document_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """did, path and kind of what differs between two tables of documents (did, document: JSON text); a document that one lacks is one row."""
    j = local.select(F.col("did").alias("l"), F.col("document").alias("a")).join(remote.select(F.col("did").alias("r"), F.col("document").alias("b")), F.col("l") == F.col("r"), "full_outer")

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if x is None or y is None:
                out.append([("", "remote only" if x is None else "local only")])
            else:
                out.append(differences(json.loads(x), json.loads(y)))
        return pa.array([[{"path": p, "kind": k} for p, k in d] for d in out], pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string())])))

    return j.select(F.coalesce("l", "r").alias("did"), F.inline(arrow_udf(run, "array<struct<path:string,kind:string>>")("a", "b")))
