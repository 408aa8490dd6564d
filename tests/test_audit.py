"""Signatures, forks, their views, and differences of documents."""

import base64
import hashlib
import json

import pytest

from strandlog.operators import audit

SECP, P256 = audit.CURVES


def did_key(prefix, secret):
    c = audit.CURVES[prefix]
    x, y = audit.times(c, secret, c["g"])
    n, text = int.from_bytes(prefix + bytes([2 + y % 2]) + x.to_bytes(32, "big"), "big"), ""
    while n:
        n, k = divmod(n, 58)
        text = audit.ALPHABET[k] + text
    return "did:key:z" + text


def signed(operation, prefix, secret, nonce=12345):
    c = audit.CURVES[prefix]
    e = int.from_bytes(hashlib.sha256(audit.cbor(operation)).digest(), "big")
    r = audit.times(c, nonce, c["g"])[0] % c["n"]
    s = pow(nonce, -1, c["n"]) * (e + r * secret) % c["n"]
    s = min(s, c["n"] - s)
    return operation | {"sig": base64.urlsafe_b64encode(r.to_bytes(32, "big") + s.to_bytes(32, "big")).decode().rstrip("=")}


def test_curves_and_keys():
    for prefix, c in audit.CURVES.items():
        x, y = c["g"]
        assert (y * y - x**3 - c["a"] * x - c["b"]) % c["p"] == 0 and audit.times(c, c["n"], c["g"]) is None
        assert audit.public_key(did_key(prefix, 77)) == (prefix, audit.times(c, 77, c["g"]))
    # a published secp256k1 key: its form starts with zQ3s, that of P-256 with zDna
    assert did_key(SECP, 5).startswith("did:key:zQ3s") and did_key(P256, 5).startswith("did:key:zDna")
    assert audit.public_key("did:key:zQ3r0") is None and audit.public_key("plain") is None


def test_cbor():
    assert audit.cbor({"bb": [1, -1, None, True], "a": "é", "c": 300}).hex() == "a3616162c3a961631901" + "2c" + "626262840120f6f5"
    assert audit.cbor(23).hex() == "17" and audit.cbor(24).hex() == "1818" and audit.cbor("x" * 24).hex()[:4] == "7818"
    with pytest.raises(ValueError):
        audit.cbor(1.5)


@pytest.mark.parametrize("prefix", audit.CURVES)
def test_signatures(prefix):
    op = signed({"type": "plc_operation", "prev": None, "services": {"a": {"type": "t", "endpoint": "e"}}}, prefix, 99)
    assert audit.verified(op, did_key(prefix, 99)) and not audit.verified(op, did_key(prefix, 98))
    assert not audit.verified(op | {"prev": "x"}, did_key(prefix, 99)) and not audit.verified(op | {"sig": "AAAA"}, did_key(prefix, 99)) and not audit.verified({"a": 1}, did_key(prefix, 99))
    c, raw = audit.CURVES[prefix], base64.urlsafe_b64decode(op["sig"] + "==")
    high = c["n"] - int.from_bytes(raw[32:], "big")
    assert not audit.verified(op | {"sig": base64.urlsafe_b64encode(raw[:32] + high.to_bytes(32, "big")).decode()}, did_key(prefix, 99))


def test_audit_and_forks(spark):
    keys = [did_key(SECP, 11), did_key(P256, 12)]
    rows = []

    def add(did, cid, prev, hour, secret, prefix, nullified=False, rotation=keys):
        op = signed({"type": "plc_operation", "prev": prev, "rotationKeys": rotation}, prefix, secret)
        t = f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:00:00Z"
        rows.append((len(rows), did, cid, prev, nullified, t, json.dumps({"did": did, "operation": op, "cid": cid, "createdAt": t})))

    add("d1", "a", None, 0, 11, SECP)
    add("d1", "b", "a", 1, 12, P256)
    add("d1", "c", "b", 2, 11, SECP)
    add("d2", "a", None, 0, 12, P256)
    add("d2", "b", "a", 1, 13, SECP)  # by a stranger
    add("d3", "a", None, 0, 11, SECP)
    add("d3", "b", "a", 1, 12, P256, True)
    add("d3", "c", "a", 5, 11, SECP)  # outranks b in time
    add("d4", "a", None, 0, 11, SECP)
    add("d4", "b", "a", 1, 12, P256)
    add("d4", "c", "a", 100, 11, SECP, True)  # too late
    ops = spark.createDataFrame(rows, "global_pos long, did string, cid string, prev string, nullified boolean, created_at string, raw string")
    got = {(r.did, r.cid): r.signer for r in audit.signers(ops).collect()}
    assert got == {("d1", "a"): 0, ("d1", "b"): 1, ("d1", "c"): 0, ("d2", "a"): 1, ("d2", "b"): None, ("d3", "a"): 0, ("d3", "b"): 1, ("d3", "c"): 0, ("d4", "a"): 0, ("d4", "b"): 1, ("d4", "c"): 0}
    assert {r.did: (r.operations, r.broken, r.unsigned, r.valid) for r in audit.audited(ops).collect()} == {"d1": (3, 0, 0, True), "d2": (2, 0, 1, False), "d3": (3, 1, 0, False), "d4": (3, 1, 0, False)}
    f = [(r.did, r.cid, r.won, r.reason) for r in audit.forks(ops).collect()]
    assert f == [("d3", "b", False, "key 1 is outranked by key 0"), ("d3", "c", True, None), ("d4", "b", True, None), ("d4", "c", False, "key 0 outranks key 1, but came 99.0 hours later, over 72")]
    views = {r.did: r.text.split("\n") for r in audit.tree(ops).collect()}
    assert views["d1"] == ["- a 2024-01-01T00:00:00Z", "  - b 2024-01-01T01:00:00Z", "    - c 2024-01-01T02:00:00Z"]
    assert views["d3"][1:] == ["  x b 2024-01-01T01:00:00Z (lost: key 1 is outranked by key 0)", "  - c 2024-01-01T05:00:00Z (won)"]
    flat = {r.did: r.text.split("\n") for r in audit.linear_view(ops).collect()}
    assert flat["d3"] == ["1. a 2024-01-01T00:00:00Z first", "2. b 2024-01-01T01:00:00Z follows, nullified", "3. c 2024-01-01T05:00:00Z branches from a"]


def test_document_diff(spark):
    a = spark.createDataFrame([("d1", '{"x":[1,2],"y":{"z":1,"q":true}}'), ("d2", '{"b":1,"a":2}'), ("d3", "{}")], "did string, document string")
    b = spark.createDataFrame([("d1", '{"x":[1],"y":{"z":2,"q":1},"w":0}'), ("d2", '{"a":2,"b":1}'), ("d4", "{}")], "did string, document string")
    got = {(r.did, r.path, r.kind) for r in audit.document_diff(a, b).collect()}
    assert got == {("d1", "x[1]", "local only"), ("d1", "y.z", "changed"), ("d1", "y.q", "changed"), ("d1", "w", "remote only"), ("d3", "", "local only"), ("d4", "", "remote only")}
