"""Evaluation of parsed JMESPath expressions on Python values."""

from __future__ import annotations

import json
import math

from strandlog.jmes.parse import JmesError


_KINDS = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def kind(v) -> str:
    return _KINDS.get(type(v), "expref")


def truthy(v) -> bool:
    return not (v is None or v is False or (isinstance(v, (str, list, dict)) and not v))


def same(a, b) -> bool:
    if kind(a) != kind(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def evaluate(node, v):
    op = node[0]
    if op == "field":
        return v.get(node[1]) if isinstance(v, dict) else None
    if op == "current":
        return v
    if op == "literal":
        return node[1]
    if op == "index":
        return v[node[1]] if isinstance(v, list) and -len(v) <= node[1] < len(v) else None
    if op == "slice":
        return v[slice(*node[1:])] if isinstance(v, list) else None
    if op in ("sub", "pipe"):
        left = evaluate(node[1], v)
        return None if left is None and op == "sub" else evaluate(node[2], left)
    if op in ("project", "values", "flatten", "filter"):
        left = evaluate(node[1], v)
        if op == "values":
            left = [left[k] for k in sorted(left)] if isinstance(left, dict) else None
        if not isinstance(left, list):
            return None
        if op == "flatten":
            left = [y for x in left for y in (x if isinstance(x, list) else [x])]
        if op == "filter":
            left = [x for x in left if truthy(evaluate(node[2], x))]
        out = (evaluate(node[-1], x) for x in left)
        return [x for x in out if x is not None]
    if op == "list":
        return None if v is None else [evaluate(x, v) for x in node[1]]
    if op == "hash":
        return None if v is None else {k: evaluate(x, v) for k, x in node[1].items()}
    if op == "or":
        left = evaluate(node[1], v)
        return left if truthy(left) else evaluate(node[2], v)
    if op == "and":
        left = evaluate(node[1], v)
        return evaluate(node[2], v) if truthy(left) else left
    if op == "not":
        return not truthy(evaluate(node[1], v))
    if op == "compare":
        a, b = evaluate(node[2], v), evaluate(node[3], v)
        if node[1] in ("==", "!="):
            return same(a, b) is (node[1] == "==")
        if kind(a) != "number" or kind(b) != "number":
            return None
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node[1]]
    if op == "ref":
        return lambda x: evaluate(node[1], x)
    if op == "call":
        return call(node[1], [evaluate(x, v) for x in node[2]])
    raise JmesError(f"unknown node {op}")


_ENCODE = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode


def text(v) -> str:
    return v if isinstance(v, str) else _ENCODE(v)


def _number(v):
    if kind(v) == "number":
        return v
    if isinstance(v, str):
        try:
            x = float(v)
            return int(x) if x.is_integer() and "." not in v and "e" not in v.lower() else x
        except ValueError:
            return None
    return None


def _by(values: list, f, name: str) -> list:
    keys = [f(x) for x in values]
    if len({kind(k) for k in keys}) > 1 or any(kind(k) not in ("number", "string") for k in keys):
        raise JmesError(f"{name}: keys have to be all numbers or all strings")
    return keys


def _plain(a: list, name: str) -> list:
    if len({kind(x) for x in a}) > 1 or any(kind(x) not in ("number", "string") for x in a):
        raise JmesError(f"{name}: all numbers or all strings")
    return a


def _numbers(a: list, name: str) -> list:
    if any(kind(x) != "number" for x in a):
        raise JmesError(f"{name}: all numbers")
    return a


def _strings(a: list, name: str) -> list:
    if any(not isinstance(x, str) for x in a):
        raise JmesError(f"{name}: all strings")
    return a


def _merge(*objects):
    out = {}
    for o in objects:
        out |= o
    return out


def _sort_by(a, f):
    keys = _by(a, f, "sort_by")
    return [a[i] for i in sorted(range(len(a)), key=keys.__getitem__)]


def _best_by(a, f, name, pick):
    keys = _by(a, f, name)
    return a[pick(range(len(a)), key=keys.__getitem__)] if a else None


# Signatures: allowed kinds of each argument (`|` between kinds, `?` any), and the function.
FUNCTIONS = {
    "abs": (["number"], abs),
    "avg": (["array"], lambda a: sum(_numbers(a, "avg")) / len(a) if a else None),
    "ceil": (["number"], math.ceil),
    "contains": (["array|string", "?"], lambda a, x: (isinstance(x, str) and x in a) if isinstance(a, str) else any(same(x, y) for y in a)),
    "ends_with": (["string", "string"], str.endswith),
    "floor": (["number"], math.floor),
    "join": (["string", "array"], lambda s, a: s.join(_strings(a, "join"))),
    "keys": (["object"], sorted),
    "length": (["string|array|object"], len),
    "map": (["expref", "array"], lambda f, a: [f(x) for x in a]),
    "max": (["array"], lambda a: max(_plain(a, "max"), default=None)),
    "max_by": (["array", "expref"], lambda a, f: _best_by(a, f, "max_by", max)),
    "merge": (["object..."], _merge),
    "min": (["array"], lambda a: min(_plain(a, "min"), default=None)),
    "min_by": (["array", "expref"], lambda a, f: _best_by(a, f, "min_by", min)),
    "not_null": (["?..."], lambda *a: next((x for x in a if x is not None), None)),
    "reverse": (["array|string"], lambda a: a[::-1]),
    "sort": (["array"], lambda a: sorted(_plain(a, "sort"))),
    "sort_by": (["array", "expref"], _sort_by),
    "starts_with": (["string", "string"], str.startswith),
    "sum": (["array"], lambda a: sum(_numbers(a, "sum"))),
    "to_array": (["?"], lambda x: x if isinstance(x, list) else [x]),
    "to_number": (["?"], _number),
    "to_string": (["?"], text),
    "type": (["?"], kind),
    "values": (["object"], lambda o: [o[k] for k in sorted(o)]),
}


def call(name: str, args: list):
    if name not in FUNCTIONS:
        raise JmesError(f"unknown function {name}")
    kinds, f = FUNCTIONS[name]
    many = kinds[-1].endswith("...")
    if len(args) < len(kinds) or not many and len(args) > len(kinds):
        raise JmesError(f"{name}: wrong number of arguments")
    for k, a in enumerate(args):
        want = kinds[min(k, len(kinds) - 1)].removesuffix("...")
        if want != "?" and kind(a) not in want.split("|"):
            raise JmesError(f"{name}: argument {k + 1} is {kind(a)}, not {want}")
    return f(*args)


def _fixed(node) -> bool:
    """Whether a node's value is the same for every value that is not null."""
    op = node[0]
    if op in ("literal", "ref"):
        return True
    if op in ("sub", "pipe", "project", "values", "flatten", "filter", "not"):
        return _fixed(node[1])
    if op in ("list", "call"):
        return all(map(_fixed, node[-1]))
    if op == "hash":
        return all(map(_fixed, node[1].values()))
    return op in ("or", "and", "compare") and all(map(_fixed, node[-2:]))


def compiled(node):
    """evaluate for one node, as a function of the value: the tree is walked once, and what no value changes is worked out once."""
    op = node[0]
    if op == "literal":
        return lambda v, x=node[1]: x
    if op == "field":
        return lambda v, k=node[1]: v.get(k) if isinstance(v, dict) else None
    if op == "current":
        return lambda v: v
    if op == "ref":
        f = compiled(node[1])
        return lambda v: f
    if _fixed(node):
        try:
            some, none = evaluate(node, {}), evaluate(node, None)
            return lambda v: none if v is None else some
        except JmesError:  # fails where it is evaluated, and only there
            pass
    if op in ("sub", "pipe"):
        left, right = compiled(node[1]), compiled(node[2])
        if op == "pipe":
            return lambda v: right(left(v))
        return lambda v: None if (x := left(v)) is None else right(x)
    if op in ("list", "hash"):
        parts = [compiled(x) for x in (node[1] if op == "list" else node[1].values())]
        if op == "list":
            return lambda v: None if v is None else [f(v) for f in parts]
        named = list(zip(node[1], parts, strict=True))
        return lambda v: None if v is None else {k: f(v) for k, f in named}
    if op in ("or", "and"):
        left, right = compiled(node[1]), compiled(node[2])
        if op == "or":
            return lambda v: x if truthy(x := left(v)) else right(v)
        return lambda v: right(v) if truthy(x := left(v)) else x
    if op == "call" and node[1] in FUNCTIONS:
        name, args = node[1], [compiled(x) for x in node[2]]
        kinds, f = FUNCTIONS[name]
        if len(args) == len(kinds) and not kinds[-1].endswith("..."):
            allowed = [(a, None if w == "?" else frozenset(w.split("|"))) for a, w in zip(args, kinds, strict=True)]

            def run(v):
                values = [a(v) for a, _ in allowed]
                for x, (_, want) in zip(values, allowed, strict=True):
                    if want is not None and kind(x) not in want:
                        return call(name, values)  # says which
                return f(*values)

            return run
        return lambda v: call(name, [a(v) for a in args])
    return lambda v: evaluate(node, v)
