"""JMESPath over a column of JSON texts: lowered to built-in expressions where they say the same, else evaluated in Arrow batches.

Values are rendered as text: strings bare, others as JSON with sorted keys; null, and a text
that is no JSON, is no value. Paths of fields are read from the text as it is. All else is
lowered to VARIANT expressions, which Spark runs without Python: literals, indexes, slices
that go forward, list, object, filter and flatten projections, multi-selects, pipes, ||, &&,
!, comparisons (== and != with a literal on one side), and the functions in CALLS. A node
without such a form (reference expressions, sorting, arithmetic over arrays and a few more)
sends the whole expression to the evaluator.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandlog.jmes.evaluate import compiled, text
from strandlog.jmes.parse import parse


def is_jmes(expression: str) -> bool:
    """Whether an expression is taken as JMESPath and not as a dotted path."""
    return any(c in expression for c in "[|@")


def _path(node) -> list[str] | None:
    if node == ("current",):
        return []
    if node[0] == "field" and "'" not in node[1]:
        return [node[1]]
    if node[0] in ("sub", "pipe"):
        left, right = _path(node[1]), _path(node[2])
        return None if left is None or right is None else left + right
    return None


class Unlowered(Exception):
    """A node that has no built-in form."""


def _let(values: list[Column], f: Callable[..., Column]) -> Column:
    """f of the values, each of which is computed once, however often f uses it."""

    def bound(left: list[Column], got: tuple[Column, ...]) -> Column:
        if not left:
            return f(*got)
        return F.get(F.transform(F.array(left[0]), lambda x: bound(left[1:], (*got, x))), 0)

    return bound(list(values), ())


def _known(x: Column) -> Column:
    """JSON's null is no value."""
    return _let([x], lambda y: F.when(~F.is_variant_null(y), y))


def _get(x: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(x, path, kind)


def _list(x: Column) -> Column:
    """A value's elements; null if it is no array."""
    return _get(x, "$", "array<variant>")


def _whole(x: Column) -> Column:
    """A built-in array or struct as a value."""
    return F.to_variant_object(x)


def _starts(x: Column, *marks: str) -> Column:
    j = F.to_json(x)
    out = F.lit(False)
    for m in marks:
        out = out | j.startswith(m)
    return F.coalesce(out, F.lit(False))


def _is_string(x: Column) -> Column:
    return _starts(x, '"')


def _is_number(x: Column) -> Column:
    return F.coalesce(~F.to_json(x).rlike('^["\\[{tfn]'), F.lit(False))


def _text(x: Column) -> Column:
    return _get(x, "$", "string")


def _truthy(x: Column) -> Column:
    return F.coalesce(~F.to_json(x).isin("false", '""', "[]", "{}", "null"), F.lit(False))


def _bool(x: Column) -> Column:
    return F.parse_json(x.cast("string"))


def _typed(name: str, k: int, ok: Column, want: str, value: Column) -> Column:
    """value where an argument is of a kind that the function takes; else the evaluation fails, as the language has it."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(f"{name}: argument {k} is not {want}")))


def _selected(a: Column, each: Callable[[Column], Column]) -> Column:
    return _whole(F.filter(F.transform(a, lambda x: each(_known(x))), lambda y: y.isNotNull()))


def _compared(op: str, left, right, v: Column) -> Column:
    if op in ("==", "!="):
        if left[0] == "literal":
            left, right = right, left
        if right[0] != "literal":
            raise Unlowered(op)
        a, want = lower(left, v), right[1]
        if want is None:
            same = a.isNull()
        elif isinstance(want, bool) or isinstance(want, str):
            same = F.coalesce(F.to_json(a) == json.dumps(want, ensure_ascii=False), F.lit(False))
        elif isinstance(want, (int, float)):
            same = _let([a], lambda x: F.coalesce(_is_number(x) & (_get(x, "$", "double") == float(want)), F.lit(False)))
        else:
            raise Unlowered("comparison with an array or an object")
        return _bool(same if op == "==" else ~same)

    def ordered(a: Column, b: Column) -> Column:
        x, y = _get(a, "$", "double"), _get(b, "$", "double")
        return F.when(_is_number(a) & _is_number(b), {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])

    return _bool(_let([lower(left, v), lower(right, v)], ordered))


def _affix(name: str):
    def run(a: Column, b: Column) -> Column:
        ok = _is_string(a) & _is_string(b)
        return _typed(name, 1, ok, "a string", _bool((F.startswith if name == "starts_with" else F.endswith)(_text(a), _text(b))))

    return run


def _contains(a: Column, b: Column) -> Column:
    text_in = F.when(_is_string(b), F.contains(_text(a), _text(b))).otherwise(F.lit(False))
    member = F.exists(_list(a), lambda x: F.to_json(x).eqNullSafe(F.to_json(F.coalesce(b, F.parse_json(F.lit("null"))))))
    return _typed("contains", 1, _starts(a, '"', "["), "a string or an array", _bool(F.when(_is_string(a), text_in).otherwise(member)))


def _length(a: Column) -> Column:
    n = F.when(_is_string(a), F.length(_text(a))).when(_starts(a, "["), F.size(_list(a))).otherwise(F.size(_get(a, "$", "map<string,variant>")))
    return _typed("length", 1, _starts(a, '"', "[", "{"), "a string, an array or an object", F.parse_json(n.cast("string")))


def _kind(a: Column) -> Column:
    return F.parse_json(
        F.when(a.isNull(), '"null"').when(_is_string(a), '"string"').when(_starts(a, "["), '"array"').when(_starts(a, "{"), '"object"').when(_starts(a, "t", "f"), '"boolean"').otherwise('"number"')
    )


def _object(name: str, take):
    def run(a: Column) -> Column:
        fields = _get(a, "$", "map<string,variant>")
        return _typed(name, 1, _starts(a, "{"), "an object", _whole(take(fields)))

    return run


def _sorted_values(fields: Column) -> Column:
    return F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.element_at(fields, k))


def _join(a: Column, b: Column) -> Column:
    ok = _is_string(a) & _starts(b, "[") & F.coalesce(F.forall(_list(b), _is_string), F.lit(False))
    joined = F.call_function("array_join", F.transform(_list(b), _text), _text(a))
    return _typed("join", 2, ok, "an array of strings", F.get(_list(_whole(F.array(joined))), 0))


def _step(name: str, f):
    def run(a: Column) -> Column:
        return _typed(name, 1, _is_number(a), "a number", F.parse_json(f(_get(a, "$", "decimal(38,18)")).cast("string")))

    return run


#: Functions with a built-in form: numbers of arguments, and the form.
CALLS = {
    "starts_with": (2, _affix("starts_with")),
    "ends_with": (2, _affix("ends_with")),
    "contains": (2, _contains),
    "length": (1, _length),
    "type": (1, _kind),
    "not_null": (None, lambda *a: F.coalesce(*a)),
    "keys": (1, _object("keys", lambda m: F.array_sort(F.map_keys(m)))),
    "values": (1, _object("values", _sorted_values)),
    "join": (2, _join),
    "to_array": (1, lambda a: F.when(_starts(a, "["), a).otherwise(_whole(F.array(a)))),
    "to_string": (1, lambda a: F.when(_is_string(a), a).otherwise(F.get(_list(_whole(F.array(F.coalesce(F.to_json(a), F.lit("null"))))), 0))),
    "ceil": (1, _step("ceil", F.ceil)),
    "floor": (1, _step("floor", F.floor)),
}


def lower(node, v: Column) -> Column:
    """A node's value, of VARIANT, for a value v of that type (null: none)."""
    op = node[0]
    if op == "current":
        return v
    if op == "field":
        if "'" in node[1]:
            raise Unlowered("a field with a quote")
        return _known(_get(v, f"$['{node[1]}']"))
    if op == "literal":
        return _known(F.parse_json(F.lit(json.dumps(node[1]))))
    if op == "index":
        return _known(_get(v, f"$[{node[1]}]")) if node[1] >= 0 else _known(F.try_element_at(_list(v), F.lit(node[1])))
    if op == "slice":
        a, b, c = node[1:]
        if c not in (None, 1) or (a or 0) < 0 or (b or 0) < 0:
            raise Unlowered("a slice from the end")
        start = a or 0
        n = F.greatest(F.size(_list(v)), F.lit(0)) if b is None else F.lit(max(0, b - start))
        return _whole(F.slice(_list(v), start + 1, n))
    if op in ("sub", "pipe"):
        return _let([lower(node[1], v)], lambda x: lower(node[2], x) if op == "pipe" else F.when(x.isNotNull(), lower(node[2], x)))
    if op == "project":
        return _selected(_list(lower(node[1], v)), lambda x: lower(node[2], x))
    if op == "values":
        fields = _let([lower(node[1], v)], lambda y: F.when(_starts(y, "{"), _sorted_values(_get(y, "$", "map<string,variant>"))))
        return _selected(fields, lambda x: lower(node[2], x))
    if op == "flatten":
        flat = F.flatten(F.transform(_list(lower(node[1], v)), lambda x: F.coalesce(_list(x), F.array(x))))
        return _selected(flat, lambda x: lower(node[2], x))
    if op == "filter":
        kept = F.filter(_list(lower(node[1], v)), lambda x: _truthy(lower(node[2], _known(x))))
        return _selected(kept, lambda x: lower(node[-1], x))
    if op == "list":
        return F.when(v.isNotNull(), _whole(F.array(*[lower(x, v) for x in node[1]])))
    if op == "hash":
        return F.when(v.isNotNull(), _whole(F.struct(*[lower(x, v).alias(k) for k, x in node[1].items()])))
    if op == "or":
        return _let([lower(node[1], v)], lambda x: F.when(_truthy(x), x).otherwise(lower(node[2], v)))
    if op == "and":
        return _let([lower(node[1], v)], lambda x: F.when(_truthy(x), lower(node[2], v)).otherwise(x))
    if op == "not":
        return _bool(~_truthy(lower(node[1], v)))
    if op == "compare":
        return _compared(node[1], node[2], node[3], v)
    if op == "call" and node[1] in CALLS:
        n, f = CALLS[node[1]]
        if n == len(node[2]) or n is None and node[2]:
            return _let([lower(x, v) for x in node[2]], f)
    raise Unlowered(op)


def _led(node) -> tuple[list[str], object]:
    """(path, rest) of an expression that is a path of fields first and then something else of what is there."""
    if _path(node):
        return _path(node), ("current",)
    if node[0] in ("sub", "pipe", "project", "flatten", "filter", "values"):
        path, rest = _led(node[1])
        return path, (node[0], rest, *node[2:])
    return [], node


def native(node, column: Column) -> Column | None:
    """The value's text as a built-in expression; None if the node has no such form."""
    path = _path(node)
    at = lambda p: F.get_json_object(column, "$" + "".join(f"['{k}']" for k in p))
    if path:
        return at(path)
    path, rest = _led(node)
    try:
        # what a path leads to is cut out of the text first, so that only that is parsed; a bare string there is none of what follows
        whole = F.try_parse_json(at(path) if path else column)
        out = _let([_known(whole)], lambda v: lower(rest, v))
    except Unlowered:
        return None
    return _let([out], lambda x: F.when(_is_string(x), _text(x)).otherwise(F.to_json(x)))


def rendered(expression: str):
    """A function of a column of JSON texts that gives the expression's text, null for none."""
    node = parse(expression)

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out, value = [], compiled(node)
        for x in column.to_pylist():
            try:
                doc = None if x is None else json.loads(x)
            except ValueError:
                doc = None
            v = None if doc is None else value(doc)
            out.append(None if v is None else text(v))
        return pa.array(out, pa.string())

    return run


def _calls(node) -> bool:
    """Whether there is a function call in a node."""
    if isinstance(node, dict):
        node = list(node.values())
    return isinstance(node, (tuple, list)) and (node[:1] == ("call",) or any(map(_calls, node)))


def query(expression: str, column: Column) -> Column:
    """The expression's text: the built-in form without calls, else the evaluator.

    Each call checks the kinds of its arguments, for which VARIANT has no cheap test: a query of six calls took 277 task seconds so, 151 in the evaluator.
    """
    node = parse(expression)
    fast = None if _calls(node) else native(node, column)
    return fast if fast is not None else rendered(expression)(column)
