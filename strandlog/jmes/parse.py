"""A parser for JMESPath expressions, after the language's public grammar.

Nodes are tuples: ("field", name), ("index", n), ("slice", a, b, c), ("sub", l, r),
("project", l, r), ("values", l, r), ("flatten", l, r), ("filter", l, condition, r),
("list", items), ("hash", {name: item}), ("pipe", l, r), ("or" | "and", l, r), ("not", x),
("compare", op, l, r), ("literal", value), ("call", name, args), ("ref", x), ("current",).
"""

from __future__ import annotations

import json
import re

TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<raw>'(?:[^'\\]|\\.)*')
    |(?P<literal>`(?:[^`\\]|\\.)*`)|(?P<number>-?[0-9]+)|(?P<op>\[\?|\[\]|&&|\|\||==|!=|<=|>=|[\[\](){}.,:*@&|!<>])""",
    re.X,
)
#: Binding powers of what may follow an expression.
POWER = {"|": 1, "||": 2, "&&": 3, "==": 5, "!=": 5, "<": 5, "<=": 5, ">": 5, ">=": 5, "[]": 9, "[?": 21, ".": 40, "[": 55}
NOT, STAR, PROJECTION = 45, 20, 10


class JmesError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise JmesError(f"unexpected character {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group()))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self, value: str | None = None) -> tuple[str, str]:
        kind, got = self.peek()
        if value is not None and (kind != "op" or got != value):
            raise JmesError(f"expected {value!r}, found {got!r}")
        self.at += 1
        return kind, got

    def whole(self):
        out = self.expression(0)
        if self.peek()[0] != "end":
            raise JmesError(f"unexpected {self.peek()[1]!r}")
        return out

    def power(self) -> int:
        kind, value = self.peek()
        return POWER.get(value, 0) if kind == "op" else 0

    def expression(self, least: int):
        left = self.first()
        while least < self.power():
            left = self.then(left)
        return left

    def first(self):
        kind, value = self.take()
        if kind == "name":
            return self.call(value) if self.peek() == ("op", "(") else ("field", value)
        if kind == "quoted":
            if self.peek() == ("op", "("):
                raise JmesError("a quoted name is no function")
            return ("field", json.loads(value))
        if kind == "raw":
            return ("literal", value[1:-1].replace("\\'", "'"))
        if kind == "literal":
            inner = value[1:-1].replace("\\`", "`").strip()
            try:
                return ("literal", json.loads(inner))
            except ValueError:
                return ("literal", inner)
        if kind == "op":
            if value == "@":
                return ("current",)
            if value == "!":
                return ("not", self.expression(NOT))
            if value == "&":
                return ("ref", self.expression(0))
            if value == "(":
                inner = self.expression(0)
                self.take(")")
                return inner
            if value == "*":
                return ("values", ("current",), self.rest(STAR))
            if value == "[]":
                return ("flatten", ("current",), self.rest(POWER["[]"]))
            if value == "[?":
                return self.filter(("current",))
            if value == "{":
                return self.hash()
            if value == "[":
                k, v = self.peek()
                if k == "number" or (k, v) == ("op", ":"):
                    return self.index(("current",))
                if (k, v) == ("op", "*") and self.peek(1) == ("op", "]"):
                    self.at += 2
                    return ("project", ("current",), self.rest(STAR))
                return self.multi()
        raise JmesError(f"unexpected {value or 'end'!r}")

    def then(self, left):
        _, value = self.take()
        if value == ".":
            if self.peek() == ("op", "*"):
                self.take()
                return ("values", left, self.rest(STAR))
            return ("sub", left, self.dotted(POWER["."]))
        if value == "|":
            return ("pipe", left, self.expression(POWER["|"]))
        if value in ("||", "&&"):
            return ({"||": "or", "&&": "and"}[value], left, self.expression(POWER[value]))
        if value in ("==", "!=", "<", "<=", ">", ">="):
            return ("compare", value, left, self.expression(POWER[value]))
        if value == "[]":
            return ("flatten", left, self.rest(POWER["[]"]))
        if value == "[?":
            return self.filter(left)
        k, v = self.peek()  # value is [
        if k == "number" or (k, v) == ("op", ":"):
            return self.index(left)
        self.take("*")
        self.take("]")
        return ("project", left, self.rest(STAR))

    def dotted(self, power: int):
        kind, value = self.peek()
        if kind in ("name", "quoted") or (kind, value) == ("op", "*"):
            return self.expression(power)
        if (kind, value) == ("op", "["):
            self.take()
            return self.multi()
        if (kind, value) == ("op", "{"):
            self.take()
            return self.hash()
        raise JmesError(f"unexpected {value!r} after a dot")

    def rest(self, power: int):
        """What is projected."""
        kind, value = self.peek()
        if self.power() < PROJECTION:
            return ("current",)
        if kind == "op" and value in ("[", "[?"):
            return self.expression_from_current(power)
        if (kind, value) == ("op", "."):
            self.take()
            return self.dotted_chain(power)
        raise JmesError(f"unexpected {value!r} in a projection")

    def dotted_chain(self, power: int):
        left = self.dotted(power)
        while power < self.power():
            left = self.then(left)
        return left

    def expression_from_current(self, power: int):
        left = self.first()
        while power < self.power():
            left = self.then(left)
        return left

    def filter(self, left):
        condition = self.expression(0)
        self.take("]")
        if self.peek() == ("op", "[]"):
            return ("filter", left, condition, ("current",))
        return ("filter", left, condition, self.rest(POWER["[?"]))

    def index(self, left):
        parts: list[int | None] = [None]
        while self.peek() != ("op", "]"):
            kind, value = self.take()
            if kind == "number":
                parts[-1] = int(value)
            elif (kind, value) == ("op", ":"):
                parts.append(None)
            else:
                raise JmesError(f"unexpected {value!r} in an index")
        self.take("]")
        if len(parts) == 1:
            return ("sub", left, ("index", parts[0]))
        if len(parts) > 3:
            raise JmesError("too many colons in a slice")
        if len(parts) == 3 and parts[2] == 0:
            raise JmesError("a slice's step is not 0")
        return ("project", ("sub", left, ("slice", *(parts + [None])[:3])), self.rest(STAR))

    def multi(self):
        items = [self.expression(0)]
        while self.peek() == ("op", ","):
            self.take()
            items.append(self.expression(0))
        self.take("]")
        return ("list", tuple(items))

    def hash(self):
        out = {}
        while True:
            kind, value = self.take()
            if kind not in ("name", "quoted"):
                raise JmesError(f"expected a name, found {value!r}")
            self.take(":")
            out[json.loads(value) if kind == "quoted" else value] = self.expression(0)
            if self.take()[1] == "}":
                return ("hash", out)
            if self.tokens[self.at - 1] != ("op", ","):
                raise JmesError("expected , or }")

    def call(self, name: str):
        self.take("(")
        args = []
        while self.peek() != ("op", ")"):
            args.append(self.expression(0))
            if self.peek() == ("op", ","):
                self.take()
            elif self.peek() != ("op", ")"):
                raise JmesError(f"unexpected {self.peek()[1]!r} in arguments")
        self.take(")")
        return ("call", name, tuple(args))


def parse(text: str):
    return Parser(text).whole()
