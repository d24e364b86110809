"""The rule language: a small expression grammar over row, ctx and dataset.

A rule is parsed once and then built against an environment. Whatever does not
touch ``row`` is computed on the driver; the rest becomes a Spark Column, so a
rule never leaves Catalyst. Unknown names and functions are errors.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import operator
import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||&&|==|!=|<=|>=|[-+*/%<>!?:.,()\[\]]))")
_LEVELS = [("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%")]


class RuleError(ValueError):
    """A rule cannot be parsed or built."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        found = _TOKEN.match(text, at)
        if not found:
            raise RuleError(f"unexpected {text[at:].strip()[:10]!r}")
        out.append((found.lastgroup, found.group(found.lastgroup)))
        at = found.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0

    def take(self, value: str | None = None) -> tuple[str, str]:
        tok = self.toks[self.at]
        if value is not None and tok[1] != value:
            raise RuleError(f"expected {value!r}, found {tok[1]!r}")
        if tok[0] == "end":
            raise RuleError("the rule ends too early")
        self.at += 1
        return tok

    def sees(self, *values: str) -> bool:
        kind, value = self.toks[self.at]
        return kind in ("op", "name") and value in values

    def ternary(self) -> tuple:
        test = self.binary(0)
        if not self.sees("?"):
            return test
        self.take()
        yes = self.ternary()
        self.take(":")
        return ("if", test, yes, self.ternary())

    def binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.sees(*_LEVELS[level]):
            left = ("bin", self.take()[1], left, self.binary(level + 1))
        return left

    def unary(self) -> tuple:
        if self.sees("!", "-"):
            return ("un", self.take()[1], self.unary())
        node = self.primary()
        while self.sees("."):
            self.take()
            name = self.take()[1]
            node = ("call", name, [node, *self.arguments()], True) if self.sees("(") else ("get", node, name)
        return node

    def arguments(self, opening: str = "(", closing: str = ")") -> list:
        self.take(opening)
        out = []
        while not self.sees(closing):
            out.append(self.ternary())
            if not self.sees(closing):
                self.take(",")
        self.take(closing)
        return out

    def primary(self) -> tuple:
        if self.sees("("):
            self.take()
            inside = self.ternary()
            self.take(")")
            return inside
        if self.sees("["):
            return ("list", self.arguments("[", "]"))
        kind, value = self.take()
        if kind == "num":
            return ("lit", float(value) if "." in value else int(value))
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind != "name":
            raise RuleError(f"unexpected {value!r}")
        if value in ("true", "false", "null"):
            return ("lit", {"true": True, "false": False, "null": None}[value])
        return ("call", value, self.arguments(), False) if self.sees("(") else ("name", value)


def parse(text: str) -> tuple:
    parser = _Parser(text)
    node = parser.ternary()
    if parser.toks[parser.at][0] != "end":
        raise RuleError(f"unexpected {parser.toks[parser.at][1]!r}")
    return node


def roots(node: Any) -> set[str]:
    """The namespaces (row, ctx, dataset) that a rule reads."""
    if isinstance(node, tuple):
        own = {node[1]} if node[0] == "name" else set()
        return own.union(*(roots(n) for n in node[1:]))
    return set().union(*(roots(n) for n in node)) if isinstance(node, list) else set()


def columns(node: Any) -> set[str]:
    """The row columns that a rule reads."""
    if isinstance(node, tuple):
        own = {node[2]} if node[0] == "get" and node[1] == ("name", "row") else set()
        return own.union(*(columns(n) for n in node[1:]))
    return set().union(*(columns(n) for n in node)) if isinstance(node, list) else set()


def dataset_columns(node: Any, field: str) -> set[str]:
    """The columns whose statistic ``field`` a rule reads."""
    if isinstance(node, tuple):
        own = {node[1][2]} if node[0] == "get" and node[2] == field and node[1][:2] == ("get", ("name", "dataset")) else set()
        return own.union(*(dataset_columns(n, field) for n in node[1:]))
    return set().union(*(dataset_columns(n, field) for n in node)) if isinstance(node, list) else set()


def duration(text: str) -> dt.timedelta:
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise RuleError(f"not a duration: {text!r}")
    return sum((dt.timedelta(**{{"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[u]: float(n)}) for n, u in parts), dt.timedelta())


def _masked(value: Column, keep: int) -> Column:
    return F.when(value.isNotNull(), F.when(F.length(value) <= max(keep, 4), F.lit("***")).otherwise(F.concat(F.lit("***"), F.right(value, F.lit(keep)))))


#: Functions by name: what they are on the driver and as a Column. Null gives null.
FUNCTIONS: dict[str, tuple[Callable, Callable]] = {
    "hash_sha256": (lambda s: hashlib.sha256(str(s).encode()).hexdigest(), lambda c: F.sha2(c.cast("string"), 256)),
    "partial": (lambda s, n: "***" if len(s) <= max(n, 4) else "***" + s[-n:], lambda c, n: _masked(c, n)),
    "redact": (lambda s: "***", lambda c: F.when(c.isNotNull(), F.lit("***"))),
    "is_msisdn": (lambda s: bool(re.search(r"^254[17][0-9]{8}$", s)), lambda c: c.rlike(r"^254[17][0-9]{8}$")),
    "string": (lambda v: str(v).lower() if isinstance(v, bool) else str(v), lambda c: c.cast("string")),
    "int": (int, lambda c: c.cast("bigint")),
    "double": (float, lambda c: c.cast("double")),
    "size": (len, lambda c: F.length(c)),
    "matches": (lambda s, p: bool(re.search(p, s)), lambda c, p: c.rlike(p)),
    "startsWith": (lambda s, p: s.startswith(p), lambda c, p: c.startswith(p)),
    "endsWith": (lambda s, p: s.endswith(p), lambda c, p: c.endswith(p)),
    "contains": (lambda s, p: p in s, lambda c, p: c.contains(p)),
    "duration": (duration, None),
}
_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": lambda a, b: math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else int(math.fmod(a, b))}


def as_column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


class Builder:
    """Builds parsed rules for one caller; ``row`` names the columns that exist."""

    def __init__(self, ctx: Mapping | None = None, row: set[str] | None = None, dataset: Mapping | None = None, functions: Mapping[str, tuple] | None = None, lists: set[str] | None = None):
        self.lists = lists or set()
        self.spaces = {"ctx": ctx, "dataset": dataset}
        self.row, self.functions, self.bound = row, {**FUNCTIONS, **(functions or {})}, {}

    def build(self, node: tuple) -> Any:
        """A Python value where the rule is constant for this caller, else a Column."""
        return getattr(self, f"_{node[0]}")(*node[1:])

    def column(self, node: tuple) -> Column:
        return as_column(self.build(node))

    def truth(self, node: tuple) -> bool:
        value = self.build(node)
        if isinstance(value, Column):
            raise RuleError("this rule may not read rows")
        return value is True

    def _lit(self, value: Any) -> Any:
        return value

    def _list(self, items: list) -> Any:
        return [self.build(n) for n in items]

    def _name(self, name: str) -> Any:
        if name in self.bound:
            return self.bound[name]
        if self.spaces.get(name) is None:
            raise RuleError(f"unknown name {name!r}")
        return self.spaces[name]

    def _get(self, base: tuple, field: str) -> Any:
        if base == ("name", "row"):
            if self.row is None or field not in self.row:
                raise RuleError(f"row has no column {field!r}")
            return F.col(f"`{field}`")
        if base == ("get", ("name", "row"), "other"):
            return self._get(("name", "row"), f"other.{field}")
        held = self.build(base)
        if isinstance(held, Column):
            return held.getField(field)
        if held is None:
            return None
        if not isinstance(held, Mapping):
            raise RuleError(f"{field!r} of a plain value")
        return held.get(field)

    def _un(self, op: str, of: tuple) -> Any:
        value = self.build(of)
        if isinstance(value, Column):
            return ~value if op == "!" else -value
        return None if value is None else (not value if op == "!" else -value)

    def _bin(self, op: str, left: tuple, right: tuple) -> Any:
        a = self.build(left)
        if op in ("&&", "||") and a is (op == "||"):
            return a
        b = self.build(right)
        rows = isinstance(a, Column) or isinstance(b, Column)
        if op == "in":
            if isinstance(b, Column):
                return F.array_contains(b, a)
            return a.isin(*b) if rows else (None if a is None or b is None else a in b)
        if op in ("&&", "||"):
            if not rows:
                return b if a is not None or b is (op == "||") else None
            return as_column(a) & as_column(b) if op == "&&" else as_column(a) | as_column(b)
        if ("lit", None) in (left, right) and op in ("==", "!="):
            known = b if a is None else a
            if isinstance(known, Column):
                return known.isNull() if op == "==" else known.isNotNull()
            return (known is None) == (op == "==")
        if not rows:
            return None if a is None or b is None else _OPS[op](a, b)
        return as_column(a) % as_column(b) if op == "%" else _OPS[op](as_column(a), as_column(b))

    def _if(self, test: tuple, yes: tuple, no: tuple) -> Any:
        held = self.build(test)
        if not isinstance(held, Column):
            return self.build(yes if held is True else no)
        return F.when(held, self.column(yes)).otherwise(self.column(no))

    def _call(self, name: str, args: list, method: bool) -> Any:
        if name == "has":
            held = self.build(args[0])
            return held.isNotNull() if isinstance(held, Column) else held is not None
        if name == "exists" and method:
            over, variable = self.build(args[0]), args[1][1]

            def holds(item: Any) -> Any:
                self.bound[variable] = item
                try:
                    return self.build(args[2])
                finally:
                    del self.bound[variable]

            return F.exists(over, lambda item: as_column(holds(item))) if isinstance(over, Column) else any(holds(i) for i in over)
        if name not in self.functions:
            raise RuleError(f"unknown function {name!r}")
        values = [self.build(a) for a in args]
        on_driver, on_rows = self.functions[name]
        if isinstance(values[0], Column):
            if name == "size" and isinstance(args[0], tuple) and args[0][:2] == ("get", ("name", "row")) and args[0][2] in self.lists:
                return F.size(values[0])
            if on_rows is None:
                raise RuleError(f"{name} takes a constant")
            return on_rows(*values)
        return None if values[0] is None else on_driver(*values)
