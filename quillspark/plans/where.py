"""The `where` and `sort` clauses: parsers, and their compilation to columns.

Conditions are two-valued: a missing field is false for every comparison but `!=`. Ordering values of different types
is an error, and only where the condition is reached, as `and` and `or` stop at the first side that decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import values as V


class QueryParseError(ValueError):
    """A clause that can't be read; position counts characters from 0."""

    def __init__(self, message: str, position: int) -> None:
        super().__init__(f"{message} at byte {position}")
        self.message, self.position = message, position


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple


@dataclass(frozen=True)
class SortKey:
    field: str
    desc: bool = False
    nulls_last: bool = False


OPS = ("==", "!=", ">=", "<=", ">", "<")
WORD_OPS = {"contains": "contains", "starts_with": "starts_with", "startswith": "starts_with", "ends_with": "ends_with", "endswith": "ends_with"}
_TOKEN = re.compile(r"\s*(?:(?P<op>==|!=|>=|<=|>|<)|(?P<par>[()])|(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>-?[0-9][0-9.]*)|(?P<id>[A-Za-z_.][A-Za-z0-9_\-.:]*))")


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        if not text[at:].strip():
            break
        m = _TOKEN.match(text, at)
        if not m:
            at += len(text[at:]) - len(text[at:].lstrip())
            raise QueryParseError("unterminated string" if text[at] in "'\"" else f"unexpected character '{text[at]}'", at)
        out.append((m.lastgroup, m.group(m.lastgroup), m.start(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at, self.end = _tokens(text), 0, len(text.encode())

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", self.end)

    def word(self, *names: str) -> bool:
        kind, text, _ = self.peek()
        if kind == "id" and text.lower() in names:
            self.at += 1
            return True
        return False

    def chain(self, name: str, part: Callable) -> object:
        parts = [part()]
        while self.word(name):
            parts.append(part())
        return parts[0] if len(parts) == 1 else Logic(name, tuple(parts))

    def either(self) -> object:
        return self.chain("or", self.both)

    def both(self) -> object:
        return self.chain("and", self.negated)

    def negated(self) -> object:
        return Logic("not", (self.negated(),)) if self.word("not") else self.primary()

    def primary(self) -> object:
        kind, text, at = self.peek()
        if (kind, text) == ("par", "("):
            self.at += 1
            inner = self.either()
            if self.peek()[:2] != ("par", ")"):
                raise QueryParseError("expected ')'", self.peek()[2])
            self.at += 1
            return inner
        if kind != "id":
            raise QueryParseError("expected field name", at)
        self.at += 1
        op_kind, op, op_at = self.peek()
        if op_kind == "id" and op.lower() in WORD_OPS:
            op = WORD_OPS[op.lower()]
        elif op_kind != "op":
            raise QueryParseError("expected operator", op_at)
        self.at += 1
        return Compare(text, op, self.literal())

    def literal(self) -> object:
        kind, text, at = self.peek()
        self.at += 1
        if kind == "str":
            return text[1:-1]
        if kind == "num":
            try:
                return float(text)
            except ValueError:
                raise QueryParseError("invalid number", at) from None
        if kind == "id" and text.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text.lower()]
        raise QueryParseError("expected literal", at)


def parse_where(text: str | None) -> object | None:
    """Syntax tree of a `where` clause; None for a blank one."""
    if text is None or not text.strip():
        return None
    p = _Parser(text)
    tree = p.either()
    if p.peek()[0] != "end":
        raise QueryParseError("unexpected token", p.peek()[2])
    return tree


def parse_sort(text: str | None) -> list[SortKey]:
    """Keys of a `sort` clause `field[:asc|desc][:nulls_first|nulls_last],...`; the parts of a key come in any order."""
    if text is None or not text.strip():
        return []
    keys, at = [], 0
    for segment in text.split(","):
        field, desc, last = None, False, False
        if not segment.strip():
            raise QueryParseError("empty sort segment", at)
        for part in map(str.strip, segment.split(":")):
            low = part.lower()
            if low in ("asc", "desc"):
                desc = low == "desc"
            elif low in ("nulls_first", "nulls_last"):
                last = low == "nulls_last"
            elif not part:
                raise QueryParseError("empty sort part", at)
            elif field is not None:
                raise QueryParseError(f"unexpected sort part '{part}'", at)
            else:
                field = part
        if field is None:
            raise QueryParseError("sort field is missing", at)
        keys.append(SortKey(field, desc, last))
        at += len(segment) + 1
    return keys


def fields_of(tree: object | None) -> set[str]:
    if tree is None:
        return set()
    return {tree.field} if isinstance(tree, Compare) else set().union(*map(fields_of, tree.parts))


def _literal(x: object) -> Column:
    if x is None:
        return F.lit("null")
    if isinstance(x, bool):
        return F.lit(str(x).lower())
    return F.lit(x).cast("string") if isinstance(x, float) else V.quote(F.lit(x))


def _text(x: object) -> str:
    return str(x).lower() if isinstance(x, bool) else str(x)


def _mismatch(c: Compare) -> Column:
    return F.raise_error(F.lit(f"type mismatch: field '{c.field}' can't be compared by {c.op}")).cast("boolean")


def _leaf(c: Compare, v: Column) -> Column:
    here = V.is_present(v)
    if c.op in ("==", "!="):
        same = here & F.coalesce(v["repr"] == _literal(c.value), F.lit(False))
        return same if c.op == "==" else ~same
    if c.op in (">", ">=", "<", "<="):
        by = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[c.op]
        if isinstance(c.value, float):
            ok = F.when(v["rank"] == V.NUMBER, by(v["n"], F.lit(c.value)))
        elif isinstance(c.value, str):
            ok = F.when(v["rank"] == V.STRING, by(v["s"], F.lit(c.value)))
        else:
            ok = F.lit(None).cast("boolean")
        return F.when(~here, False).otherwise(F.coalesce(ok, _mismatch(c)))
    if c.op == "contains":
        if c.value is None:
            return F.when(~here, False).otherwise(_mismatch(c))
        needle = _text(c.value).lower()
        return F.when(~here, False).otherwise(F.exists(V.scalar_texts(v), lambda x: F.contains(F.lower(x), F.lit(needle))))
    test = F.startswith if c.op == "starts_with" else F.endswith
    scalar = v["rank"].isin(V.BOOL, V.NUMBER, V.STRING) & F.lit(c.value is not None)
    return F.when(~here, False).when(F.coalesce(scalar, F.lit(False)), test(V.display(v), F.lit(_text(c.value)))).otherwise(_mismatch(c))


def compile_where(tree: object | None, value: Callable[[str], Column | None]) -> Column:
    """The condition as a column. `value` gives a field's value struct, or None for an unknown field (missing)."""
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Compare):
        v = value(tree.field)
        if v is None:
            return F.lit(tree.op == "!=")
        return F.coalesce(_leaf(tree, v), F.lit(False))
    parts = [compile_where(p, value) for p in tree.parts]
    if tree.op == "not":
        return ~parts[0]
    # nested cases, as the planner may evaluate the sides of `and` in any order
    if tree.op == "and":
        return reduce(lambda a, b: F.when(a, b).otherwise(False), parts)
    return reduce(lambda a, b: F.when(a, True).otherwise(b), parts)


def compile_sort(keys: list[SortKey], value: Callable[[str], Column | None], path: Column, file_id: Column) -> list[Column]:
    """Sort columns of the keys, then path and file_id."""
    out = []
    for k in keys:
        v = value(k.field)
        if v is not None:
            out.append(V.order(V.text_key(v), k.desc, k.nulls_last))
    return [*out, path.asc(), file_id.asc()]
