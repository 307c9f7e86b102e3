"""The filter language: text to expression tree to Spark columns.

    expr   := and_ ("or" and_)*          and_ := unary ("and" unary)*
    unary  := "not" unary | "(" expr ")" | clause
    clause := field op value | field ["not"] "in" "(" values ")" | field "is" ["not"] "null"
            | field ["not"] ("like" | "has_prefix" | "has_suffix") text
            | field "contains" (value | ("any" | "all") "(" values ")")

Keywords are lower case, equality is ``==``, strings are JSON strings, there is no null literal.

Logic is two-valued: a missing field makes every clause false except ``is null`` and the negated forms. Instead of
wrapping leaves in coalesce, which would hide them from Parquet pushdown, an expression is compiled twice, to "is true"
and to "is not true" (:func:`holds`, :func:`fails`), and negation swaps the two. Types are checked against the schema,
so a clause between types that cannot compare becomes a constant instead of a cast error under ANSI rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInput


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class In:
    field: str
    values: tuple
    negated: bool


@dataclass(frozen=True)
class IsNull:
    field: str
    negated: bool


@dataclass(frozen=True)
class Text:
    field: str
    kind: str  # like, has_prefix, has_suffix
    pattern: str
    negated: bool


@dataclass(frozen=True)
class Contains:
    field: str
    mode: str  # one, any, all
    values: tuple


_OPS = ("==", "!=", ">=", "<=", ">", "<")
_NAME = re.compile(r"[^\s><=!()]+")
_BARE = re.compile(r"[^\s,()]+")
_INT = re.compile(r"[+-]?[0-9]+\Z")
_FLOAT = re.compile(r"[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\Z", re.IGNORECASE)
_TEXTS = ("like", "has_prefix", "has_suffix")


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str):
        raise InvalidInput(f"filter: {what} at {self.at} in {self.text!r}")

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def word(self, *words: str) -> bool:
        """Take these words if they come next, each followed by something that ends a word."""
        mark = self.at
        for w in words:
            self.space()
            end = self.at + len(w)
            if not self.text.startswith(w, self.at) or (end < len(self.text) and (self.text[end].isalnum() or self.text[end] == "_")):
                self.at = mark
                return False
            self.at = end
        return True

    def sign(self, s: str) -> bool:
        self.space()
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return True
        return False

    def whole(self):
        e = self.either()
        self.space()
        if self.at < len(self.text):
            self.fail("something follows the expression")
        return e

    def either(self):
        parts = [self.both()]
        while self.word("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.one()]
        while self.word("and"):
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def one(self):
        if self.word("not"):
            return Not(self.one())
        if self.sign("("):
            e = self.either()
            if not self.sign(")"):
                self.fail("a closing parenthesis is missing")
            return e
        return self.clause()

    def clause(self):
        self.space()
        m = _NAME.match(self.text, self.at)
        if not m:
            self.fail("a field is expected")
        name, self.at = m.group(), m.end()
        if self.word("is", "not", "null"):
            return IsNull(name, True)
        if self.word("is", "null"):
            return IsNull(name, False)
        for negated, lead in ((True, ("not",)), (False, ())):
            if self.word(*lead, "in"):
                return In(name, self.values(), negated)
            for kind in _TEXTS:
                if self.word(*lead, kind):
                    return Text(name, kind, self.pattern(), negated)
        if self.word("contains", "any"):
            return Contains(name, "any", self.values())
        if self.word("contains", "all"):
            return Contains(name, "all", self.values())
        if self.word("contains"):
            return Contains(name, "one", (self.value(),))
        for op in _OPS:
            if self.sign(op):
                return Compare(name, op, self.value())
        self.fail("an operator is expected")

    def string(self) -> str | None:
        self.space()
        if not self.text.startswith('"', self.at):
            return None
        try:
            value, end = json.JSONDecoder().raw_decode(self.text, self.at)
        except ValueError:
            self.fail("a string does not end")
        self.at = end
        return value

    def bare(self) -> str:
        self.space()
        m = _BARE.match(self.text, self.at)
        if not m:
            self.fail("a value is expected")
        self.at = m.end()
        return m.group()

    def value(self):
        if (s := self.string()) is not None:
            return s
        token = self.bare()
        if token in ("true", "false"):
            return token == "true"
        if _INT.match(token):
            return int(token)
        if _FLOAT.match(token):
            return float(token)
        self.fail(f"{token!r} is no value")

    def values(self) -> tuple:
        if not self.sign("("):
            self.fail("a list is expected")
        out = []
        if self.sign(")"):
            return ()
        while True:
            out.append(self.value())
            if self.sign(")"):
                return tuple(out)
            if not self.sign(","):
                self.fail("a comma is expected")

    def pattern(self) -> str:
        s = self.string()
        return self.bare() if s is None else s


def parse(text: str):
    """The expression tree of a filter; a blank filter is an error."""
    if not text.strip():
        raise InvalidInput("filter: it is blank")
    return _Parser(text).whole()


def referenced_fields(e) -> set[str]:
    if isinstance(e, (And, Or)):
        return set().union(*map(referenced_fields, e.parts))
    return referenced_fields(e.part) if isinstance(e, Not) else {e.field}


# --- columns ---------------------------------------------------------------------------------------------------

_FLOATS = (T.FloatType, T.DoubleType)
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, *_FLOATS)


def _comparable(kind: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return isinstance(kind, _NUMBERS)


def _literal(kind: T.DataType, value) -> Column:
    if isinstance(value, bool) or isinstance(value, str):
        return F.lit(value)
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            return F.lit(float(value)) if isinstance(kind, _FLOATS) else F.lit(Decimal(value))
        return F.lit(value)
    # a decimal literal meets a float column as a float, as SQL engines do
    return F.lit(value).cast("float") if isinstance(kind, T.FloatType) else F.lit(value)


def _nan(value) -> bool:
    return isinstance(value, float) and value != value


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False)) if not columns else reduce(lambda a, b: a | b, columns)


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def like_regex(pattern: str) -> str:
    """``%`` stands for any text, ``_`` for one character; nothing escapes them."""
    return r"(?s)\A" + "".join(".*" if c == "%" else "." if c == "_" else _quoted(c) for c in pattern) + r"\z"


def _quoted(c: str) -> str:
    return c if c.isalnum() or c == " " or ord(c) > 127 else "\\" + c


def _text_test(c: Column, kind: str, pattern: str) -> Column:
    if kind == "has_prefix":
        return c.startswith(pattern)
    if kind == "has_suffix":
        return c.endswith(pattern)
    body = pattern.strip("%")
    if "_" not in pattern and "%" not in body and body:  # forms that Parquet readers can push down
        head, tail = pattern.startswith("%"), pattern.endswith("%")
        return c.contains(body) if head and tail else c.endswith(body) if head else c.startswith(body) if tail else c == body
    return c.rlike(like_regex(pattern))


class Compiler:
    """Columns of expressions over the fields of ``types``; any other field is always missing."""

    def __init__(self, types: Mapping[str, T.DataType]):
        self.types = types

    def holds(self, e) -> Column:
        """Whether ``e`` is true, for use in WHERE: null counts as false."""
        if isinstance(e, And):
            return _all([self.holds(p) for p in e.parts])
        if isinstance(e, Or):
            return _any([self.holds(p) for p in e.parts])
        if isinstance(e, Not):
            return self.fails(e.part)
        return self._leaf(e)[0]

    def fails(self, e) -> Column:
        """Whether ``e`` is not true."""
        if isinstance(e, And):
            return _any([self.fails(p) for p in e.parts])
        if isinstance(e, Or):
            return _all([self.fails(p) for p in e.parts])
        if isinstance(e, Not):
            return self.holds(e.part)
        return self._leaf(e)[1]

    def _leaf(self, e) -> tuple[Column, Column]:
        kind = self.types.get(e.field)
        never, always = F.lit(False), F.lit(True)
        if kind is None:
            missing_holds = isinstance(e, (In, IsNull, Text)) and (e.negated != isinstance(e, IsNull))
            return (always, never) if missing_holds else (never, always)
        c = F.col(f"`{e.field}`")
        absent, present = c.isNull(), c.isNotNull()
        if isinstance(e, IsNull):
            return (present, absent) if e.negated else (absent, present)
        if isinstance(e, Compare):
            return self._compare(c, kind, e.op, e.value, absent, present)
        if isinstance(e, In):
            values = [v for v in e.values if _comparable(kind, v) and not _nan(v)]
            hit = c.isin([_literal(kind, v) for v in values]) if values else None
            if hit is not None and isinstance(kind, _FLOATS):
                inside, outside = hit & ~F.isnan(c), absent | F.isnan(c) | ~hit
            else:
                inside, outside = (hit, absent | ~hit) if hit is not None else (never, always)
            return (outside, inside) if e.negated else (inside, outside)
        if isinstance(e, Text):
            if not isinstance(kind, T.StringType):  # a present value that is no string fails either sign
                return (absent, present) if e.negated else (never, always)
            hit = _text_test(c, e.kind, e.pattern)
            return (absent | ~hit, hit) if e.negated else (hit, absent | ~hit)
        if not isinstance(kind, T.ArrayType):
            if e.mode == "one":
                return self._compare(c, kind, "==", e.values[0], absent, present)
            tests = [self._compare(c, kind, "==", v, absent, present) for v in e.values]
            if e.mode == "any":
                return (_any([t for t, _ in tests]), _all([f for _, f in tests])) if tests else (never, always)
            return (_all([t for t, _ in tests]), _any([f for _, f in tests])) if tests else (present, absent)
        element = kind.elementType

        def has(v) -> Column:
            if not _comparable(element, v) or _nan(v):
                return F.lit(False)
            return F.exists(c, lambda x: F.coalesce(x == _literal(element, v), F.lit(False)))

        found = [has(v) for v in e.values]
        if e.mode == "all":
            return (_all([present, *found]), absent | _any([~f for f in found])) if found else (present, absent)
        return (_any(found), absent | _all([~f for f in found])) if found else (never, always)

    def _compare(self, c, kind, op, value, absent, present) -> tuple[Column, Column]:
        never, always = F.lit(False), F.lit(True)
        orderless = op not in ("==", "!=")
        if not _comparable(kind, value) or _nan(value) or (orderless and isinstance(value, bool)):
            return (present, absent) if op == "!=" else (never, always)
        v = _literal(kind, value)
        test = {"==": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
        if op == "!=":
            return test, absent | (c == v)
        if isinstance(kind, _FLOATS):
            return test & ~F.isnan(c), absent | F.isnan(c) | ~test
        return test, absent | ~test


def compile_filter(text: str, schema: T.StructType) -> Column:
    """A column for ``DataFrame.where``."""
    return Compiler({f.name: f.dataType for f in schema.fields}).holds(parse(text))
