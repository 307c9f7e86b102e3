"""The filter language against a plain evaluator."""

import math
import random

import pytest
from pyspark.sql import types as T

from korvex.errors import InvalidInput
from korvex.plans import filters as X

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("s", T.StringType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("d", T.DoubleType()),
    T.StructField("b", T.BooleanType()),
    T.StructField("a", T.ArrayType(T.StringType())),
])
TEXTS = ["", "a", "ab", "a%b", "a\\b", 'q"q', "é", "aé_b", None]


def data():
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    return [
        (k, pick(*TEXTS), pick(None, -1, 0, 1, 5), pick(None, math.nan, -0.0, 0.0, 1.5, 5.0), pick(None, True, False), pick(None, [], ["a"], ["a", None], ["ab", "é"]))
        for k in range(120)
    ]


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    return (number(a) and number(b) or isinstance(a, str) and isinstance(b, str)) and a == b


def like(s, p):
    if not p:
        return not s
    if p[0] == "%":
        return any(like(s[k:], p[1:]) for k in range(len(s) + 1))
    return bool(s) and (p[0] in ("_", s[0])) and like(s[1:], p[1:])


def matches(e, row):
    if isinstance(e, X.And):
        return all(matches(p, row) for p in e.parts)
    if isinstance(e, X.Or):
        return any(matches(p, row) for p in e.parts)
    if isinstance(e, X.Not):
        return not matches(e.part, row)
    v = row.get(e.field)
    if isinstance(e, X.IsNull):
        return (v is None) != e.negated
    if isinstance(e, X.Compare):
        if v is None:
            return False
        if e.op == "==":
            return same(v, e.value)
        if e.op == "!=":
            return not same(v, e.value)
        if not (number(v) and number(e.value) or isinstance(v, str) and isinstance(e.value, str)):
            return False
        return {">": v > e.value, ">=": v >= e.value, "<": v < e.value, "<=": v <= e.value}[e.op]
    if isinstance(e, X.In):
        return (v is not None and any(same(v, x) for x in e.values)) != e.negated
    if isinstance(e, X.Text):
        if v is None:
            return e.negated
        if not isinstance(v, str):
            return False
        hit = {"like": like(v, e.pattern), "has_prefix": v.startswith(e.pattern), "has_suffix": v.endswith(e.pattern)}[e.kind]
        return hit != e.negated
    if v is None:
        return False
    own = v if isinstance(v, list) else [v]
    found = [any(x is not None and same(x, w) for x in own) for w in e.values]
    return any(found) if e.mode in ("one", "any") else all(found)


CLAUSES = [
    's == "a"', 's != "a"', 's > "a"', "s == 5", "s != 5", "s < 5", "i == 1", "i != 1", "i >= 0", "i < 1.5", "i in (1, 5)", "i not in (0)", "i in ()", "i == true",
    "d > 0", "d == 0", "d != 1.5", "d <= 1.5", "d in (1.5, 0)", "d not in (5.0)", "d == nan", "d != nan", "b == true", "b != false", "b > false", "s is null",
    "d is not null", 's like "a%"', 's like "%b"', 's like "a_b"', 's not like "%\\\\%"', 's like "%"', 's has_prefix "a"', 's not has_prefix a', 's has_suffix "b"',
    "s not has_suffix b", 'i like "1"', 'i not like "1"', 'a contains "a"', 'a contains any ("a", "é")', 'a contains all ("ab", "é")', "a contains all ()", "a contains any ()",
    "a == 5", 'a != "a"', "i contains 5", "x == 1", "x != 1", "x not in (1)", "x is null", 'x not like "a"', "i > 1e0", "i == +1",
]


def expression(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(CLAUSES)
    kind = rng.choice(["and", "or", "not", "("])
    if kind == "not":
        return f"not ({expression(rng, depth - 1)})"
    if kind == "(":
        return f"({expression(rng, depth - 1)})"
    return f"{expression(rng, depth - 1)} {kind} {expression(rng, depth - 1)}"


def test_random_filters_match_the_evaluator(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).cache()
    names = SCHEMA.names
    rng = random.Random(7)
    texts = CLAUSES + [f"not {c}" for c in CLAUSES] + [expression(rng, 3) for _ in range(60)]
    columns = []
    from pyspark.sql import functions as F

    for k, t in enumerate(texts):
        columns.append(F.coalesce(X.compile_filter(t, SCHEMA), F.lit(False)).alias(f"c{k}"))
    got = {r["id"]: r for r in df.select("id", *columns).collect()}
    for row in rows:
        record = dict(zip(names, row, strict=True))
        for k, t in enumerate(texts):
            assert got[row[0]][f"c{k}"] == matches(X.parse(t), record), (t, record)


@pytest.mark.parametrize("text", ["", "  ", "a = 1", "a ==", "a == 1 b", "(a == 1", "a in (1", 'a == "x', "a AND b", "a is", "a contains_any (1)", "a == word"])
def test_bad_filters_raise(text):
    with pytest.raises(InvalidInput):
        X.parse(text)


def test_pushdown_and_fields(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    plan = part.where(X.compile_filter('p_size > 5 and not (p_brand == "Brand#13")', part.schema)).select("p_partkey")._jdf.queryExecution().toString()
    assert "GreaterThan(p_size,5)" in plan and "Not(EqualTo(p_brand,Brand#13))" in plan and "p_name" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert X.referenced_fields(X.parse("a == 1 or not (b in (2)) and c is null")) == {"a", "b", "c"}
