"""Distances as Spark columns: smaller is better. Arithmetic is in doubles whatever the stored type."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import metric_name


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def ip(a: Column, b: Column) -> Column:
    return -dot(a, b) + F.lit(0.0)


def cosine(a: Column, b: Column) -> Column:
    """One minus the cosine; 2 if either vector has length zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(2.0)).otherwise(1 - dot(a, b) / both)


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"l2": l2, "ip": ip, "cosine": cosine}[metric_name(metric)](a, b)


def sparse_ip(vector: Column, query: dict[int, float]) -> Column:
    """Minus the inner product of a sparse column with a sparse query; 0 if no index is shared."""
    if not query:
        return F.when(vector.isNotNull(), F.lit(0.0))
    table = F.create_map(*[F.lit(x) for k, v in sorted(query.items()) for x in (int(k), float(v))])
    weights = F.zip_with(
        vector["indices"], vector["values"], lambda i, v: F.coalesce(F.try_element_at(table, i.cast("long")), F.lit(0.0)) * v.cast("double")
    )
    return F.when(vector.isNotNull(), -_sum(weights) + F.lit(0.0))


def bm25(vector: Column, query: dict[int, float], avgdl: float, k1: float = 1.2, b: float = 0.75) -> Column:
    """Minus the published BM25 sum over shared terms, ``values`` being term counts and the query's weights carrying
    idf."""
    if not query:
        return F.when(vector.isNotNull(), F.lit(0.0))
    table = F.create_map(*[F.lit(x) for k, v in sorted(query.items()) for x in (int(k), float(v))])
    length = _sum(F.transform(vector["values"], lambda v: v.cast("double")))
    parts = F.zip_with(
        vector["indices"],
        vector["values"],
        lambda i, v: F.coalesce(F.try_element_at(table, i.cast("long")), F.lit(0.0))
        * v.cast("double")
        * (k1 + 1)
        / (v.cast("double") + k1 * (1 - b + b * length / avgdl)),
    )
    return F.when(vector.isNotNull(), -_sum(parts) + F.lit(0.0))


def similarity(metric: str, d: Column) -> Column:
    """A distance brought to 0..1, larger is better, for weighted fusion."""
    name = str(metric).lower()
    if name == "l2":
        return 1 - 2 * F.atan(d) / math.pi
    if name == "ip":
        return 0.5 - F.atan(d) / math.pi
    if name == "cosine":
        return 1 - d / 2
    return 1 - d
