"""Fusing the distances of several sources into one score per document. Larger scores are better."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import similarity
from .ranking import global_rank


def ranked_sources(df: DataFrame, sources: dict[str, str], per_source_k: int | None) -> dict[str, DataFrame]:
    """For each source (name: distance column) its rows (id, distance), cut to the k best if asked."""
    out = {}
    for name, column in sources.items():
        own = df.where(F.col(column).isNotNull()).select("id", F.col(column).alias("distance"))
        out[name] = own.orderBy("distance", "id").limit(per_source_k) if per_source_k else own
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reciprocal_rank(sources: dict[str, DataFrame], constant: int) -> DataFrame:
    """(id, fused_score); a document that a source lacks gets nothing from it."""
    parts = [global_rank(s, "distance", ["id"], "__r").select("id", (1.0 / (constant + F.col("__r"))).alias("s")) for s in sources.values()]
    return _union(parts).groupBy("id").agg(F.sum("s").alias("fused_score"))


def weighted(sources: dict[str, DataFrame], metrics: dict[str, str], weights: dict[str, float], override: str | None) -> DataFrame:
    parts = []
    for name, s in sources.items():
        weight = weights.get(name, weights.get(name.split("#")[0], 1.0))
        parts.append(s.select("id", (F.lit(float(weight)) * similarity(override or metrics[name], F.col("distance"))).alias("s")))
    return _union(parts).groupBy("id").agg(F.sum("s").alias("fused_score"))
