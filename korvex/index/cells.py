"""Cell indexes: vectors stored by nearest centroid, and quantised vectors re-ranked exactly.

Cells are a partition column, so probing is an IN filter on it and Spark prunes partitions. Candidates are always scored
with the exact distance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D

#: Rows that centroids are fitted on, of smallest id hash.
FIT_ROWS = 100_000


def fit_centroids(vectors: DataFrame, n: int, seed: int = 42) -> list[list[float]]:
    """k-means over a bounded sample of (id, vector)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors.orderBy(F.xxhash64("id")).limit(FIT_ROWS).select(array_to_vector(D.doubles(F.col("vector"))).alias("features"))
    return [c.tolist() for c in KMeans(k=n, seed=seed, maxIter=10).fit(sample).clusterCenters()]


def nearest_cell(vector: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centroid by L2; ties to the smaller index."""
    options = [F.struct(D.l2(vector, D.vector_literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    return (F.least(*options) if len(options) > 1 else options[0])["i"]


def assign_cells(vectors: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """``vectors`` with ``cell``; many centroids are scored as a matrix product in Arrow batches."""
    if len(centroids) <= 32:
        return vectors.withColumn("cell", nearest_cell(F.col("vector"), centroids))
    table = np.array(centroids)
    squares = (table * table).sum(axis=1)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(np.argmin(squares[None, :] - 2 * x @ table.T, axis=1).astype(np.int32))

    return vectors.withColumn("cell", cell("vector"))


def write_cells(vectors: DataFrame, centroids: list[list[float]], path: str) -> None:
    """``vectors``: id, vector and what else queries need of a row."""
    spark = vectors.sparkSession
    assign_cells(vectors, centroids).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[float]]]:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # nlist rows
    return spark.read.parquet(f"{path}/cells"), [list(r["centroid"]) for r in rows]


def probed_rows(spark: SparkSession, path: str, query: Sequence[float], nprobe: int, metric: str) -> DataFrame:
    """The stored rows of the ``nprobe`` cells nearest to ``query``; Spark prunes the others' folders."""
    stored, centroids = read_cells(spark, path)
    return stored.where(F.col("cell").isin(probe(query, centroids, nprobe, metric))).drop("cell")


def probe(query: Sequence[float], centroids: Sequence[Sequence[float]], nprobe: int, metric: str = "l2") -> list[int]:
    """The cells whose centroids are nearest to the query by the metric, ties to the smaller cell."""
    c, q = np.array(centroids, float), np.array(query, float)
    d = ((c - q) ** 2).sum(axis=1) if metric == "l2" else -(c @ q)
    if metric == "cosine":
        d = d / np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-300)
    return np.lexsort((np.arange(len(d)), d))[:nprobe].tolist()


def search_cells(stored: DataFrame, centroids, query: Sequence[float], k: int, metric: str, nprobe: int) -> DataFrame:
    """id, distance of the k best within the ``nprobe`` nearest cells."""
    rows = stored.where(F.col("cell").isin(probe(query, centroids, nprobe)))
    return rows.select("id", D.distance(metric, F.col("vector"), D.vector_literal(query)).alias("distance")).orderBy("distance", "id").limit(k)


def quantised(vector: Column, low: float, high: float, bits: int = 8) -> Column:
    """Uniform codes 0 .. 2**bits - 1 of each component."""
    top = (1 << bits) - 1
    step = (high - low) / top
    return F.transform(D.doubles(vector), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.floor((x - low) / step + 0.5))).cast("int"))


def dequantised(codes: Column, low: float, high: float, bits: int = 8) -> Column:
    step = (high - low) / ((1 << bits) - 1)
    return F.transform(codes, lambda c: c * F.lit(step) + F.lit(low))


def search_quantised(rows: DataFrame, query: Sequence[float], k: int, metric: str, low: float, high: float, bits: int = 8, rerank_k: int = 64) -> DataFrame:
    """id, distance: the ``rerank_k`` best by codes (columns id, codes, vector), re-ranked by the exact distance."""
    q = D.vector_literal(query)
    rough = rows.withColumn("__r", D.distance(metric, dequantised(F.col("codes"), low, high, bits), q))
    near = rough.orderBy("__r", "id").limit(max(k, rerank_k))
    return near.select("id", D.distance(metric, F.col("vector"), q).alias("distance")).orderBy("distance", "id").limit(k)

