"""Sparse vectors as postings: one row per (index, id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_postings(vectors: DataFrame) -> DataFrame:
    """(index, id, value) of (id, vector)."""
    pairs = F.explode(F.arrays_zip(F.col("vector.indices").alias("index"), F.col("vector.values").alias("value"))).alias("p")
    return vectors.select("id", pairs).select(F.col("p.index").alias("index"), "id", F.col("p.value").cast("double").alias("value"))


def search_postings(postings: DataFrame, query: dict[int, float], k: int) -> DataFrame:
    """id, distance: minus the largest positive inner products; the query's indexes prune the postings read."""
    spark = postings.sparkSession
    terms = spark.createDataFrame([(int(i), float(w)) for i, w in sorted(query.items())], "index long, weight double")
    sums = postings.where(F.col("index").isin([int(i) for i in query])).join(F.broadcast(terms), "index")  # the query's own terms
    scores = sums.groupBy("id").agg((-F.sum(F.col("value") * F.col("weight"))).alias("distance")).where("distance < 0")
    return scores.orderBy("distance", "id").limit(k)


def search_bm25(postings: DataFrame, query: list[int], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, distance: minus published BM25 over term counts; document lengths and frequencies come from all postings."""
    lengths = postings.groupBy("id").agg(F.sum("value").alias("len"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl")).first()
    if not totals["n"]:
        return postings.select("id", F.col("value").alias("distance")).limit(0)
    hits = postings.where(F.col("index").isin([int(i) for i in query]))
    df = hits.groupBy("index").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((totals["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("value")
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(totals["avgdl"])))
    scores = hits.join(F.broadcast(df), "index").join(lengths, "id").groupBy("id").agg((-F.sum(part)).alias("distance"))
    return scores.orderBy("distance", "id").limit(k)
