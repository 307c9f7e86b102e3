"""Ranks, top-k and grouping without putting a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window


#: Rows of the sample for each bucket that bounds of buckets are picked from.
BUCKET_SAMPLE = 32


def _bounds(df: DataFrame, columns: list[str], n: int) -> list[Row]:
    """At most n - 1 keys in order that split the rows about evenly, as a sample has them; no rank depends on the sample."""
    share = min(1.0, BUCKET_SAMPLE * n / max(1, df.count()))
    keys = df.select(*columns) if share == 1 else df.select(*columns).sample(share, seed=7)
    keys = keys.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("k")).first()["k"]
    picked = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    return [k for i, k in enumerate(picked) if i == 0 or k != picked[i - 1]]


def _bucket(df: DataFrame, columns: list[str], bounds: list[Row]) -> Column:
    """How many of the bounds lie below a row's key, by halving: a step for each bit of their number."""
    if not bounds:
        return F.lit(0)
    key = F.struct(*columns)
    table = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(columns, b)]) for b in bounds]).cast(ArrayType(df.select(key).schema[0].dataType))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) < key, at + s).otherwise(at))  # beyond the table: null


def global_rank(df: DataFrame, value: str, ties: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """``out``: 1-based rank by (value, *ties) over all rows; ``value`` is numeric and not null.

    Rows are bucketed by (value, *ties) at bounds from a sample, so rows of one value are divided too, ranked within
    buckets, and shifted by the sizes of the buckets below: the only table that one task sees whole has a row per bucket.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [value, *ties]
    dealt = df.withColumn("__bucket", _bucket(df, columns, _bounds(df, columns, n) if n > 1 else []))
    sizes = dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__below"))
    inside = Window.partitionBy("__bucket").orderBy(value, *ties)
    ranked = dealt.withColumn("__in", F.row_number().over(inside))
    # a row per bucket: n rows at most
    joined = ranked.join(F.broadcast(offsets), "__bucket").withColumn(out, (F.col("__below") + F.col("__in")).cast("long"))
    return joined.drop("__bucket", "__in", "__below")


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows; plans as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(max(0, k))


def with_rank(df: DataFrame, *order: Column | str) -> DataFrame:
    """``rank`` from 1 over a result that top_k has bounded."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def best_per_group(df: DataFrame, group: str, order: list[Column], per_group: int, groups: int) -> DataFrame:
    """At most ``per_group`` rows (0: 1) of each group in the given order, of the first ``groups`` groups (0: all), groups
    being ranked by their first row. Nulls are one group."""
    keep = max(1, per_group)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    rows = df.withColumn("__place", place).where(F.col("__place") <= keep)
    if groups > 0:
        chosen = rows.where("__place = 1").orderBy(*order).limit(groups).select(F.col(group).alias("__group"))
        rows = rows.join(chosen, F.col(group).eqNullSafe(F.col("__group")), "left_semi")
    return rows.drop("__place")
