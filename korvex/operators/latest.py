"""Reading a versioned log: the newest row of every id, unless it is a tombstone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _heads(log: DataFrame, id_column: str, seq_column: str, *more: str) -> DataFrame:
    """(id, largest sequence number, more columns of that row): narrow, aggregated before its shuffle."""
    last = [F.max_by(c, seq_column).alias(f"__{c}") for c in more]
    return log.groupBy(F.col(id_column).alias("__id")).agg(F.max(seq_column).alias("__seq"), *last)


def _kept(log: DataFrame, heads: DataFrame, id_column: str, seq_column: str) -> DataFrame:
    return log.join(heads.select("__id", "__seq"), (F.col(id_column) == F.col("__id")) & (F.col(seq_column) == F.col("__seq")), "left_semi")


def newest(log: DataFrame, id_column: str = "id", seq_column: str = "op_seq") -> DataFrame:
    """One row per id: that of the largest sequence number ((id, sequence number) names a row). Ids and sequence numbers
    are aggregated alone and semi-joined back, so columns that are not asked for are never read and filters reach the
    scan."""
    return _kept(log, _heads(log, id_column, seq_column), id_column, seq_column)


def latest_live(log: DataFrame, id_column: str = "id", seq_column: str = "op_seq", deleted_column: str = "is_deleted") -> DataFrame:
    heads = _heads(log, id_column, seq_column, deleted_column).where(~F.col(f"__{deleted_column}"))
    return _kept(log, heads, id_column, seq_column)


def log_stats(log: DataFrame, id_column: str = "id", seq_column: str = "op_seq", deleted_column: str = "is_deleted") -> DataFrame:
    """record_count, deleted_count, live_count over ids."""
    rows = _heads(log, id_column, seq_column, deleted_column).withColumnRenamed(f"__{deleted_column}", deleted_column)
    return rows.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(F.sum(F.col(deleted_column).cast("long")), F.lit(0)).alias("deleted_count"),
        F.coalesce(F.sum((~F.col(deleted_column)).cast("long")), F.lit(0)).alias("live_count"),
    )


#: Wanted ids up to so many are broadcast, 16 bytes each.
FETCH_BROADCAST = 100_000


def fetch(live: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of the wanted ids in their order, repeats repeated, missing ones left out."""
    spark = live.sparkSession
    wanted = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "pos long, __want long")
    wanted = F.broadcast(wanted) if len(ids) <= FETCH_BROADCAST else wanted
    return live.join(wanted, F.col("id") == F.col("__want")).drop("__want").orderBy("pos")
