"""Structured Streaming into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store.collection import Collection


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, seq: str | None = None, deleted: str | None = None):
    """A writer that applies each micro-batch: the newest row per id (by ``seq``) is upserted, or deleted where the
    ``deleted`` column says so. Start it with ``.trigger(...).start()``."""

    def apply(batch: DataFrame, _: int) -> None:
        columns = [c for c in batch.columns if c not in (seq, deleted)]
        rows = batch
        if seq is not None:
            row = F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), F.col(seq)).alias("__r")
            rows = batch.groupBy("id").agg(row).select("id", "__r.*")
        rows = rows.persist()
        collection.refresh()
        if deleted is not None:
            collection.delete(rows.where(F.col(deleted)).select("id"))
            kept = rows.where(~F.col(deleted))
        else:
            kept = rows
        kept = kept.select(*columns)
        if not kept.isEmpty():
            collection.upsert(kept)
        rows.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
