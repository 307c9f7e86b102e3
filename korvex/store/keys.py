"""Public string keys of documents.

A collection begins in numeric mode: keys are decimal ids. The first key that is no number switches it to string mode
for good; ids that exist are then registered under their decimal strings.
"""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..operators.ranking import global_rank

if TYPE_CHECKING:
    from .collection import Collection

_NUMBER = r"^-?[0-9]{1,19}$"


def assign_ids(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(key, id) of the distinct ``keys``: the known id, or the next ones after the largest in key order.

    New keys are numbered by a bucketed global rank of their hash, so no task sees them all.
    """
    wanted = keys.select("key").distinct()
    old = wanted.join(known, "key")
    new = wanted.join(known.select("key"), "key", "left_anti").withColumn("__h", F.xxhash64("key"))
    top = known.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top")).first()["top"]
    numbered = global_rank(new, "__h", ["key"], "__n").select("key", (F.lit(top) + F.col("__n")).cast("long").alias("id"))
    return old.unionByName(numbered)


class KeyTable:
    def __init__(self, collection: Collection):
        self.c = collection

    @property
    def mode(self) -> str:
        return self.c.manifest["key_mode"]

    def table(self) -> DataFrame:
        names = self.c.manifest.get("keys", [])
        if not names:
            return self.c.spark.createDataFrame([], "key string, id long")
        return self.c.spark.read.schema("key string, id long").parquet(*[f"{self.c.path}/keys/{n}" for n in names])

    def _store(self, rows: DataFrame, **changes) -> None:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.c.path}/keys/{name}")
        self.c._commit(False, keys=[*self.c.manifest.get("keys", []), name], **changes)

    def assign(self, keys: DataFrame) -> DataFrame:
        """(key, id) of every key, registering what is new."""
        if self.mode == "numeric":
            if keys.where(~F.col("key").rlike(_NUMBER)).isEmpty():
                return keys.select("key", F.col("key").cast("long").alias("id"))
            self._store(self.c.live().select(F.col("id").cast("string").alias("key"), "id"), key_mode="string")
        known = self.table()
        fresh = assign_ids(keys, known).join(known.select("key"), "key", "left_anti")
        self._store(fresh)
        return self.resolve(keys)

    def resolve(self, keys: DataFrame) -> DataFrame:
        """(key, id) of the keys that exist; in numeric mode a key that is no number is an error."""
        if self.mode == "numeric":
            if not keys.where(~F.col("key").rlike(_NUMBER)).isEmpty():
                raise InvalidInput("a key is no number")
            return keys.select("key", F.col("key").cast("long").alias("id"))
        return keys.select("key").join(self.table(), "key")

    def display(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their public ``key``."""
        if self.mode == "numeric":
            return rows.withColumn("key", F.col("id").cast("string"))
        return rows.join(self.table(), "id", "left")
