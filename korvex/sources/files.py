"""Reading and writing collection data in the formats it travels in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def write_parquet(df: DataFrame, path: str, **options) -> None:
    df.write.options(**options).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One document a line; a line that is no JSON raises."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "true").json(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow IPC file per partition, as binary rows (part, data) of a Parquet table: Spark commits them as one."""
    schema = pa.ipc.read_schema(df.limit(0).toArrow().schema.serialize())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, schema) as w:
            for b in batches:
                w.write_table(pa.Table.from_batches([b]).cast(schema))
        yield pa.RecordBatch.from_pydict({"data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    df.mapInArrow(pack, "data binary").write.parquet(path)


def read_arrow(spark: SparkSession, path: str, schema) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                with pa.ipc.open_file(data.as_buffer()) as r:
                    for i in range(r.num_record_batches):
                        yield r.get_batch(i)

    return spark.read.parquet(path).select("data").mapInArrow(unpack, schema)


def read_flat_vectors(spark: SparkSession, ids_path: str, vectors_path: str, dimension: int, half: bool = False) -> DataFrame:
    """(id, vector) of flat little-endian binaries: int64 ids, and float32 (or float16) components."""
    kind = "<f2" if half else "<f4"
    width = dimension * np.dtype(kind).itemsize

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, data in zip(b["ids"], b["data"], strict=True):
                names = np.frombuffer(ids, "<i8")
                if len(data) != len(names) * width:
                    raise InvalidInput("ids and vectors do not align")
                x = np.frombuffer(data, kind).reshape(len(names), dimension).astype(np.float32)
                for at in range(0, len(names), 4096):
                    yield pd.DataFrame({"id": names[at : at + 4096], "vector": list(x[at : at + 4096])})

    ids = spark.read.format("binaryFile").load(ids_path).select(F.col("content").alias("ids"))
    data = spark.read.format("binaryFile").load(vectors_path).select(F.col("content").alias("data"))
    both = ids.withColumn("k", F.lit(1)).join(data.withColumn("k", F.lit(1)), "k")  # one file each
    return both.select("ids", "data").mapInPandas(split, "id long, vector array<float>")


def positional_take(df: DataFrame, positions: list[int], position_column: str = "row_pos") -> DataFrame:
    """Rows by position, in the order asked; a position that is not there raises."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, int(p)) for i, p in enumerate(positions)], "pos long, __p long")
    out = wanted.join(df, F.col("__p") == F.col(position_column), "left")
    missing = F.raise_error(F.lit("position out of bounds"))
    return out.withColumn("__p", F.when(F.col(position_column).isNull(), missing.cast("long")).otherwise(F.col("__p"))).orderBy("pos").drop("__p")


def ann_dataset(spark: SparkSession, rows: int = 1000, queries: int = 100, dimension: int = 32, seed: int = 20260319, k: int = 10) -> dict[str, DataFrame]:
    """train (id, emb), test (id, emb) and their exact neighbours by cosine (id, neighbors_id)."""
    from ..operators.batch_knn import batch_knn

    rng = np.random.default_rng(seed)
    frame = lambda n: spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "emb": rng.standard_normal((n, dimension)).tolist()}), "id long, emb array<float>")
    train, test = frame(rows), frame(queries)
    near = batch_knn(train.withColumnRenamed("emb", "vector"), test.select(F.col("id").alias("query_id"), F.col("emb").alias("vector")), k, "cosine")
    lists = near.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("neighbors_id"))
    return {"train": train, "test": test, "neighbors": lists}
