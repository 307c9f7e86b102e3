"""Vectors as packed bytes, and the block scheme that both searches run on.

A search pairs blocks of candidates with blocks of queries. Both sides are dealt by a hash of their id over as many
sub-blocks as their group's size asks for, so a task holds at most about ``BLOCK`` candidates and ``QUERY_BLOCK``
queries whatever the table's size or skew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 16384
QUERY_BLOCK = 4096


def modal_length(vectors: DataFrame, column: str = "embedding") -> int:
    """The commonest vector length; rows of another length cannot be compared with it and take no part."""
    row = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return int(row["n"]) if row else 0


def list_matrix(array: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are whole: not null, of length ``dim``, all components finite; their matrix as double)."""
    lengths = pc.fill_null(pc.list_value_length(array), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    flat = array.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(rows), dim)
    whole = np.isfinite(matrix).all(axis=1)
    return rows[whole], matrix[whole]


def packed(matrix: np.ndarray) -> pa.Array:
    """One binary value a row."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize if matrix.ndim == 2 else matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def unpacked(values, dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype).reshape(-1, dim)


def deal(df: DataFrame, group: list[str], ident: str, size: int, sub: str) -> DataFrame:
    """``df`` with ``sub`` and ``n_<sub>``: rows of each group dealt over ceil(rows / size) sub-blocks."""
    counts = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"n_{sub}"))
    return df.join(counts, group).withColumn(sub, F.pmod(F.xxhash64(F.lit(7), ident), F.col(f"n_{sub}")).cast("int"))


def cross_blocks(
    candidates: DataFrame, queries: DataFrame, group: list[str], work: Callable, schema: str, block: int = BLOCK
) -> DataFrame:
    """``work(queries, candidates)`` (pandas frames) of every pair of a candidate block and a query block of a group."""
    candidates = candidates.select(*[F.col(x).alias(x) for x in candidates.columns])  # both sides may stem from one table
    c = deal(candidates, group, "vec_id", block, "c_sub")
    q = deal(queries, group, "query_id", QUERY_BLOCK, "q_sub")
    n_c = c.groupBy(*group).agg(F.max("n_c_sub").alias("__n"))
    n_q = q.groupBy(*group).agg(F.max("n_q_sub").alias("__n"))
    spread = lambda df, n, name: df.join(n, group).withColumn(name, F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    left, right = spread(q, n_c, "c_sub"), spread(c, n_q, "q_sub")
    keys = [*group, "c_sub", "q_sub"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, schema)


def best(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def hits_frame(found: list[tuple[int, np.ndarray, np.ndarray]], score_type) -> dict:
    query = np.concatenate([np.full(len(v), q, np.int64) for q, v, _ in found] or [np.zeros(0, np.int64)])
    vec = np.concatenate([v for _, v, _ in found] or [np.zeros(0, np.int64)])
    score = np.concatenate([s for _, _, s in found] or [np.zeros(0)]).astype(score_type)
    return {"query_id": query, "vec_id": vec, "score": score}


def map_vectors(vectors: DataFrame, fn: Callable[[np.ndarray, np.ndarray], list[pa.Array]], schema: str, names: list[str], dim: int) -> DataFrame:
    """``fn(ids, matrix)`` over the whole vectors with an id; it returns the columns ``names``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            batch = batch.filter(ids.is_valid())
            rows, matrix = list_matrix(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(fn(ids, matrix), names)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(work, schema)
