"""Many queries against all vectors in one scan, and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput
from ..schema import metric_name

#: Queries that travel to every task: the bound of what is broadcast.
QUERY_BLOCK = 2048
#: Rows that a task holds at a time, and the numbers in them: long vectors make smaller blocks.
ROW_BLOCK, ROW_VALUES = 16384, 1 << 22
#: Queries that pass by a block of rows in one task.
QUERY_STREAM = 65536
#: Distances in a matrix (8 MB), of which a task has four or five copies at once.
TILE = 1 << 20


def score_matrix(metric: str, x: np.ndarray, q: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
    """Distances (queries, rows) in double precision; ``squares``: the rows' squared lengths if they are known."""
    d = q @ x.T
    if metric == "ip":
        return np.negative(d, out=d)
    squares = (x * x).sum(axis=1) if squares is None else squares
    if metric == "cosine":
        both = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt(squares)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            d /= both
        np.subtract(1, d, out=d)
        d[both == 0] = 2.0
        return d
    d *= -2
    d += (q * q).sum(axis=1)[:, None]
    d += squares[None, :]
    return np.sqrt(np.maximum(d, 0, out=d), out=d)


def _exact(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows to one query, each from its row alone, so equal vectors have equal distances."""
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    dots = (x * q).sum(axis=1)
    if metric == "ip":
        return -dots
    both = np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both == 0, 2.0, 1 - dots / both)


def _nearest(metric: str, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and distances of the k nearest of each query by (distance, id)."""
    parts = list(_nearest_tiles(metric, x, ids, q, k))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _nearest_tiles(metric: str, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_nearest`` of so many queries at a time that their distances fill a tile."""
    step, squares = max(1, TILE // max(1, len(ids))), (x * x).sum(axis=1)
    for at in range(0, len(q), step):
        rows, near, d = _nearest_tile(metric, x, ids, q[at : at + step], k, squares)
        yield rows + at, near, d


def _nearest_tile(metric: str, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whatever the matrix form does not put beyond the k-th by more than its rounding is scored again, however many rows
    that are."""
    d = score_matrix(metric, x, q, squares)
    if metric == "l2":
        d *= d  # the root loses digits near 0
    unit = 8 * (x.shape[1] + 8) * np.finfo(float).eps
    with np.errstate(invalid="ignore", over="ignore"):
        far, norms = squares.max(initial=0), (q * q).sum(axis=1)
        margin = unit * (np.ones(len(q)) if metric == "cosine" else norms + far)
    cut = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(q), np.inf)
    rows, near, found = [], [], []
    for i in range(len(q)):
        keep = np.flatnonzero(~(d[i] > cut[i] + margin[i]))
        exact = _exact(metric, x[keep], q[i])
        order = np.lexsort((ids[keep], exact))[:k]
        rows.append(np.full(len(order), i))
        near.append(ids[keep][order])
        found.append(exact[order])
    return np.concatenate(rows), np.concatenate(near), np.concatenate(found)


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """query_id, rank, id, distance: the k nearest of each query (query_id, vector) among vectors (id, vector).

    Up to ``QUERY_BLOCK`` queries go out to all tasks, and each scores its rows against them and sends on k rows a query
    and batch. More queries never pass through the driver: rows are dealt over blocks by a hash, and the queries pass by
    each block in a task of its own. Null vectors are left out.
    """
    metric = metric_name(metric)
    spark, schema = vectors.sparkSession, "query_id long, id long, distance double"
    if k <= 0:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long"), "vector")
    rows = vectors.where(F.col("vector").isNotNull()).select(F.col("id").cast("long"), "vector")
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if not few:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    if len(few) <= QUERY_BLOCK:
        few.sort(key=lambda r: r["query_id"])
        found = _scan(rows, np.array([r["query_id"] for r in few]), np.array([r["vector"] for r in few], float), k, metric, schema)
    else:
        found = _stream(rows, asked, k, metric, schema, len(few[0]["vector"]))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    ranked = found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


def _block_rows(dim: int) -> int:
    return max(1, min(ROW_BLOCK, ROW_VALUES // max(1, dim)))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    if pc.any(pc.not_equal(pc.list_value_length(vectors), dim)).as_py():
        raise InvalidInput("a vector has another dimension than the queries")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)


def _found(metric: str, x: np.ndarray, ids: np.ndarray, names: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for rows, near, d in _nearest_tiles(metric, x, ids, q, k):
        yield pa.RecordBatch.from_arrays([pa.array(names[rows], pa.int64()), pa.array(near, pa.int64()), pa.array(d + 0.0)], ["query_id", "id", "distance"])


def _scan(vectors: DataFrame, names: np.ndarray, q: np.ndarray, k: int, metric: str, schema: str) -> DataFrame:
    dim = q.shape[1]
    size = _block_rows(dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                yield from _found(metric, _matrix(b.column(1), dim), b.column(0).to_numpy(zero_copy_only=False), names, q, k)

    return vectors.mapInArrow(work, schema)


def _stream(vectors: DataFrame, queries: DataFrame, k: int, metric: str, schema: str, dim: int) -> DataFrame:
    """A task holds a block of rows, which come first, and scores the queries against it as they come."""
    n, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = -(-n // _block_rows(dim))
    blocks = -(-blocks // cores) * cores if blocks > cores else max(1, blocks, min(cores, n // QUERY_BLOCK))  # full waves of tasks
    groups = max(1, -(-queries.count() // QUERY_STREAM))

    def dealt(df: DataFrame, ident: str, own: str, many: int, other: str, others: int, later: bool) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64(ident, "vector"), F.lit(many)).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return df.select((F.col("group") * blocks + F.col("block")).alias("pair"), F.lit(later).alias("later"), F.col(ident).alias("name"), "vector")

    rows = dealt(vectors, "id", "block", blocks, "group", groups, False)
    asked = dealt(queries, "query_id", "group", groups, "block", blocks, True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, ids, x = None, [], []
        for b in batches:
            pairs, later = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero((np.diff(pairs) != 0) | (later[1:] != later[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, len(pairs)]):
                if start == end:
                    continue
                if pairs[start] != pair:
                    pair, ids, x = pairs[start], [], []
                part = b.slice(start, end - start)
                names, v = part.column(2).to_numpy(zero_copy_only=False), _matrix(part.column(3), dim)
                if not later[start]:
                    ids.append(names)
                    x.append(v)
                elif x:
                    if len(x) > 1:
                        ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    yield from _found(metric, x[0], ids[0], names, v, k)

    pairs = rows.unionByName(asked).repartitionById(blocks * groups, "pair")
    return pairs.sortWithinPartitions("pair", "later").mapInArrow(work, schema)


def recall_at_k(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """query_id, recall: the share of each query's expected ids that were found. Both have (query_id, id), and each is
    read once."""
    found = actual.select("query_id", "id", F.lit(True).alias("found")).distinct()
    hits = F.count("found") / F.count(F.lit(1))
    return expected.select("query_id", "id").join(found, ["query_id", "id"], "left").groupBy("query_id").agg(hits.alias("recall"))
