"""Exact maximum inner product search by pivot-table elimination.

Integer vectors are lifted by one coordinate to a common length (queries get 0 there), so the largest inner product is
the smallest Euclidean distance. Every row carries its distances to the pivots; for a query, the largest difference of
pivot distances bounds the distance to a row from below, hence its score from above. Rows are evaluated in the order of
that bound, in growing batches, until no bound reaches the k-th best score. A bound equal to it is still evaluated, and
bounds are loosened by far more than the rounding of doubles, so results are exact, ties included.

Pivots are chosen from a bounded sample (``PIVOT_SAMPLE`` rows of smallest id hash) by farthest-first traversal; every
row is in the table. Defined cases: vectors that are null, hold null or non-finite components, or are not of the
commonest length take no part, nor do rows without an id; rows of one vec_id are all candidates, but none of them for
the query of that id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .vectors import best, cross_blocks, hits_frame, list_matrix, map_vectors, modal_length, packed, top_rows, unpacked

PIVOTS = 128
PIVOT_SAMPLE = 1024
FIRST_BATCH = 256


def quantise(matrix: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(matrix * scale)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal, beginning with the longest vector."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample**2).sum(axis=1)))]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(np.argmax(nearest)))
    return sample[chosen]


def pivot_distances(matrix: np.ndarray, lift: np.ndarray, pivots: np.ndarray, longest: float) -> np.ndarray:
    """Distances of lifted rows to lifted pivots; ``longest``: the square of the common length."""
    pivot_lift = np.sqrt(np.maximum(longest - (pivots**2).sum(axis=1), 0))
    own = (matrix**2).sum(axis=1) + lift**2
    squares = own[:, None] + longest - 2 * (matrix @ pivots.T + lift[:, None] * pivot_lift[None, :])
    return np.sqrt(np.maximum(squares, 0))


def search_block(q_ids, q, q_table, ids, x, table, longest: float, k: int) -> tuple[list, int]:
    """([(query, ids, scores)], rows evaluated)."""
    found, evaluated = [], 0
    table = np.ascontiguousarray(table.T)
    n = len(ids)
    bound, diff = np.empty(n, table.dtype), np.empty(n, table.dtype)
    for i, qid in enumerate(q_ids):
        bound.fill(0)
        for p in range(len(table)):
            np.subtract(table[p], q_table[i, p], out=diff)
            np.abs(diff, out=diff)
            np.maximum(bound, diff, out=bound)
        ceiling = (float(q[i] @ q[i]) + longest) / 2
        slack = 1e-4 * ceiling + 1  # float32 distances are good to 1e-6
        rest, batch = np.arange(n), FIRST_BATCH
        got, score, kth = np.zeros(0, np.int64), np.zeros(0), -np.inf
        while len(rest):
            if batch < len(rest):
                near = np.argpartition(bound[rest], batch)
                now, rest = rest[near[:batch]], rest[near[batch:]]
            else:
                now, rest = rest, rest[:0]
            values = x[now] @ q[i]
            evaluated += len(now)
            other = ids[now] != qid
            got, score = np.concatenate([got, now[other]]), np.concatenate([score, values[other]])
            keep = top_rows(score, ids[got], k)
            got, score = got[keep], score[keep]
            if len(score) == k:
                kth = score[-1]
            rest = rest[ceiling - bound[rest].astype(np.float64) ** 2 / 2 + slack >= kth]
            batch *= 4
        found.append((qid, ids[got], score))
    return found, evaluated


def top_inner_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score (long) of the k largest integer inner products of each vec_id divisible by ``every``."""
    ws = Workspace(vectors.sparkSession, "pivots")
    dim = modal_length(vectors)
    lengths = map_vectors(
        vectors,
        lambda ids, m: [pa.array([float((quantise(m, scale) ** 2).sum(axis=1).max())] if len(m) else [], pa.float64())],
        "longest double",
        ["longest"],
        dim,
    )
    longest = lengths.agg(F.max("longest")).first()[0] or 0.0
    sample = vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE)
    chosen = choose_pivots(quantise(list_matrix(pa.array(sample.toPandas()["embedding"], pa.list_(pa.float64())), dim)[1], scale), pivots)
    width = len(chosen)

    def index(ids, m):
        z = quantise(m, scale)
        lift = np.sqrt(np.maximum(longest - (z**2).sum(axis=1), 0))
        rows = [pivot_distances(z, x, chosen, longest).astype(np.float32) for x in (lift, np.zeros(len(z)))]
        asked = pa.array(ids % every == 0)  # other rows need no distances of their own as a query
        return [pa.array(ids), packed(z), packed(rows[0]), pc.if_else(asked, packed(rows[1]), pa.scalar(None, pa.binary()))]

    table = ws.save(
        map_vectors(vectors, index, "vec_id long, vec binary, far binary, far_query binary", ["vec_id", "vec", "far", "far_query"], dim),
        "table",
    )
    part = F.pmod("vec_id", F.lit(1)).alias("part")  # one group; a literal would turn its equi-joins into nested loops
    queries = table.where(F.col("vec_id") % every == 0).select(part, F.col("vec_id").alias("query_id"), "vec", "far_query")
    rows = table.select(part, "vec_id", "vec", "far")

    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame(hits_frame([], np.int64))
        found, _ = search_block(
            q["query_id"].to_numpy(),
            unpacked(q["vec"], np.float64, dim),
            unpacked(q["far_query"], np.float32, width),
            c["vec_id"].to_numpy(),
            unpacked(c["vec"], np.float64, dim),
            unpacked(c["far"], np.float32, width),
            longest,
            k,
        )
        return pd.DataFrame(hits_frame(found, np.int64))

    return best(cross_blocks(rows, queries, ["part"], work, "query_id long, vec_id long, score long"), k)
