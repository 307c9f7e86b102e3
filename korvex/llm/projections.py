"""Approximate nearest neighbours by cosine over low-dimensional stable projections indexed by kd-trees.

Vectors are scaled to length one and projected on ``DIMS`` Gaussian (2-stable) directions. For two vectors at distance
d, the squared projected distance over d squared follows a chi-square law with ``DIMS`` degrees of freedom. A kd-tree
fitted on a bounded sample (``SAMPLE`` rows) cuts the projected space into cells, and every row is put into its cell;
the rows of a cell get a kd-tree of their own. A query passes by every cell, and every leaf of a cell, whose projected
distance exceeds d_k squared times the chi-square quantile ``CONFIDENCE``, d_k being its k-th best distance so far, and
verifies the rows of the others by their exact cosine: each true neighbour is met with at least that probability. Cells
near the query come first and bound the search of the rest.

Blocks of candidates (a cell, or a part of a large one) and blocks of queries of neighbouring cells are written once as
files below the shared folder. A task reads one block of queries and up to ``SLICE`` blocks of candidates one after the
other, so no vector is shuffled or written again for the cells or queries that it meets: what is stored grows with the
table, not with queries times cells.

Scores are cosines of the original vectors in double precision. Defined cases: vectors that are null, zero, hold null
or non-finite components, or are not of the commonest length take no part, nor do rows without an id; rows of one vec_id
are no candidates for the query of that id; many equal vectors share a cell, which is dealt over sub-blocks; fewer than
k candidates give that many; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, read_bytes, thrifty, thrifty_group, write_bytes
from .vectors import BLOCK, QUERY_BLOCK, best, deal, list_matrix, map_vectors, modal_length, packed, unpacked

DIMS = 16
CONFIDENCE = 0.95
SAMPLE = 20_000
MAX_CELLS = 4096
LEAF = 128
#: Blocks of candidates that a task reads at most, and tasks of a search at most before each takes several of its parts.
SLICE = 64
MAX_TASKS = 10_000
#: Pairs that are scored exactly at once.
PAIRS = 65_536
SEED = 7_654_321


def chi_square_quantile(p: float, dims: int) -> float:
    """Of an even number of degrees of freedom, by bisection of the closed form."""
    if dims % 2:
        raise ValueError("an even number of dimensions is expected")
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - tail(middle) < p else (low, middle)
    return high


def fit_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete kd-tree as a heap of (axis, threshold): each node cuts its widest axis at the median."""
    nodes: list[tuple[int, float]] = []
    level = [points]
    while len(level) < leaves:
        following = []
        for part in level:
            if len(part):
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                cut = float(np.median(part[:, axis]))
            else:
                axis, cut = 0, 0.0
            nodes.append((axis, cut))
            left = part[:, axis] < cut
            following += [part[left], part[~left]]
        level = following
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each point."""
    at = np.zeros(len(points), np.int64)
    axes, cuts = np.array([a for a, _ in nodes], np.int64), np.array([c for _, c in nodes])
    depth = int(math.log2(len(nodes) + 1)) if nodes else 0
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] >= cuts[at])
    return at - len(nodes)


def local_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the points leaf by leaf, leaf starts) of a balanced kd-tree; equal points may share leaves or not."""
    parts = [np.arange(len(points))]
    while len(parts[0]) > LEAF:
        following = []
        for part in parts:
            axis = int(np.argmax(np.ptp(points[part], axis=0)))
            half = len(part) // 2
            split = np.argpartition(points[part, axis], half)
            following += [part[split[:half]], part[split[half:]]]
        parts = following
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(low[None, :, d] - points[:, None, d], points[:, None, d] - high[None, :, d])
        np.maximum(gap, 0, out=gap)
        out += gap * gap
    return out


def as_file(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def of_file(uri: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(read_bytes(uri)), allow_pickle=False) as f:
        return {name: f[name] for name in f.files}


def lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def candidate_file(ids: np.ndarray, x: np.ndarray, directions: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(a block's file, its box): rows in the order of the block's own kd-tree, with the boxes of its leaves."""
    m = x.astype(np.float64)
    proj = (m / lengths(m)[:, None]) @ directions
    order, starts = local_tree(proj)
    proj = proj[order]
    low, high = np.minimum.reduceat(proj, starts[:-1]), np.maximum.reduceat(proj, starts[:-1])
    return as_file(ids=ids[order], x=x[order], starts=starts, low=low, high=high), low.min(axis=0), high.max(axis=0)


class Search:
    """The ``k`` best rows so far of each query of a block. ``floor`` and ``floor_id``: score and vec_id of the k-th
    known before; only better rows are taken."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, directions: np.ndarray, k: int, quantile: float, floor=None, floor_id=None):
        self.ids, self.x, self.k, self.quantile = ids, x.astype(np.float64), k, quantile
        self.norms = lengths(self.x)
        unit = self.x / self.norms[:, None]
        self.proj, self.unit = unit @ directions, unit.astype(np.float32)
        # what a score of single precision may lack
        self.slack = (x.shape[1] + 8) * 2.4e-7
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.floor_id = np.full(len(ids), np.iinfo(np.int64).max) if floor_id is None else floor_id
        self.query, self.vec, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def reach(self) -> np.ndarray:
        """The largest squared projected distance at which each query still looks."""
        return (np.maximum(0.0, 2 - 2 * self.floor) + 1e-12) * self.quantile

    def visit(self, block: dict[str, np.ndarray]) -> None:
        ids, x, starts = block["ids"], block["x"].astype(np.float64), block["starts"]
        norms = lengths(x)
        unit = (x / norms[:, None]).astype(np.float32)
        boxes = box_distances(self.proj, block["low"], block["high"])
        held, size = [], 0
        for leaf in np.argsort(boxes.mean(axis=0), kind="stable"):
            a, b = starts[leaf], starts[leaf + 1]
            asked = np.flatnonzero(boxes[:, leaf] <= self.reach())
            if not len(asked):
                continue
            near = (self.unit if len(asked) == len(self.unit) else self.unit[asked]) @ unit[a:b].T
            least = (self.floor[asked] - self.slack).astype(np.float32)
            hit = near >= least[:, None]
            if np.count_nonzero(hit) > 2 * self.k * len(asked) and b - a > self.k:  # few bounds are known yet
                near[self.ids[asked][:, None] == ids[a:b][None, :]] = -np.inf
                kth = np.partition(near, b - a - self.k, axis=1)[:, b - a - self.k]
                hit = near >= np.maximum(least, kth - np.float32(2 * self.slack))[:, None]
            row, col = np.divmod(np.flatnonzero(hit), b - a)
            held.append((asked[row], a + col))
            size += len(row)
            if size >= self.k * len(self.ids):
                self.take(held, ids, x, norms)
                held, size = [], 0
        if size:
            self.take(held, ids, x, norms)

    def take(self, held: list, ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        query, row = (np.concatenate(c) for c in zip(*held, strict=True))
        other = ids[row] != self.ids[query]
        query, row = query[other], row[other]
        score = np.zeros(len(row))
        for i in range(0, len(row), PAIRS):
            q, r = query[i : i + PAIRS], row[i : i + PAIRS]
            score[i : i + PAIRS] = (x[r] * self.x[q]).sum(axis=1) / (norms[r] * self.norms[q])
        vec = ids[row]
        better = (score > self.floor[query]) | ((score == self.floor[query]) & (vec < self.floor_id[query]))
        if not better.any():
            return
        query, vec, score = (np.concatenate([old, new[better]]) for old, new in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.floor[query[last]], self.floor_id[query[last]] = score[last], vec[last]
        self.query, self.vec, self.score = query[rank < self.k], vec[rank < self.k], score[rank < self.k]

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.query], "vec_id": self.vec, "score": self.score})


def nearest_by_cosine(vectors: DataFrame, every: int = 50, k: int = 5, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "projections")
    dim = modal_length(vectors)
    directions = np.random.default_rng(SEED).standard_normal((dim, DIMS))
    quantile = chi_square_quantile(confidence, DIMS)

    def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.sqrt((m * m).sum(axis=1))
        whole = (norms > 0) & np.isfinite(norms)
        return whole, (m[whole] / norms[whole, None]) @ directions

    rows = vectors.where((F.size("embedding") == dim) & F.col("vec_id").isNotNull())
    total = rows.count()
    # the rows of the smallest hashes; only some more than needed are put in order
    hashed = F.xxhash64("vec_id")
    few = rows.where(hashed < int((4 * SAMPLE / total - 1) * 2**63)) if total > 8 * SAMPLE else rows
    sample = few.orderBy(hashed, "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    points = scaled(list_matrix(pa.array(sample, pa.list_(pa.float64())), dim)[1])[1]
    leaves = min(MAX_CELLS, 1 << max(0, math.ceil(math.log2(max(1, total / BLOCK)))))
    tree = fit_tree(points, leaves)
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType == T.FloatType() else np.float64

    def index(ids, m):
        whole, proj = scaled(m)
        return [pa.array(ids[whole]), packed(m[whole].astype(kind)), pa.array(route(proj, tree).astype(np.int32))]

    indexed = ws.save(map_vectors(vectors, index, "vec_id long, vec binary, cell int", ["vec_id", "vec", "cell"], dim), "index")

    # blocks of candidates and of queries, each a file
    sides = [f"{s}{d}" for s in "lh" for d in range(DIMS)]
    folders = ws.path("blocks"), ws.path("asked")

    def put_candidates(key, pdf: pd.DataFrame) -> pd.DataFrame:
        data, low, high = candidate_file(pdf["vec_id"].to_numpy(), unpacked(pdf["vec"], kind, dim), directions)
        write_bytes(uri := f"{folders[0]}/{key[0]}-{key[1]}.npz", data)
        return pd.DataFrame([(uri, *key, *low, *high)], columns=["uri", "cell", "c_sub", *sides])

    dealt = deal(indexed, ["cell"], "vec_id", BLOCK, "c_sub").groupBy("cell", "c_sub")
    blocks = dealt.applyInPandas(thrifty_group(put_candidates), "uri string, cell int, c_sub int, " + ", ".join(f"{c} double" for c in sides))
    blocks = ws.save(blocks, "block-list").orderBy("cell", "c_sub").toPandas()

    # queries of neighbouring cells share a block
    queries = indexed.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    busy = 4 * spark.sparkContext.defaultParallelism
    regions = min(leaves, max(busy, queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("region", F.floor(F.col("cell") * F.lit(regions) / leaves).cast("int"))

    def put_queries(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.unique(pdf["cell"].to_numpy())
        data = as_file(ids=pdf["query_id"].to_numpy(), x=unpacked(pdf["vec"], kind, dim), cells=cells)
        write_bytes(uri := f"{folders[1]}/{key[0]}-{key[1]}.npz", data)
        return pd.DataFrame([(uri, *key)], columns=["uri", "region", "q_sub"])

    dealt = deal(queries, ["region"], "query_id", QUERY_BLOCK, "q_sub").groupBy("region", "q_sub")
    asked = ws.save(dealt.applyInPandas(thrifty_group(put_queries), "uri string, region int, q_sub int"), "asked-list")
    asked = [r["uri"] for r in asked.orderBy("region", "q_sub").collect()]
    ws.drop("index")

    uris, cell, first_part = blocks["uri"].tolist(), blocks["cell"].to_numpy(), blocks["c_sub"].to_numpy() == 0
    low, high = blocks[[f"l{d}" for d in range(DIMS)]].to_numpy(), blocks[[f"h{d}" for d in range(DIMS)]].to_numpy()
    schema = "query_id long, vec_id long, score double"

    def look(search: Search, which: np.ndarray) -> None:
        for i in which:
            if (box_distances(search.proj, low[i : i + 1], high[i : i + 1])[:, 0] <= search.reach()).any():
                search.visit(of_file(uris[i]))

    def home(cells: np.ndarray) -> np.ndarray:
        """One block of each cell that holds queries of a block."""
        return np.isin(cell, cells) & first_part

    def near(batches):
        for b in batches:
            for task in b["id"]:
                q = of_file(asked[task])
                search = Search(q["ids"], q["x"], directions, k, quantile)
                look(search, np.flatnonzero(home(q["cells"])))
                write_bytes(f"{asked[task]}.floor", as_file(floor=search.floor, floor_id=search.floor_id))
                yield search.found()

    def tasks(n: int) -> DataFrame:
        return spark.range(0, n, 1, max(1, min(n, MAX_TASKS)))

    first = ws.save(tasks(len(asked)).mapInPandas(thrifty(near), schema), "first")
    width = max(1, min(SLICE, len(asked) * len(uris) // busy))
    slices = -(-len(uris) // width)

    def far(batches):
        for b in batches:
            for task in b["id"]:
                uri, part = asked[task // slices], task % slices
                q, bound = of_file(uri), of_file(f"{uri}.floor")
                search = Search(q["ids"], q["x"], directions, k, quantile, **bound)
                mine = np.arange(part * width, min(len(uris), (part + 1) * width))
                look(search, mine[~home(q["cells"])[mine]])
                yield search.found()

    second = ws.save(tasks(len(asked) * slices).mapInPandas(thrifty(far), schema), "second")
    ws.drop("blocks", "asked")
    return best(first.unionByName(second), k)
