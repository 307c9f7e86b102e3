"""Which indexes a field may have, and building them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, NotFound
from ..schema import CollectionSchema
from . import cells, postings

#: Allowed parameters with their defaults. Graph kinds are served by cells and exact scoring: Spark has no graph index.
KINDS: dict[str, dict[str, object]] = {
    "flat": {},
    "hnsw": {"m": 16, "ef_construction": 128, "quantize_type": "undefined"},
    "hnsw_sq": {"m": 16, "ef_construction": 200, "ef_search": 50},
    "hnsw_hvq": {"m": 16, "m_max0": 32, "ef_construction": 100, "ef_search": 64, "nbits": 4},
    "ivf": {"nlist": 1024, "nprobe": 32},
    "ivf_usq": {"nlist": 1024, "bits_per_dim": 4, "rotation_seed": 42, "rerank_k": 64, "high_accuracy": False},
    "sparse": {"metric": "ip", "k1": 1.2, "b": 0.75, "avgdl": 1.0},
    "sparse_wand": {"metric": "ip", "k1": 1.2, "b": 0.75, "avgdl": 1.0},
    "inverted": {"enable_range_optimization": False, "enable_extended_wildcard": False},
}


def check_index(schema: CollectionSchema, name: str, kind: str, params: dict) -> None:
    if kind not in KINDS:
        raise InvalidInput(f"unknown index kind {kind!r}")
    for key, value in params.items():
        if key not in KINDS[kind]:
            raise InvalidInput(f"{kind} takes no parameter {key!r}")
        if isinstance(value, (int, float)) and not isinstance(value, bool) and key != "rotation_seed" and value <= 0:
            raise InvalidInput(f"{key} must be positive")
    if kind == "inverted":
        if schema.field(name) is None:
            raise NotFound(f"no field {name!r}")
        return
    v = schema.vector(name)
    if v.sparse != kind.startswith("sparse"):
        raise InvalidInput(f"{kind} does not fit field {name!r}")
    if kind == "hnsw_hvq" and schema.metric_of(name) != "ip":
        raise InvalidInput("hnsw_hvq needs the metric ip")


#: Kinds that are served by cells.
CELLS = ("ivf", "ivf_usq", "hnsw", "hnsw_sq", "hnsw_hvq")


def index_path(collection, name: str) -> str:
    return f"{collection.path}/index/{name}/{collection.manifest['data_version']}"


def candidates(collection, name: str, query: list[float], nprobe: int | None, metric: str) -> DataFrame | None:
    """The rows that the index of a dense vector leaves as candidates, with the columns of :meth:`Collection.live`; none
    if the field has no index by cells, or the data or the columns have changed since it was built."""
    entry = collection.manifest["indexes"].get(name)
    current = collection.manifest["indexed_version"] == collection.manifest["data_version"]
    if entry is None or entry["kind"] not in CELLS or not current or collection.manifest.get("indexed_columns") != collection.manifest["columns"]:
        return None
    wanted = nprobe or {**KINDS[entry["kind"]], **entry["params"]}.get("nprobe", KINDS["ivf"]["nprobe"])
    rows = cells.probed_rows(collection.spark, index_path(collection, name), query, int(wanted), metric)
    return rows.withColumnRenamed("vector", name).select("id", *[f"`{c}`" for c in collection.manifest["columns"]])


def build_index(collection, name: str, kind: str, params: dict) -> None:
    """Write what a kind needs beside the data. Scalar and flat kinds need nothing: Parquet statistics prune scans."""
    chosen = {**KINDS[kind], **params}
    where = index_path(collection, name)
    live = collection.live().where(f"`{name}` is not null").withColumn("vector", F.col(f"`{name}`"))
    if kind in CELLS:
        n = live.count()
        nlist = max(1, min(int(chosen.get("nlist", 256)), n // 8 or 1))
        cells.write_cells(live.drop(name), cells.fit_centroids(live.select("id", "vector"), nlist), where)
    elif kind.startswith("sparse"):
        postings.explode_postings(live.select("id", "vector")).write.mode("overwrite").parquet(where)
