"""What a query asks for."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class VectorQuery:
    """A recall source: a field and a dense list, a sparse dict, or ids whose stored vectors are the query."""

    field: str | None = None
    vector: Sequence[float] | dict[int, float] | None = None
    ids: Sequence[int] | None = None
    metric: str | None = None
    ef_search: int | None = None
    nprobe: int | None = None


@dataclass
class GroupBy:
    field: str
    group_topk: int = 1
    group_count: int = 0


@dataclass
class OrderBy:
    field: str
    descending: bool = False


@dataclass
class RRF:
    """Reciprocal rank fusion: sum of 1 / (rank_constant + rank), ranks from 1."""

    rank_constant: int = 60


@dataclass
class Weighted:
    """Weighted sum of similarities; a missing weight is 1; ``metric`` overrides the sources' own."""

    weights: dict[str, float] = field(default_factory=dict)
    metric: str | None = None


class ReRanker(ABC):
    """A user's own fusion. It gets one DataFrame (id, distance) per source and returns (id, fused_score)."""

    @abstractmethod
    def rerank(self, sources: dict[str, DataFrame]) -> DataFrame: ...


@dataclass
class QueryContext:
    queries: list[VectorQuery] = field(default_factory=list)
    filter: str | None = None
    top_k: int = 10
    output_fields: list[str] | None = None
    include_vector: bool = False
    group_by: GroupBy | None = None
    order_by: OrderBy | None = None
    reranker: RRF | Weighted | ReRanker | None = None
    order: str = "fused"  # or "distance": the fused score selects, the best distance orders
    group_first: bool = False
    order_scope: str = "all"  # or "topk": order_by sorts the top_k by distance only
    per_source_k: int | None = None  # fuse each source's k best instead of whole lists
    positive_only: bool = False  # drop sparse hits that share no weight
