"""From a request to a lazy DataFrame: filter, score, fuse, order, group, limit, project.

The input holds one row per live document (id and columns). Nothing runs here except reading the stored vectors of a
query-by-id; Catalyst pushes the filter and the needed columns into the scan, and a single source plans as a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInput, NotFound, Unsupported
from ..functions import distance as D
from ..operators import fusion
from ..operators.ranking import best_per_group, with_rank
from ..schema import CollectionSchema, metric_name
from .context import RRF, QueryContext, ReRanker, VectorQuery, Weighted
from .filters import Compiler, parse


def _check(schema: CollectionSchema, ctx: QueryContext) -> None:
    has_filter = ctx.filter is not None and ctx.filter.strip() != ""
    if not ctx.queries and not has_filter:
        raise InvalidInput("a query needs a recall source or a filter")
    if any(q.ef_search is not None or q.nprobe is not None for q in ctx.queries) and (len(ctx.queries) > 1 or ctx.queries[0].ids is not None or ctx.group_by):
        raise Unsupported("search parameters belong to a single vector query")
    if ctx.group_by is not None:
        if not ctx.queries:
            raise InvalidInput("group_by needs a recall source")
        f = schema.field(ctx.group_by.field)
        if f is None or f.array:
            raise InvalidInput(f"cannot group by {ctx.group_by.field!r}")
    if ctx.order_by is not None:
        name = ctx.order_by.field
        f = schema.field(name)
        if not name or (f is not None and f.array) or name in [v.name for v in schema.vectors]:
            raise InvalidInput(f"cannot order by {name!r}")


def _resolve(live: DataFrame, schema: CollectionSchema, q: VectorQuery) -> list[tuple[str, object, str]]:
    """(field, query vector, metric) of each source that a query stands for."""
    name = q.field or schema.primary_vector
    v = schema.vector(name)
    metric = metric_name(q.metric) if q.metric else schema.metric_of(name)
    if q.ids is None:
        vectors = [q.vector]
    else:
        wanted = [int(i) for i in q.ids]
        if not wanted:
            raise NotFound("no ids to query by")
        stored = {r["id"]: r["v"] for r in live.where(F.col("id").isin(wanted)).select("id", F.col(f"`{name}`").alias("v")).collect()}
        missing = [i for i in wanted if stored.get(i) is None]
        if missing:
            raise NotFound(f"no vector {name!r} of document {missing[0]}")
        vectors = [stored[i] for i in wanted]
        if v.sparse:
            vectors = [dict(zip(x["indices"], x["values"], strict=True)) for x in vectors]
    for x in vectors:
        if v.sparse != isinstance(x, dict):
            raise InvalidInput(f"field {name!r} is {'sparse' if v.sparse else 'dense'}, the query is not")
        if not v.sparse and (x is None or len(x) != v.dimension):
            raise InvalidInput(f"field {name!r} has dimension {v.dimension}")
    return [(name, x, "ip" if v.sparse else metric) for x in vectors]


def execute(live: DataFrame, schema: CollectionSchema, ctx: QueryContext) -> DataFrame:
    """rank, id, distance, [fused_score], [group_key], fields, [vectors]."""
    _check(schema, ctx)
    rows = live
    if ctx.filter is not None and ctx.filter.strip():
        rows = rows.where(Compiler({f.name: f.dataType for f in live.schema.fields}).holds(parse(ctx.filter)))

    sources: dict[str, str] = {}
    metrics: dict[str, str] = {}
    seen: dict[str, int] = {}
    for q in ctx.queries:
        for name, vector, metric in _resolve(live, schema, q):
            seen[name] = seen.get(name, 0) + 1
            label = name if seen[name] == 1 else f"{name}#{seen[name]}"
            column = f"__d{len(sources)}"
            c = F.col(f"`{name}`")
            d = D.sparse_ip(c, vector) if isinstance(vector, dict) else F.when(c.isNotNull(), D.distance(metric, c, D.vector_literal(vector)))
            if isinstance(vector, dict) and ctx.positive_only:
                d = F.when(d < 0, d)
            rows = rows.withColumn(column, d)
            sources[label], metrics[label] = column, metric

    if sources:
        columns = [F.col(c) for c in sources.values()]
        rows = rows.withColumn("distance", F.least(*columns) if len(columns) > 1 else columns[0]).where(F.col("distance").isNotNull())
    else:
        rows = rows.withColumn("distance", F.lit(0.0))

    fused = ctx.reranker is not None and bool(sources)
    if fused:
        rows = _fuse(rows, sources, metrics, ctx)
    by_distance = [F.col("distance").asc(), F.col("id").asc()]
    by_score = [F.col("fused_score").desc(), *by_distance] if fused else by_distance
    if fused and ctx.order == "distance":
        rows = rows.orderBy(*by_score).limit(max(0, ctx.top_k))
        by_score = by_distance
    order: list[Column] = by_score
    if ctx.order_by is not None:
        if ctx.order_scope == "topk":
            rows = rows.orderBy(*by_score).limit(max(0, ctx.top_k))
        if ctx.order_by.field in live.columns:
            value = F.col(f"`{ctx.order_by.field}`")
            order = [value.desc_nulls_first() if ctx.order_by.descending else value.asc_nulls_last(), *by_distance]
        else:
            order = by_distance
    if ctx.group_by is not None:
        rows = rows.withColumn("group_key", F.col(f"`{ctx.group_by.field}`"))
        rows = best_per_group(rows, "group_key", by_score if ctx.group_first else order, ctx.group_by.group_topk, ctx.group_by.group_count)
    limited = with_rank(rows.orderBy(*order).limit(max(0, ctx.top_k)), *order)
    return limited.select(*_projection(live.schema, schema, ctx, fused))


def _fuse(rows: DataFrame, sources: dict[str, str], metrics: dict[str, str], ctx: QueryContext) -> DataFrame:
    if isinstance(ctx.reranker, Weighted) and ctx.per_source_k is None:
        score = F.lit(0.0)  # one row holds all it needs: no shuffle
        for label, column in sources.items():
            weight = ctx.reranker.weights.get(label, ctx.reranker.weights.get(label.split("#")[0], 1.0))
            score = score + F.coalesce(F.lit(float(weight)) * D.similarity(ctx.reranker.metric or metrics[label], F.col(column)), F.lit(0.0))
        return rows.withColumn("fused_score", score)
    lists = fusion.ranked_sources(rows, sources, ctx.per_source_k)
    if isinstance(ctx.reranker, RRF):
        scores = fusion.reciprocal_rank(lists, ctx.reranker.rank_constant)
    elif isinstance(ctx.reranker, Weighted):
        scores = fusion.weighted(lists, metrics, ctx.reranker.weights, ctx.reranker.metric)
    elif isinstance(ctx.reranker, ReRanker):
        scores = ctx.reranker.rerank(lists)
    else:
        raise InvalidInput("unknown reranker")
    scores = scores.orderBy(F.desc("fused_score"), "id").limit(ctx.top_k) if ctx.group_by is None and ctx.order_by is None and ctx.per_source_k else scores
    return rows.join(scores.select(F.col("id").alias("__id"), "fused_score"), F.col("id") == F.col("__id")).drop("__id")


def _projection(spark_schema: T.StructType, schema: CollectionSchema, ctx: QueryContext, fused: bool) -> list[Column]:
    vectors = {v.name for v in schema.vectors}
    fields = [f.name for f in spark_schema.fields if f.name != "id" and f.name not in vectors]
    if ctx.output_fields is not None:
        fields = [f for f in fields if f in ctx.output_fields]
    head = ["rank", "id", "distance"] + ["fused_score"] * fused + ["group_key"] * (ctx.group_by is not None)
    tail = [v.name for v in schema.vectors if v.name in spark_schema.names] if ctx.include_vector else []
    return [F.col(f"`{c}`") for c in [*head, *fields, *tail]]
