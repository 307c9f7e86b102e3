"""One query per operator over the shared tables, with SQL for the same rows.

``embeddings`` is bound as a collection (id = vec_id, fields label and label_n, vectors embedding, head and zero),
``part``, ``orders`` and ``events`` as filter-only collections. Distances are rounded to six digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import distance as D
from .index import cells, postings
from .operators.batch_knn import batch_knn, recall_at_k
from .operators.latest import fetch, latest_live, log_stats, newest
from .operators.ranking import with_rank
from .plans.context import RRF, GroupBy, OrderBy, QueryContext, VectorQuery, Weighted
from .plans.engine import execute
from .plans.filters import compile_filter
from .schema import SPARSE, CollectionSchema, Field, Vector
from .store.collection import Database
from .store.keys import assign_ids

DIM, HEAD = 64, 32
Q0 = [((i * 7) % 13 - 6) / 10.0 for i in range(DIM)]
QH = [((i * 5) % 11 - 5) / 10.0 for i in range(HEAD)]
EMB = CollectionSchema(
    "embedding",
    [Vector("embedding", DIM), Vector("head", HEAD, metric="cosine"), Vector("zero", DIM, metric="cosine"), Vector("ipv", DIM, metric="ip")],
    [Field("label", "int32"), Field("label_n", "int32", nullable=True), Field("name", "string")],
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emb(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.nullif("label", F.lit(3)).alias("label_n"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"),
        e, F.slice(e, 1, HEAD).alias("head"), F.transform(e, lambda x: x * F.lit(0).cast("float")).alias("zero"), e.alias("ipv"),
    )


def _round(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("distance", "fused_score") if c in df.columns})


def _sql_list(v: list[float]) -> str:
    return "[" + ", ".join(repr(float(x)) for x in v) + "]::DOUBLE[]"


def _sql_distance(metric: str, column: str, v: list[float]) -> str:
    a, b = f"{column}::DOUBLE[]", _sql_list(v)
    if metric == "l2":
        return f"list_distance({a}, {b})"
    if metric == "ip":
        return f"(-list_dot_product({a}, {b}))"
    return f"(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


_EMB_SQL = f"""e AS (SELECT vec_id AS id, label, nullif(label, 3) AS label_n, 'v' || vec_id AS name, embedding,
  embedding[1:{HEAD}] AS head FROM embeddings)"""


def _knn_sql(distance: str, k: int = 10, where: str = "TRUE", columns: str = "label", order: str = "distance, id") -> str:
    return f"""WITH {_EMB_SQL}, s AS (SELECT *, {distance} AS distance FROM e WHERE {where}),
r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM s)
SELECT CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance, {columns} FROM r WHERE rank <= {k}"""


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _emb_query(name: str, ctx: QueryContext, sql: str) -> None:
    ctx.output_fields = ctx.output_fields or ["label"]
    _register(name, sql)(lambda spark, d: _round(execute(emb(spark, d), EMB, ctx)))


# --- distances and search ------------------------------------------------------------------------------------------

_emb_query("knn_l2", QueryContext([VectorQuery("embedding", Q0)]), _knn_sql(_sql_distance("l2", "embedding", Q0)))
_emb_query("knn_ip", QueryContext([VectorQuery("ipv", Q0)]), _knn_sql(_sql_distance("ip", "embedding", Q0)))
_emb_query("knn_cosine", QueryContext([VectorQuery("head", QH)]), _knn_sql(_sql_distance("cosine", "head", QH)))
_emb_query("knn_metric_override", QueryContext([VectorQuery("embedding", Q0, metric="COSINE")]), _knn_sql(_sql_distance("cosine", "embedding", Q0)))
_emb_query("knn_zero_norm", QueryContext([VectorQuery("zero", Q0)]), _knn_sql("2.0::DOUBLE"))
_emb_query("knn_top1", QueryContext([VectorQuery("embedding", Q0)], top_k=1), _knn_sql(_sql_distance("l2", "embedding", Q0), 1))
_emb_query("knn_k_over_n", QueryContext([VectorQuery("embedding", Q0)], top_k=1_000_000), _knn_sql(_sql_distance("l2", "embedding", Q0), 1_000_000))
_emb_query(
    "knn_filtered",
    QueryContext([VectorQuery("embedding", Q0)], filter="label != 3 and label >= 2"),
    _knn_sql(_sql_distance("l2", "embedding", Q0), where="label <> 3 AND label >= 2"),
)
_emb_query(
    "knn_filtered_missing",
    QueryContext([VectorQuery("embedding", Q0)], filter="not (label_n > 5)"),
    _knn_sql(_sql_distance("l2", "embedding", Q0), where="label_n IS NULL OR NOT label_n > 5"),
)
_emb_query("filter_only_scan", QueryContext(filter="label in (1, 2)", top_k=20), _knn_sql("0.0::DOUBLE", 20, "label IN (1, 2)"))
_emb_query(
    "knn_output_fields",
    QueryContext([VectorQuery("embedding", Q0)], output_fields=["name", "unknown"]),
    _knn_sql(_sql_distance("l2", "embedding", Q0), columns="name"),
)
@_register(
    "knn_include_vector",
    f"""SELECT rank, id, distance, label, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total, len(head) AS n_head
FROM ({_knn_sql(_sql_distance("l2", "embedding", Q0), 3, columns="label, embedding, head")})""",
)
def knn_include_vector(spark, d):
    found = execute(emb(spark, d), EMB, QueryContext([VectorQuery("embedding", Q0)], top_k=3, output_fields=["label"], include_vector=True))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    sizes = [F.size("embedding").cast("long").alias("n"), (F.round(total, 4) + F.lit(0.0)).alias("total"), F.size("head").cast("long").alias("n_head")]
    return _round(found).select("rank", "id", "distance", "label", *sizes)


@_register("knn_ids_scores", _knn_sql(_sql_distance("l2", "embedding", Q0)).replace(", label FROM r", " FROM r"))
def knn_ids_scores(spark, d):
    return _round(execute(emb(spark, d), EMB, QueryContext([VectorQuery("embedding", Q0)], output_fields=[]))).select("rank", "id", "distance")


@_register(
    "query_by_id",
    f"""WITH {_EMB_SQL}, s AS (SELECT e.id, e.label, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
FROM e, (SELECT embedding FROM e WHERE id = 7) q), r AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM s)
SELECT CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance, label FROM r WHERE rank <= 10""",
)
def query_by_id(spark, d):
    return _round(execute(emb(spark, d), EMB, QueryContext([VectorQuery(ids=[7])], output_fields=["label"])))


_L2, _COS, _IP = _sql_distance("l2", "embedding", Q0), _sql_distance("cosine", "head", QH), _sql_distance("ip", "embedding", Q0)
_TWO = [VectorQuery("embedding", Q0), VectorQuery("head", QH)]
_emb_query("multi_vector_min", QueryContext(list(_TWO)), _knn_sql(f"least({_L2}, {_COS})"))


def _fused_sql(score: str, order: str = "fused_score DESC, distance, id") -> str:
    return f"""WITH {_EMB_SQL}, s AS (SELECT *, {_L2} AS d1, {_COS} AS d2, {_IP} AS d3 FROM e),
k AS (SELECT *, row_number() OVER (ORDER BY d1, id) AS r1, row_number() OVER (ORDER BY d2, id) AS r2 FROM s),
f AS (SELECT *, least(d1, d2) AS distance, {score} AS fused_score FROM k),
r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM f)
SELECT CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance, round(fused_score, 6) + 0.0 AS fused_score, label FROM r WHERE rank <= 10"""


_NORM = {"l2": "(1 - 2 * atan({}) / pi())", "ip": "(0.5 - atan({}) / pi())", "cosine": "(1 - {} / 2)"}
_emb_query("rerank_rrf", QueryContext(list(_TWO), reranker=RRF(60)), _fused_sql("1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2)"))
_emb_query(
    "rerank_rrf_per_source",
    QueryContext(list(_TWO), reranker=RRF(10), per_source_k=20),
    _fused_sql("CASE WHEN r1 <= 20 THEN 1.0::DOUBLE / (10 + r1) ELSE 0 END + CASE WHEN r2 <= 20 THEN 1.0::DOUBLE / (10 + r2) ELSE 0 END"),
)
_emb_query(
    "rerank_weighted",
    QueryContext(list(_TWO), reranker=Weighted({"embedding": 0.7, "head": 0.3})),
    _fused_sql(f"0.7::DOUBLE * {_NORM['l2'].format('d1')} + 0.3::DOUBLE * {_NORM['cosine'].format('d2')}"),
)
_emb_query(
    "rerank_weighted_override",
    QueryContext(list(_TWO), reranker=Weighted({"embedding": 0.5}, metric="cosine")),
    _fused_sql(f"0.5::DOUBLE * {_NORM['cosine'].format('d1')} + {_NORM['cosine'].format('d2')}"),
)
_emb_query(
    "rerank_weighted_ip",
    QueryContext([VectorQuery("embedding", Q0), VectorQuery("ipv", Q0)], reranker=Weighted({"ipv": 2.0})),
    _fused_sql(f"{_NORM['l2'].format('d1')} + 2.0::DOUBLE * {_NORM['ip'].format('d3')}").replace("least(d1, d2) AS distance", "least(d1, d3) AS distance"),
)
_emb_query(
    "rerank_order_distance",
    QueryContext(list(_TWO), reranker=Weighted({"embedding": 0.7, "head": 0.3}), order="distance"),
    f"SELECT CAST(row_number() OVER (ORDER BY distance, id) AS INT) AS rank, * EXCLUDE (rank) FROM ({_fused_sql(f'0.7::DOUBLE * {_NORM["l2"].format("d1")} + 0.3::DOUBLE * {_NORM["cosine"].format("d2")}')})",
)
_emb_query(
    "duplicate_field_sources",
    QueryContext([VectorQuery("embedding", Q0), VectorQuery("embedding", [-x for x in Q0])]),
    _knn_sql(f"least({_L2}, {_sql_distance('l2', 'embedding', [-x for x in Q0])})"),
)

# --- order, group, limit -------------------------------------------------------------------------------------------

for _n, _desc, _nulls in (("order_asc", False, "label_n ASC NULLS LAST"), ("order_desc", True, "label_n DESC NULLS FIRST")):
    _emb_query(
        _n, QueryContext([VectorQuery("embedding", Q0)], order_by=OrderBy("label_n", _desc), top_k=30, output_fields=["label_n"]),
        _knn_sql(_L2, 30, columns="label_n", order=f"{_nulls}, distance, id"),
    )
_emb_query(
    "order_topk_scope",
    QueryContext([VectorQuery("embedding", Q0)], order_by=OrderBy("label"), top_k=12, order_scope="topk"),
    f"SELECT CAST(row_number() OVER (ORDER BY label, distance, id) AS INT) AS rank, * EXCLUDE (rank) FROM ({_knn_sql(_L2, 12)})",
)


def _group_sql(per: int, groups: int, k: int, order: str = "distance, id") -> str:
    return f"""WITH {_EMB_SQL}, s AS (SELECT *, {_L2} AS distance FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY label_n ORDER BY {order}) AS place, row_number() OVER (ORDER BY {order}) AS pos FROM s),
g AS (SELECT *, min(pos) OVER (PARTITION BY label_n) AS head_pos FROM p),
h AS (SELECT *, dense_rank() OVER (ORDER BY head_pos) AS group_rank FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY pos) AS rank FROM h WHERE place <= {per} AND group_rank <= {groups})
SELECT CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance, label_n AS group_key, label FROM r WHERE rank <= {k}"""


_GROUPED = CollectionSchema("embedding", EMB.vectors, EMB.fields)
for _n, _per, _groups, _k in (("group_by_best", 1, 0, 10), ("group_by_topk", 3, 0, 25), ("group_by_count", 2, 4, 25)):
    _emb_query(
        _n, QueryContext([VectorQuery("embedding", Q0)], group_by=GroupBy("label_n", _per, _groups), top_k=_k), _group_sql(_per, _groups or 10**6, _k)
    )
_emb_query(
    "group_by_ordered",
    QueryContext([VectorQuery("embedding", Q0)], group_by=GroupBy("label_n", 2), order_by=OrderBy("name"), top_k=15),
    _group_sql(2, 10**6, 15, "name, distance, id"),
)


@_register(
    "group_key_canonical",
    """SELECT g AS group_key, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN NULL
WHEN 3 THEN 1.0 ELSE 2.0 END AS g FROM events) GROUP BY g""",
)
def group_key_canonical(spark, d):
    """Minus zero groups with zero, nulls are one group."""
    m = F.col("event_id") % 6
    g = F.when(m == 0, F.lit(-0.0)).when(m == 1, F.lit(0.0)).when(m == 2, F.lit(None).cast("double")).when(m == 3, F.lit(1.0)).otherwise(2.0)
    return _t(spark, d, "events").select(g.alias("group_key")).groupBy("group_key").agg(F.count(F.lit(1)).alias("n")).withColumn("group_key", F.col("group_key") + F.lit(0.0))


# --- filters -------------------------------------------------------------------------------------------------------


def parts(spark, d):
    return _t(spark, d, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", F.split("p_name", " ").alias("tags"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size_n"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("brand_n"),
        F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("price_n"),
    )


_PARTS_SQL = """WITH p AS (SELECT *, string_split(p_name, ' ') AS tags, CASE WHEN p_size % 7 <> 0 THEN p_size END AS size_n,
CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand_n, p_size % 3 = 0 AS is_nan FROM part) SELECT p_partkey FROM p WHERE """

FILTERS = {
    "filter_eq": ("p_brand == \"Brand#13\"", "p_brand = 'Brand#13'"),
    "filter_ne": ("size_n != 10", "size_n <> 10"),
    "filter_gt": ("p_size>40", "p_size > 40"),
    "filter_gte": ("p_size >= 40", "p_size >= 40"),
    "filter_lt": ("p_retailprice < 1000.5", "p_retailprice < 1000.5"),
    "filter_lte": ("p_size <= 3", "p_size <= 3"),
    "filter_in": ("p_size in (1, 5, 9)", "p_size IN (1, 5, 9)"),
    "filter_in_empty": ("p_size in ()", "FALSE"),
    "filter_not_in": ("size_n not in (1, 2, 3)", "size_n IS NULL OR size_n NOT IN (1, 2, 3)"),
    "filter_is_null": ("size_n is null", "size_n IS NULL"),
    "filter_is_not_null": ("brand_n is not null", "brand_n IS NOT NULL"),
    "filter_like": ("p_name like \"%re%\"", "p_name LIKE '%re%'"),
    "filter_like_underscore": ("p_brand like \"Brand#_3\"", "p_brand LIKE 'Brand#_3'"),
    "filter_not_like": ("brand_n not like \"Brand#1%\"", "brand_n IS NULL OR brand_n NOT LIKE 'Brand#1%'"),
    "filter_has_prefix": ("p_type has_prefix \"S\"", "starts_with(p_type, 'S')"),
    "filter_not_has_prefix": ("brand_n not has_prefix \"Brand#2\"", "brand_n IS NULL OR NOT starts_with(brand_n, 'Brand#2')"),
    "filter_has_suffix": ("p_type has_suffix \"L\"", "ends_with(p_type, 'L')"),
    "filter_not_has_suffix": ("brand_n not has_suffix \"5\"", "brand_n IS NULL OR NOT ends_with(brand_n, '5')"),
    "filter_and_or_precedence": ("p_size == 1 or p_size == 2 and p_brand == \"Brand#13\"", "p_size = 1 OR (p_size = 2 AND p_brand = 'Brand#13')"),
    "filter_parentheses": ("(p_size == 1 or p_size == 2) and p_retailprice > 905", "(p_size = 1 OR p_size = 2) AND p_retailprice > 905"),
    "filter_not": ("not (size_n > 5)", "size_n IS NULL OR NOT size_n > 5"),
    "filter_not_or": ("not (size_n > 5 or brand_n == \"Brand#11\")", "(size_n IS NULL OR size_n <= 5) AND (brand_n IS NULL OR brand_n <> 'Brand#11')"),
    "filter_nan": ("price_n > 0", "NOT is_nan AND p_retailprice > 0"),
    "filter_nan_not": ("not price_n > 0", "is_nan OR NOT p_retailprice > 0"),
    "filter_type_mismatch": ("p_brand == 5 or p_size == 7", "p_size = 7"),
    "filter_type_mismatch_ne": ("brand_n != 5", "brand_n IS NOT NULL"),
    "filter_missing_field": ("not (nothing == 1) and nothing is null and p_size < 5", "p_size < 5"),
    "filter_float_literal": ("p_size > 10.5", "p_size > 10.5"),
    "filter_contains": ("tags contains \"red\"", "list_contains(tags, 'red')"),
    "filter_contains_any": ("tags contains any (\"red\", \"blue\")", "list_has_any(tags, ['red', 'blue'])"),
    "filter_contains_all": ("tags contains all (\"small\", \"ring\")", "list_has_all(tags, ['small', 'ring'])"),
    "filter_contains_all_empty": ("tags contains all ()", "tags IS NOT NULL"),
    "filter_not_contains": ("not tags contains \"red\"", "NOT list_contains(tags, 'red')"),
    "filter_contains_scalar": ("p_size contains 5", "p_size = 5"),
    "filter_array_eq": ("tags == \"red\" or p_size == 3", "p_size = 3"),
}


def _filter_query(text: str):
    def run(spark, d):
        p = parts(spark, d)
        return p.where(compile_filter(text, p.schema)).select("p_partkey")

    return run


for _n, (_text, _where) in FILTERS.items():
    _register(_n, _PARTS_SQL + _where)(_filter_query(_text))


@_register("filter_bool", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def filter_bool(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("done"))
    return o.where(compile_filter("done == true", o.schema)).agg(F.count(F.lit(1)).alias("n"))


# --- sparse --------------------------------------------------------------------------------------------------------

TERMS = {"the": 1.0, "and": 0.5, "of": 2.0, "de": 1.5, "la": 0.25}
_WORD_ID = {w: i for i, w in enumerate(sorted(TERMS))}


def sparse_docs(spark, d):
    """Term counts of five words in each document, as sparse vectors."""

    def counts(words):
        """Of the few wanted words of a text; a lambda's variable, so the text is split once."""
        count = lambda w: F.size(F.filter(words, lambda x: x == w)).cast("float")
        pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), count(w).alias("v")) for w, i in _WORD_ID.items()])
        return F.transform(F.array(F.filter(pairs, lambda p: p["v"] > 0)), lambda present: F.struct(F.transform(present, lambda p: p["i"]).alias("indices"), F.transform(present, lambda p: p["v"]).alias("values")))[0]

    wanted = F.filter(F.split(F.lower("text"), " ", -1), lambda x: x.isin(*_WORD_ID))
    vector = F.transform(F.array(wanted), counts)[0]
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", vector.alias("terms"), F.array(F.col("n_chars").cast("float"), F.lit(1.0).cast("float")).alias("dense"))


DOCS = CollectionSchema("dense", [Vector("dense", 2), Vector("terms", 0, SPARSE)], [Field("lang", "string")])
_SPARSE_QUERY = {_WORD_ID[w]: v for w, v in TERMS.items()}
_COUNTS_SQL = "w AS (SELECT doc_id AS id, lang, n_chars, string_split(lower(text), ' ') AS words FROM documents)"
_SPARSE_SCORE = " + ".join(f"{v}::DOUBLE * len(list_filter(words, lambda x: x = '{w}'))" for w, v in TERMS.items())


def _sparse_sql(score: str, k: int, where: str = "TRUE", columns: str = ", lang") -> str:
    return f"""WITH {_COUNTS_SQL}, s AS (SELECT *, {score} AS distance FROM w), r AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank
FROM s WHERE {where}) SELECT CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance{columns} FROM r WHERE rank <= {k}"""


@_register("sparse_ip", _sparse_sql(f"-({_SPARSE_SCORE})", 15))
def sparse_ip(spark, d):
    return _round(execute(sparse_docs(spark, d), DOCS, QueryContext([VectorQuery("terms", _SPARSE_QUERY)], top_k=15)))


@_register("sparse_positive_only", f"WITH {_COUNTS_SQL} SELECT id, round(-({_SPARSE_SCORE}), 6) + 0.0 AS distance, lang FROM w WHERE {_SPARSE_SCORE} > 0")
def sparse_positive_only(spark, d):
    """Every document that scores, however many: no rank, so no global order."""
    scored = sparse_docs(spark, d).select("id", D.sparse_ip(F.col("terms"), _SPARSE_QUERY).alias("distance"), "lang")
    return _round(scored.where("distance < 0"))


@_register("sparse_positive_topk", _sparse_sql(f"-({_SPARSE_SCORE})", 25, "distance < 0"))
def sparse_positive_topk(spark, d):
    return _round(execute(sparse_docs(spark, d), DOCS, QueryContext([VectorQuery("terms", _SPARSE_QUERY)], top_k=25, positive_only=True)))


@_register("sparse_postings", _sparse_sql(f"-({_SPARSE_SCORE})", 15, "distance < 0", ""))
def sparse_postings(spark, d):
    table = postings.explode_postings(sparse_docs(spark, d).select("id", F.col("terms").alias("vector")))
    return with_rank(_round(postings.search_postings(table, _SPARSE_QUERY, 15)), "distance", "id")


@_register(
    "hybrid_dense_sparse",
    f"""WITH {_COUNTS_SQL}, s AS (SELECT *, least(-({_SPARSE_SCORE}), sqrt((n_chars - 500.0::DOUBLE) ** 2)) AS distance FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM s)
SELECT CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance, lang FROM r WHERE rank <= 15""",
)
def hybrid_dense_sparse(spark, d):
    ctx = QueryContext([VectorQuery("dense", [500.0, 1.0]), VectorQuery("terms", _SPARSE_QUERY)], top_k=15)
    return _round(execute(sparse_docs(spark, d), DOCS, ctx))


_BM_IDS = [_WORD_ID["and"], _WORD_ID["de"]]


@_register(
    "sparse_bm25",
    f"""WITH {_COUNTS_SQL}, t AS (SELECT id, term, len(list_filter(words, lambda x: x = term)) AS tf FROM w, (SELECT unnest({sorted(TERMS)!r}) AS term)),
p AS (SELECT * FROM t WHERE tf > 0), l AS (SELECT id, sum(tf)::DOUBLE AS len FROM p GROUP BY id),
n AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l), q AS (SELECT * FROM p WHERE term IN ('and', 'de')),
f AS (SELECT term, count(*) AS df FROM q GROUP BY term),
s AS (SELECT q.id, -sum(ln((n.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / n.avgdl))) AS distance
FROM q JOIN f USING (term) JOIN l ON q.id = l.id, n GROUP BY q.id), r AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM s)
SELECT CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 10""",
)
def sparse_bm25(spark, d):
    table = postings.explode_postings(sparse_docs(spark, d).select("id", F.col("terms").alias("vector")))
    return with_rank(_round(postings.search_bm25(table, _BM_IDS, 10)), "distance", "id")


# --- the versioned log and DML -------------------------------------------------------------------------------------


def events_log(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("op_seq"), (F.col("event_type") == "error").alias("is_deleted"), "event_type", "value")


_LOG_SQL = """l AS (SELECT user_id AS id, event_id AS op_seq, event_type = 'error' AS is_deleted, event_type, value,
row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events)"""


@_register("latest_live", f"WITH {_LOG_SQL} SELECT id, op_seq, event_type, value FROM l WHERE place = 1 AND NOT is_deleted")
def latest_live_query(spark, d):
    return latest_live(events_log(spark, d)).select("id", "op_seq", "event_type", "value")


@_register(
    "log_stats",
    f"WITH {_LOG_SQL} SELECT count(*) AS record_count, CAST(count(*) FILTER (WHERE is_deleted) AS BIGINT) AS deleted_count, CAST(count(*) FILTER (WHERE NOT is_deleted) AS BIGINT) AS live_count FROM l WHERE place = 1",
)
def log_stats_query(spark, d):
    return log_stats(events_log(spark, d))


@_register(
    "segment_list",
    """WITH l AS (SELECT event_id % 4 AS segment_id, event_type = 'error' AS is_deleted, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events)
SELECT segment_id, count(*) FILTER (WHERE place = 1 AND NOT is_deleted) AS live_rows, count(*) FILTER (WHERE NOT (place = 1 AND NOT is_deleted)) AS dead_rows FROM l GROUP BY segment_id""",
)
def segment_list(spark, d):
    log = events_log(spark, d)
    alive = newest(log).where(~F.col("is_deleted")).select(F.col("op_seq").alias("s"), F.lit(1).alias("a"))
    rows = log.withColumn("segment_id", F.col("op_seq") % 4).join(alive, F.col("op_seq") == F.col("s"), "left")
    return rows.groupBy("segment_id").agg(F.count("a").alias("live_rows"), (F.count(F.lit(1)) - F.count("a")).alias("dead_rows"))


@_register(
    "fetch_by_ids",
    """SELECT pos, c_custkey AS id, c_name FROM (VALUES (0, 5), (1, 3), (2, 5), (4, 1)) v(pos, k) JOIN customer ON c_custkey = k""",
)
def fetch_by_ids(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return fetch(c, [5, 3, 5, -1, 1]).select(F.col("pos").cast("int").alias("pos"), "id", "c_name")


@_register("string_keys", "SELECT c_name AS key, CAST(c_custkey AS BIGINT) AS id FROM customer")
def string_keys(spark, d):
    known = _t(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("id"))
    return assign_ids(known.select("key"), known)


@_register(
    "string_keys_new",
    "SELECT count(*) AS n, count(DISTINCT c_name) AS ids, CAST(50 + count(*) AS BIGINT) AS last FROM customer WHERE c_custkey > 50",
)
def string_keys_new(spark, d):
    c = _t(spark, d, "customer")
    known = c.where("c_custkey <= 50").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("id"))
    new = assign_ids(c.where("c_custkey > 50").select(F.col("c_name").alias("key")), known)
    return new.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max("id").alias("last"))


PARTS = CollectionSchema("v", [Vector("v", 2)], [Field("name", "string"), Field("size", "int32"), Field("price", "float64", nullable=True)])


def _part_rows(spark, d, where: str = "true") -> DataFrame:
    v = F.array(F.col("p_size").cast("float"), F.lit(1.0).cast("float"))
    return _t(spark, d, "part").where(where).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), v.alias("v"))


def _db_root(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("collections need a folder that all executors share: set spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="korvex-db-")
    return f"{root}/korvex-db/{uuid.uuid4().hex[:12]}"


def _collection(spark, d, schema: CollectionSchema = PARTS, where: str = "true"):
    c = Database(spark, _db_root(spark)).create_collection("parts", schema)
    c.insert(_part_rows(spark, d, where))
    return c


_PART_SQL = "p AS (SELECT p_partkey AS id, p_name AS name, p_size AS size, p_retailprice AS price FROM part)"


@_register("collection_insert", f"WITH {_PART_SQL} SELECT * FROM p")
def collection_insert(spark, d):
    return _collection(spark, d).live().drop("v")


@_register("collection_upsert", f"WITH {_PART_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE name END AS name, size, price FROM p")
def collection_upsert(spark, d):
    c = _collection(spark, d, where="p_partkey % 5 <> 0 or p_partkey % 3 = 0")
    c.upsert(_part_rows(spark, d, "p_partkey % 3 = 0").withColumn("name", F.lit("new")))
    c.insert(_part_rows(spark, d, "p_partkey % 5 = 0 and p_partkey % 3 <> 0"))
    return c.live().drop("v")


@_register("collection_update", f"WITH {_PART_SQL} SELECT id, name, CASE WHEN id % 4 = 0 THEN 99 ELSE size END AS size, CASE WHEN id % 4 = 0 THEN NULL ELSE price END AS price FROM p")
def collection_update(spark, d):
    c = _collection(spark, d)
    c.update(_t(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.lit(99).alias("size")), unset=["price"])
    return c.live().drop("v")


@_register("collection_delete", f"WITH {_PART_SQL} SELECT * FROM p WHERE id % 7 <> 0")
def collection_delete(spark, d):
    c = _collection(spark, d)
    c.delete(_t(spark, d, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id")))
    return c.live().drop("v")


@_register("collection_delete_by_filter", f"WITH {_PART_SQL} SELECT * FROM p WHERE NOT (size > 25 AND contains(name, 're'))")
def collection_delete_by_filter(spark, d):
    c = _collection(spark, d)
    c.delete_by_filter('size > 25 and name like "%re%"')
    return c.live().drop("v")


@_register("collection_compact", f"WITH {_PART_SQL} SELECT * FROM p WHERE id % 2 = 0")
def collection_compact(spark, d):
    c = _collection(spark, d)
    c.delete_by_filter("size > 1000")
    c.delete(_t(spark, d, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id")))
    c.compact()
    return c.live().drop("v")


@_register("collection_stats", "SELECT count(*) AS record_count, CAST(count(*) FILTER (WHERE p_partkey % 7 = 0) AS BIGINT) AS deleted_count, CAST(count(*) FILTER (WHERE p_partkey % 7 <> 0) AS BIGINT) AS live_count, 0.0::DOUBLE AS index_completeness FROM part")
def collection_stats(spark, d):
    c = _collection(spark, d)
    c.delete(_t(spark, d, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id")))
    return c.stats()


@_register("collection_query", f"WITH {_PART_SQL}, s AS (SELECT *, abs(size - 20.0::DOUBLE) AS distance FROM p WHERE price > 905), r AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM s) SELECT CAST(rank AS INT) AS rank, id, distance, name FROM r WHERE rank <= 10")
def collection_query(spark, d):
    return _round(_collection(spark, d).query(QueryContext([VectorQuery("v", [20.0, 1.0])], filter="price > 905", output_fields=["name"])))


@_register("ddl_add_column", f"WITH {_PART_SQL} SELECT id, CASE WHEN id <= 20 THEN 7 ELSE 5 END AS grade FROM p")
def ddl_add_column(spark, d):
    c = _collection(spark, d)
    c.add_column(Field("grade", "int32"), "5")
    c.upsert(_part_rows(spark, d, "p_partkey <= 20").withColumn("grade", F.lit(7)))
    return c.live().select("id", "grade")


@_register("ddl_drop_rename_column", f"WITH {_PART_SQL} SELECT id, name AS title, size FROM p")
def ddl_drop_rename_column(spark, d):
    c = _collection(spark, d)
    c.drop_column("price")
    c.rename_column("name", "title")
    return c.live().drop("v")


@_register("ddl_widen_column", f"WITH {_PART_SQL} SELECT id, name, CAST(CASE WHEN id <= 3 THEN 5000000000 ELSE size END AS BIGINT) AS size_wide, price FROM p")
def ddl_widen_column(spark, d):
    c = _collection(spark, d)
    c.widen_column("size", "int64", "size_wide")
    c.upsert(_part_rows(spark, d, "p_partkey <= 3").withColumn("size_wide", F.lit(5_000_000_000)).drop("size"))
    return c.live().drop("v")


@_register("ddl_vector_fields", f"WITH {_PART_SQL} SELECT id, id <= 10 AS has_extra FROM p")
def ddl_vector_fields(spark, d):
    c = _collection(spark, d)
    c.add_vector(Vector("extra", 1))
    c.add_vector(Vector("gone", 1))
    c.upsert(_part_rows(spark, d, "p_partkey <= 10").withColumn("extra", F.array(F.lit(1.0).cast("float"))))
    c.drop_vector("gone")
    return c.live().select("id", F.col("extra").isNotNull().alias("has_extra"))


# --- batches and indexes -------------------------------------------------------------------------------------------


def _batch(spark, d, metric: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return batch_knn(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 10, metric)


def _batch_sql(distance: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {distance} AS distance FROM embeddings q JOIN embeddings c ON q.vec_id % 25 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 10"""


_A, _B = "q.embedding::DOUBLE[]", "c.embedding::DOUBLE[]"
for _m, _sql in (
    ("l2", f"list_distance({_A}, {_B})"),
    ("ip", f"(-list_dot_product({_A}, {_B}))"),
    ("cosine", f"(1 - list_dot_product({_A}, {_B}) / (sqrt(list_dot_product({_A}, {_A})) * sqrt(list_dot_product({_B}, {_B}))))"),
):
    _register(f"batch_knn_{_m}", _batch_sql(_sql))(lambda spark, d, m=_m: _round(_batch(spark, d, m)))


@_register(
    "recall_at_k",
    f"""WITH b AS ({_batch_sql(f"list_distance({_A}, {_B})")}) SELECT query_id, count(*) FILTER (WHERE rank <= 6)::DOUBLE / count(*) AS recall FROM b GROUP BY query_id""",
)
def recall_query(spark, d):
    near = _batch(spark, d, "l2")
    return recall_at_k(near, near.where("rank <= 6"))


_CENTROIDS = [[1.0 if i % 8 == c else -0.1 for i in range(DIM)] for c in range(8)]
_NEAREST = "list_aggregate([" + ", ".join(f"{{'d': list_distance(embedding::DOUBLE[], {_sql_list(c)}), 'i': {i}}}" for i, c in enumerate(_CENTROIDS)) + "], 'min')"
_PROBED = ", ".join(map(str, cells.probe(Q0, _CENTROIDS, 3)))


@_register(
    "ivf_probe",
    f"""WITH c AS (SELECT vec_id AS id, embedding, {_NEAREST}.i AS cell FROM embeddings), s AS (SELECT id, {_L2} AS distance FROM c WHERE cell IN ({_PROBED})),
r AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM s) SELECT CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 10""",
)
def ivf_probe(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return with_rank(_round(cells.search_cells(cells.assign_cells(v, _CENTROIDS), _CENTROIDS, Q0, 10, "l2", 3)), "distance", "id")


_INDEXED = CollectionSchema("embedding", [Vector("embedding", DIM)], [Field("label", "int32")])


def _indexed(spark, d, nprobe: int) -> DataFrame:
    """A search of a stored collection through its index by cells."""
    c = Database(spark, _db_root(spark)).create_collection("indexed", _INDEXED)
    c.insert(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding"))
    c.create_index("embedding", "ivf", nlist=16)
    c.optimize()
    return _round(c.query(QueryContext([VectorQuery("embedding", Q0, nprobe=nprobe)], output_fields=["label"])))


@_register("collection_ivf_all_cells", _knn_sql(_L2))
def collection_ivf_all_cells(spark, d):
    """With all cells probed the result is the exact one; tests/test_store.py holds fewer cells against it."""
    return _indexed(spark, d, 16)


@_register(
    "sq8_rerank",
    f"""WITH c AS (SELECT vec_id AS id, embedding, list_transform(embedding::DOUBLE[], lambda x: greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor((x + 1.0::DOUBLE) / (2.0::DOUBLE / 255) + 0.5::DOUBLE))) * (2.0::DOUBLE / 255) - 1.0::DOUBLE) AS z FROM embeddings),
n AS (SELECT *, row_number() OVER (ORDER BY list_distance(z, {_sql_list(Q0)}), id) AS near FROM c), s AS (SELECT id, {_L2} AS distance FROM n WHERE near <= 64),
r AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM s) SELECT CAST(rank AS INT) AS rank, id, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 10""",
)
def sq8_rerank(spark, d):
    e = _t(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), cells.quantised(F.col("embedding"), -1.0, 1.0).alias("codes"))
    return with_rank(_round(cells.search_quantised(rows, Q0, 10, "l2", -1.0, 1.0)), "distance", "id")


@_register(
    "normalise_scores",
    f"""WITH {_EMB_SQL} SELECT id, round({_NORM['l2'].format(_L2)}, 6) AS n_l2, round({_NORM['ip'].format(_IP)}, 6) AS n_ip, round({_NORM['cosine'].format(_COS)}, 6) AS n_cosine FROM e""",
)
def normalise_scores(spark, d):
    e, q, h = emb(spark, d), D.vector_literal(Q0), D.vector_literal(QH)
    l2, ip, cos = D.l2(F.col("embedding"), q), D.ip(F.col("embedding"), q), D.cosine(F.col("head"), h)
    return e.select("id", *[F.round(D.similarity(m, x), 6).alias(f"n_{m}") for m, x in (("l2", l2), ("ip", ip), ("cosine", cos))])


@_register(
    "global_rank",
    "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders",
)
def global_rank_query(spark, d):
    from .operators.ranking import global_rank

    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return global_rank(o, "o_totalprice", ["id"], "place").select("id", "place")


@_register(
    "positional_take",
    "SELECT pos, id FROM (SELECT n_name, n_nationkey AS id, row_number() OVER (ORDER BY n_name) - 1 AS row_pos FROM nation) JOIN (VALUES (0, 4), (1, 0), (2, 4)) v(pos, p) ON row_pos = p",
)
def positional_take_query(spark, d):
    from .sources.files import positional_take

    n = _t(spark, d, "nation").withColumn("row_pos", F.row_number().over(Window.orderBy("n_name")) - 1)
    return positional_take(n, [4, 0, 4]).select(F.col("pos").cast("int").alias("pos"), F.col("n_nationkey").alias("id"))
