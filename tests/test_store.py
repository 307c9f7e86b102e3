"""Collections against a dict, and their rules."""

import random

import pytest
from pyspark.sql import functions as F

from korvex.errors import AlreadyExists, InvalidInput, NotFound, ReadOnly, Unsupported
from korvex.plans.context import RRF, GroupBy, OrderBy, QueryContext, ReRanker, VectorQuery
from korvex.schema import SPARSE, CollectionSchema, Field, Vector
from korvex.store.collection import Database, parse_constant

SCHEMA = CollectionSchema("v", [Vector("v", 2), Vector("w", 2, metric="ip"), Vector("sp", 0, SPARSE)], [Field("name", "string", nullable=True), Field("n", "int32", nullable=True)])
ROW = "id long, name string, n int, v array<float>, w array<float>, sp struct<indices:array<long>,values:array<float>>"


def rows(spark, *records):
    full = [(i, name, n, v, None, None) for i, name, n, v in records]
    return spark.createDataFrame(full, ROW)


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def state(c):
    return {r["id"]: (r["name"], r["n"]) for r in c.live().collect()}


def test_state_machine(spark, db):
    c, model, rng = db.create_collection("c", SCHEMA), {}, random.Random(3)
    for step in range(9):
        ids = rng.sample(range(12), 4)
        if step % 3 == 0:
            batch = [(i, f"s{step}", i * step, [1.0, float(i)]) for i in ids]
            assert c.upsert(rows(spark, *batch)) == 4
            model.update({i: (f"s{step}", i * step) for i in ids})
        elif step % 3 == 1:
            assert c.delete(ids[:2] + [99]) == len({*ids[:2]} & set(model))
            for i in ids[:2]:
                model.pop(i, None)
        else:
            patch = spark.createDataFrame([(i, -step) for i in ids], "id long, n int")
            assert c.update(patch, unset=["name"]) == len(set(ids) & set(model))
            model.update({i: (None, -step) for i in ids if i in model})
        assert state(c) == model, step
    c.compact()
    assert state(c) == model and c.compacted
    again = db.open_collection("c")
    assert state(again) == model
    again.vacuum()
    assert state(again) == model


def test_rules(spark, db):
    c = db.create_collection("c", SCHEMA)
    with pytest.raises(AlreadyExists):
        db.create_collection("c", SCHEMA)
    c.insert(rows(spark, (1, "a", 1, [0.0, 0.0]), (2, "b", 2, [1.0, 0.0])))
    for bad in (
        [(1, "x", 1, [0.0, 0.0])],  # live already
        [(5, "x", 1, [0.0])],  # dimension
        [(6, "x", 1, [0.0, 0.0]), (6, "y", 1, [0.0, 0.0])],  # twice
        [(7, "x", 1, None)],  # no primary vector
    ):
        with pytest.raises(InvalidInput):
            c.insert(rows(spark, *bad))
    assert c.delete([404]) == 0
    assert c.delete([1]) == 1 and c.insert(rows(spark, (1, "again", 3, [0.0, 1.0]))) == 1
    assert c.delete_by_filter("n == 2") == 1 and c.delete_by_filter("n == 2") == 0
    with pytest.raises(InvalidInput):
        c.delete_by_filter(" ")
    with pytest.raises(ReadOnly):
        Database(spark, db.root, read_only=True).open_collection("c").delete([1])
    stats = c.stats().first()
    assert (stats["record_count"], stats["deleted_count"], stats["live_count"]) == (2, 1, 1)
    db.drop_collection("c")
    with pytest.raises(NotFound):
        db.open_collection("c")


def test_newer_versions_shadow(spark, db):
    c = db.create_collection("c", SCHEMA)
    c.insert(rows(spark, (1, "near", 1, [0.0, 0.0]), (2, "far", 1, [3.0, 0.0])))
    c.upsert(rows(spark, (1, "moved", 1, [9.0, 0.0])))
    ask = QueryContext([VectorQuery("v", [0.0, 0.0])])
    assert [(r["id"], r["name"]) for r in c.query(ask).collect()] == [(2, "far"), (1, "moved")]
    c.delete([2])
    assert [r["id"] for r in c.query(ask).collect()] == [1]
    with pytest.raises(NotFound):
        c.query(QueryContext([VectorQuery("v", ids=[2])]))


def test_query_rules(spark, db):
    c = db.create_collection("c", SCHEMA)
    c.insert(rows(spark, (1, "a", 10, [1.0, 0.0]), (2, "b", 30, [0.5, 0.0]), (3, "c", 20, [0.8, 0.0]), (4, None, None, [0.0, 0.0])))
    v = VectorQuery("v", [1.0, 0.0])
    ids = lambda ctx: [r["id"] for r in c.query(ctx).collect()]
    assert ids(QueryContext([v], order_by=OrderBy("n"))) == [1, 3, 2, 4]
    assert ids(QueryContext([v], order_by=OrderBy("n", True))) == [4, 2, 3, 1]
    assert ids(QueryContext([v], top_k=0)) == []
    assert ids(QueryContext([v], reranker=RRF())) == [1, 3, 2, 4]
    assert ids(QueryContext([v], filter="n == 12345")) == []
    for ctx, error in (
        (QueryContext(), InvalidInput),
        (QueryContext(filter="n == 1", group_by=GroupBy("n")), InvalidInput),
        (QueryContext([v], group_by=GroupBy("v")), InvalidInput),
        (QueryContext([v], group_by=GroupBy("nothing")), InvalidInput),
        (QueryContext([v], order_by=OrderBy("v")), InvalidInput),
        (QueryContext([VectorQuery("v", [1.0])]), InvalidInput),
        (QueryContext([VectorQuery("sp", [1.0, 2.0])]), InvalidInput),
        (QueryContext([VectorQuery("none", [1.0, 2.0])]), NotFound),
        (QueryContext([VectorQuery("v", [1.0, 0.0], metric="hamming")]), InvalidInput),
        (QueryContext([VectorQuery("v", ids=[1], ef_search=5)]), Unsupported),
        (QueryContext([v], filter="n =="), InvalidInput),
    ):
        with pytest.raises(error):
            c.query(ctx)

    class First(ReRanker):
        def rerank(self, sources):
            return next(iter(sources.values())).select("id", (-F.col("id")).cast("double").alias("fused_score"))

    assert ids(QueryContext([v], reranker=First())) == [1, 2, 3, 4]


def test_schema_changes(spark, db):
    c = db.create_collection("c", SCHEMA)
    c.insert(rows(spark, (1, "alpha", 1, [0.0, 0.0])))
    c.rename_column("name", "label")
    c.add_column(Field("grade", "float64", nullable=True), "1.5")
    c.widen_column("n", "int64")
    c.drop_vector("w")
    r = c.live().first()
    assert (r["label"], r["grade"], r["n"]) == ("alpha", 1.5, 1) and "w" not in r.asDict()
    assert c.schema.field("n").type == "int64"
    for call in (
        lambda: c.drop_column("name"), lambda: c.rename_column("label", "n"), lambda: c.drop_vector("v"), lambda: c.widen_column("n", "int32"),
        lambda: c.add_column(Field("must", "int32")),
    ):
        with pytest.raises((InvalidInput, NotFound, AlreadyExists)):
            call()


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [("null", "int32", None), ("true", "bool", True), ('"x"', "string", "x"), ("-5", "int32", -5), ("1.5", "float64", 1.5), ("1e3", "float64", KeyError), ("+5", "int32", KeyError), ("5", "float64", KeyError), ("-1", "uint32", KeyError), ("2147483648", "int32", KeyError)],
)
def test_constants(text, kind, value):
    if value is KeyError:
        with pytest.raises(InvalidInput):
            parse_constant(text, Field("f", kind))
    else:
        assert parse_constant(text, Field("f", kind)) == value


def test_indexes_and_keys(spark, db):
    c = db.create_collection("c", SCHEMA)
    c.insert(rows(spark, *[(i, f"n{i}", i, [float(i), 1.0]) for i in range(40)]))
    c.create_index("v", "ivf", nlist=3)
    c.create_index("n", "inverted")
    with pytest.raises(InvalidInput):
        c.create_index("v", "ivf", nlist=0)
    with pytest.raises(InvalidInput):
        c.create_index("v", "hnsw_hvq")
    with pytest.raises(InvalidInput):
        c.widen_column("n", "int64")
    assert c.stats().first()["index_completeness"] == 0.0
    c.optimize()
    assert c.stats().first()["index_completeness"] == 1.0
    from korvex.index.cells import read_cells, search_cells

    stored, centroids = read_cells(spark, f"{c.path}/index/v/{c.manifest['data_version']}")
    assert [r["id"] for r in search_cells(stored, centroids, [7.2, 1.0], 2, "l2", 2).collect()] == [7, 8]
    c.delete([3])
    assert c.stats().first()["index_completeness"] == 0.0
    keys = spark.createDataFrame([("12",), ("x",)], "key string")
    assert c.keys.mode == "numeric"
    with pytest.raises(InvalidInput):
        c.keys.resolve(keys)
    assigned = {r["key"]: r["id"] for r in c.keys.assign(keys).collect()}
    assert assigned["12"] == 12 and assigned["x"] == 40 and c.keys.mode == "string"
    assert {r["key"] for r in c.keys.resolve(spark.createDataFrame([("x",), ("zz",)], "key string")).collect()} == {"x"}


def test_sources_and_stream(spark, db, tmp_path):
    from korvex.sources.files import ann_dataset, read_arrow, read_flat_vectors, read_jsonl, write_arrow, write_jsonl
    from korvex.streaming.ingest import upsert_stream

    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, [3.0, 4.0])], "id long, name string, v array<float>")
    write_arrow(df, f"{tmp_path}/arrow")
    write_jsonl(df, f"{tmp_path}/jsonl")
    want = sorted(map(str, df.collect()))
    assert sorted(map(str, read_arrow(spark, f"{tmp_path}/arrow", df.schema).collect())) == want
    assert sorted(map(str, read_jsonl(spark, f"{tmp_path}/jsonl", df.schema).collect())) == want
    import numpy as np

    np.array([5, 6], "<i8").tofile(tmp_path / "ids.bin")
    np.array([[1, 2], [3, 4]], "<f2").tofile(tmp_path / "v.bin")
    got = read_flat_vectors(spark, f"{tmp_path}/ids.bin", f"{tmp_path}/v.bin", 2, half=True).collect()
    assert [(r["id"], list(r["vector"])) for r in got] == [(5, [1.0, 2.0]), (6, [3.0, 4.0])]
    data = ann_dataset(spark, 50, 5, 8, k=3)
    assert data["neighbors"].count() == 5

    c = db.create_collection("s", SCHEMA)
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, False, "a"), (1, 3, False, "c"), (2, 2, True, "b"), (3, 1, False, "d")], "id long, seq long, gone boolean, name string").withColumn("n", F.lit(1)).withColumn(
        "v", F.array(F.lit(0.0).cast("float"), F.lit(0.0).cast("float"))
    ).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    upsert_stream(stream, c, f"{tmp_path}/ck", "seq", "gone").trigger(availableNow=True).start().awaitTermination(120)
    c.refresh()
    assert state(c) == {1: ("c", 1), 3: ("d", 1)}


def test_latest_live_reads_what_is_asked(spark, tmp_path):
    """Columns that nobody asked for are not read, filters reach the scan, and nothing wide is sorted to aggregate."""
    from korvex.operators.latest import latest_live

    rows = [(i % 40, i, i % 7 == 0, f"n{i}", [float(i)] * 4) for i in range(100)]
    spark.createDataFrame(rows, "id long, op_seq long, is_deleted boolean, name string, vec array<float>").write.parquet(str(tmp_path / "log"))
    found = latest_live(spark.read.parquet(str(tmp_path / "log"))).where("name <> 'n1'").select("id", "name")
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "vec" not in plan.replace("Vec", "") and "SortAggregate" not in plan and "Not(EqualTo(name,n1))" in plan
    last = {i: r for r in rows for i in [r[0]]}
    assert {(r["id"], r["name"]) for r in found.collect()} == {(i, r[3]) for i, r in last.items() if not r[2] and r[3] != "n1"}


def test_query_through_cells(spark, tmp_path):
    import numpy as np

    from korvex.plans.context import QueryContext, VectorQuery
    from korvex.schema import CollectionSchema, Field, Vector
    from korvex.store.collection import Database

    rng = np.random.default_rng(5)
    x = (rng.normal(size=(12, 8))[rng.integers(12, size=600)] * 4 + rng.normal(size=(600, 8))).astype(np.float32)
    schema = CollectionSchema("v", [Vector("v", 8)], [Field("n", "int32")])
    c = Database(spark, f"file://{tmp_path}/db").create_collection("c", schema)
    c.insert(spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(x)], "id long, n int, v array<float>"))
    c.create_index("v", "ivf", nlist=12, nprobe=3)
    ask = lambda q, **k: c.query(QueryContext([VectorQuery("v", q, **k)]))
    whole = {i: [r["id"] for r in ask(x[i].tolist()).collect()] for i in range(0, 600, 60)}
    c.optimize()
    hits = 0
    for i, want in whole.items():
        found = ask(x[i].tolist())
        hits += len({*want} & {r["id"] for r in found.collect()})
        assert [r["id"] for r in ask(x[i].tolist(), nprobe=12).collect()] == want
        assert [r["id"] for r in c.query(QueryContext([VectorQuery("v", x[i].tolist())]), exact=True).collect()] == want
    assert hits >= 0.9 * sum(map(len, whole.values()))
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "cell" in plan
    filtered = c.query(QueryContext([VectorQuery("v", x[0].tolist())], filter="n == 4", top_k=200))
    assert filtered.count() == 120  # a filter asks for rows of any cell
    c.upsert(spark.createDataFrame([(0, 9, x[300].tolist())], "id long, n int, v array<float>"))
    assert 0 in [r["id"] for r in ask(x[300].tolist()).collect()]  # the index is not current any more
