"""The pipeline against a brute-force version, stage by stage."""

import numpy as np

import corpus_pipeline as P
from test_llm_queries import check_layout, classes, kept_lines


def test_stages(spark, sf, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    good = P.keep_quality(spark, docs, sf).cache()
    labels = {r[0]: r[1] for r in duck.sql("SELECT doc_id, quality FROM labels").fetchall()}
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert good.columns == columns and np.mean([(d in kept) == q for d, q in labels.items()]) > 0.95

    cut = P.cut_lines(spark, good, sf).cache()
    texts = kept_lines([(r["doc_id"], r["text"]) for r in good.orderBy("doc_id").collect()])
    assert cut.columns == columns
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert {d: t for d, (t, _) in rows.items()} == {d: t for d, t in texts.items() if t.strip()}
    assert all(n == len(t) for t, n in rows.values())

    single = P.drop_copies(spark, cut, sf).cache()
    assert {r["doc_id"] for r in single.select("doc_id").collect()} == {c for _, c in classes([(d, t) for d, (t, _) in rows.items()]).values()}

    mixed = P.mix(spark, single, sf).cache()
    assert mixed.columns == columns
    sizes = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in single.collect()}
    took = mixed.groupBy("doc_id").count().collect()
    words = sum(sizes[r["doc_id"]][1] * r["count"] for r in took)
    assert max(r["count"] for r in took) <= 2 and abs(words - 1.5 * sum(n for _, n in sizes.values())) < 0.1 * words

    packed = P.pack(spark, mixed, sf).toPandas()
    check_layout(packed)
    assert len(packed[packed.piece == 0]) == mixed.count()


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "gram_join", "mix", "pack"]
