"""Global ranks: many buckets, and a value that most rows have."""

from pyspark.sql import functions as F

from korvex.operators.ranking import global_rank


def test_buckets_cost_steps_not_comparisons(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 3001).cast("double").alias("v"))
    got = global_rank(df, "v", ["id"], "place", 300)
    assert got._jdf.queryExecution().analyzed().toString().count(" > ") < 50
    rows = sorted(map(tuple, got.select("v", "id", "place").collect()))
    assert [r[2] for r in rows] == list(range(1, 3001))


def test_one_value_is_divided(spark):
    df = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(F.lit(7)).alias("v"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = global_rank(df, "v", ["key"], "place", 40).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    tasks = [r["task"] for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < 2400
    assert [r["place"] for r in sorted(got, key=lambda r: (r["v"], r["key"]))] == list(range(1, 4001))


def test_odd_values_and_missing_ties(spark):
    nan, inf = float("nan"), float("inf")
    data = [(v, t) for v in (nan, inf, -inf, 0.0, -1.5) for t in (None, "", "a", "é", "z")]
    df = spark.createDataFrame(data, "v double, t string")
    got = global_rank(df.repartition(3), "v", ["t"], "place", 6).orderBy("v", "t").collect()
    assert [r["place"] for r in got] == list(range(1, 26))
    assert global_rank(df.where("false"), "v", ["t"], "place", 6).count() == 0
