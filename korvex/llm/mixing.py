"""Mixing sources to target weights by a low-discrepancy source schedule (DataFrame operations only).

Every source's documents are put in a hash-shuffled order and laid end to end as one stream of words, cut into blocks
of equal size. A golden-ratio sequence is mapped through the cumulative target shares of the sources, so slot i of the
mix belongs to one source; the slots of a source are ranked, and slot rank r takes block r of its stream (a second pass
starts when the blocks are used up). The last slot of a source is cut at its target, and sources that the sequence
leaves a few slots short get them at the end, so the words taken equal the target rounded down.

Defined cases: null text has size 0; null source is a source of its own, ordered last; documents of size 0 are never
taken; rows that repeat a doc_id are documents of their own (equal rows may swap places); an empty table gives no rows;
extra columns of the input are ignored by :func:`mix_schedule` and kept by :func:`mix_documents`.

No step gathers a source: ranks and running totals go through 1024 hash buckets a source, and joins run on
(source, block) or on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, salted_rank, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
SLOT_CHUNK = 1 << 14
GRID = 1 << 16
POINTS = 1 << 31
#: 2**31 divided by the golden ratio, made odd: i * GOLDEN mod 2**31 is the golden-ratio sequence in integers.
GOLDEN = 1327217885


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(stats: DataFrame, weights: tuple[float, ...], budget: float, max_repeat: float) -> DataFrame:
    """One row per source (sn, s): source_size, target, and its interval [lo, hi) of the points.

    Weights repeat over the sources in code point order. Shares are filled like water: sources whose share exceeds
    ``max_repeat`` times their size stop there and the rest is shared by weight among the others. The table has a row
    per source, so its windows over all sources stay small.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy("sn", "s")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_source = stats.groupBy("sn", "s").agg(F.sum("size").alias("source_size"))
    t = (
        by_source.withColumn("__n", F.row_number().over(in_order) - 1)
        .withColumn("w", F.get(cycle, F.pmod("__n", F.lit(len(weights))).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("total", F.least("total", F.sum("cap").over(everything)))
    )
    filling = Window.orderBy(F.col("cap") / F.col("w"), "sn", "s")
    t = (
        t.withColumn("__k", F.row_number().over(filling))
        .withColumn("__below", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__rest", F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("total") - F.col("__below")) / F.col("__rest"))
        .withColumn("__open", F.col("__level") * F.col("w") <= F.col("cap"))
        .withColumn("__l", F.min(F.when(F.col("__open"), F.struct("__k", "__level"))).over(everything))
        .withColumn("target", F.coalesce(F.least("cap", F.col("__l.__level") * F.col("w")), F.col("cap")))
    )
    upto = F.sum("target").over(in_order)
    whole = F.greatest(F.sum("target").over(everything), F.lit(1.0))
    return (
        t.withColumn("__hi", upto / whole * POINTS)
        .withColumn("__lo", (upto - F.col("target")) / whole * POINTS)
        .select(
            "sn",
            "s",
            "source_size",
            "target",
            F.floor("target").cast("long").alias("quota"),
            F.round("__lo").cast("long").alias("lo"),
            F.round("__hi").cast("long").alias("hi"),
        )
    )


def mix_schedule(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    max_repeat: float = 2.0,
    block_words: int = 2048,
    ws: Workspace | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of the document, repeats counted), first_slot
    (the slot of the mix in which its first word comes; null if none does): ordered by it, the documents are the mix, and
    every stretch of it holds the sources near their shares."""
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "mix")
    stats = ws.save(
        docs.select(
            "doc_id",
            F.col("source").isNull().alias("sn"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"),
            word_count(text_or_empty()).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffled"),
        ),
        "stats",
    )
    targets = ws.save(source_targets(stats, weights, budget, max_repeat), "targets")
    total = targets.agg(F.sum("quota")).first()[0] or 0
    # blocks shrink on small inputs, so that the schedule always has some thousands of slots
    size = max(1, min(block_words, total // 8192))

    bucket = F.pmod(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long"), F.lit(1 << 32))
    streams = salted_rank(
        stats, ["sn", "s"], ["shuffled", "size"], F.floor(bucket / ((1 << 32) // BUCKETS)).cast("int"), "size", "start"
    )
    streams = ws.save(streams.withColumn("end", F.col("start") + F.col("size")), "streams")

    slots = _slots(spark, ws, targets, total, size)
    first = slots.select("sn", "s", F.col("rank").alias("block"), "slot")
    blocks = (
        slots.join(targets.select("sn", "s", "source_size", "quota"), ["sn", "s"])
        .withColumn("__blocks", F.ceil(F.col("source_size") / size).cast("long"))
        .withColumn("block", F.pmod(F.col("rank"), F.col("__blocks")))
        .withColumn("pass", F.expr("rank div __blocks"))
        .withColumn("__before", F.col("pass") * F.col("source_size") + F.col("block") * size)
        .withColumn("__length", F.least(F.lit(size), F.col("source_size") - F.col("block") * size))
        .withColumn("upto", F.col("block") * size + F.greatest(F.lit(0), F.least("__length", F.col("quota") - F.col("__before"))))
        .groupBy("sn", "s", "block")
        .agg(F.collect_list("upto").alias("uptos"))
    )
    pieces = (
        streams.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(end - 1) div {size}"))))
        .withColumn("__from", F.greatest("start", F.col("block") * size))
        .withColumn("__to", F.least("end", (F.col("block") + 1) * size))
    )
    words = F.aggregate(
        F.coalesce("uptos", F.array().cast("array<bigint>")),
        F.lit(0).cast("long"),
        lambda a, u: a + F.greatest(F.lit(0).cast("long"), F.least(u, F.col("__to")) - F.col("__from")),
    )
    taken = (
        pieces.join(blocks, ["sn", "s", "block"], "left")
        .groupBy("sn", "s", "start", "doc_id", "size")
        .agg(F.sum(words).alias("taken"))
        .withColumn("block", F.when(F.col("taken") > 0, F.expr(f"start div {size}")))
        .join(first, ["sn", "s", "block"], "left")
        .drop("block")
        .withColumnRenamed("slot", "first_slot")
        .unionByName(streams.where("size = 0").select("sn", "s", "start", "doc_id", "size", *[F.lit(x).cast("long").alias(n) for n, x in (("taken", 0), ("first_slot", None))]))
    )
    # one row a source, but no bound on the number of sources: Spark broadcasts it only when it is small enough
    return taken.join(targets.select("sn", "s", "source_size", "target"), ["sn", "s"]).select(
        "doc_id", F.when(~F.col("sn"), F.col("s")).alias("source"), "size", "source_size", "target", "taken", "first_slot"
    )


def _slots(spark, ws: Workspace, targets: DataFrame, total: int, size: int) -> DataFrame:
    """(sn, s, rank, slot) of every slot of the mix that a source uses; slots that the sequence leaves a source short of
    follow after all others."""
    wanted = targets.where("quota > 0").withColumn(
        "wanted",
        F.when(F.col("quota") <= F.col("source_size"), F.ceil(F.col("quota") / size)).otherwise(
            F.ceil(F.col("source_size") / size) + F.ceil((F.col("quota") - F.col("source_size")) / size)
        ),
    )
    cell = POINTS // GRID
    spread = wanted.where("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}")))
    )
    points = spark.range(-(-total // size)).select(
        F.col("id").alias("slot"), F.expr(f"(id % {POINTS}) * {GOLDEN} % {POINTS}").alias("point")
    )
    drawn = (
        points.withColumn("cell", F.expr(f"point div {cell}"))
        .join(spread.select("cell", "lo", "hi", "sn", "s"), "cell")
        .where("point >= lo and point < hi")
        .select("slot", "sn", "s", F.lit(1).cast("long").alias("one"))
    )
    ranked = ws.save(
        salted_rank(drawn, ["sn", "s"], ["slot"], F.expr(f"slot div {SLOT_CHUNK}"), "one", "rank").select("sn", "s", "rank", "slot"), "ranked"
    )
    counts = ranked.groupBy("sn", "s").agg(F.count(F.lit(1)).alias("drawn"))
    used = ranked.join(wanted.select("sn", "s", "wanted"), ["sn", "s"]).where("rank < wanted").select("sn", "s", "rank", "slot")
    short = (
        wanted.join(counts, ["sn", "s"], "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .where("drawn < wanted")
        .select("sn", "s", F.explode(F.sequence(F.col("drawn"), F.col("wanted") - 1)).alias("rank"))
        .withColumn("slot", F.col("rank") + -(-total // size))
    )
    return used.unionByName(short)


def mix_documents(docs: DataFrame, slot: str | None = None, **options) -> DataFrame:
    """The mixed corpus: each input row as often as the mix takes it, to the nearest whole number (0, 1 or 2 times
    under the default ``max_repeat``). Rows that repeat a (doc_id, source, size) share what is taken of them evenly.
    ``slot`` names a column to add: the slot of the mix to which a row belongs, for an ordered write or read."""
    columns = [*docs.columns, *([slot] if slot else [])]
    taken = (
        mix_schedule(docs, **options)
        .groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"))
        .agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("__times"), F.min("first_slot").alias(slot or "__slot"))
        .where("__times >= 0.5")
    )
    keyed = docs.withColumn("__size", word_count(text_or_empty()))
    same = (
        F.col("doc_id").eqNullSafe(F.col("__d"))
        & F.col("source").cast("string").eqNullSafe(F.col("__s"))
        & (F.col("__size") == F.col("__z"))
    )
    copies = F.array_repeat(F.lit(0), F.floor(F.col("__times") + 0.5).cast("int"))
    return keyed.join(taken, same).withColumn("__copy", F.explode(copies)).select(*columns)
