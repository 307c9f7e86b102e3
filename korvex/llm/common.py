"""Shared plumbing of the training-data operators: the shared folder, tables written to cut lineage, salted ranks,
and distributed connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BATCH_ROWS = 2000
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session. Only where it is unset (tests on one
    machine) a temporary folder is made, and made the checkpoint folder of that session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="korvex-shared-")
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


class Workspace:
    """Intermediate tables of one operator call, in a folder of their own below :func:`shared_dir`.

    A table that was written is read back from shared storage, so a lost executor costs a re-read and no recompute,
    and no iteration drags a growing lineage along. ``drop`` removes tables that later steps no longer need.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        # documents are long: ten thousand of them in one Arrow batch would cost a worker hundreds of megabytes
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        self.root = f"{shared_dir(spark)}/korvex/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def tidy(self) -> None:
        """Let Spark's cleaner see that finished steps are out of use, so that their shuffle files go now; and return what
        the driver freed to the system, which else adds up over the hundreds of queries of a few operators."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        trim_jvm(self.spark)
        give_back()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim_jvm(spark: SparkSession) -> None:
    """Return memory that the driver's JVM has freed outside its heap (compilers, threads, buffers) to the system. A JVM
    without the command System.trim_native_heap is left as it is."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by reflection on the interface: the class of the server is closed to py4j
        methods = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
        invoke = next(m for m in methods if m.getName() == "invoke")
        given = new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = name, "systemTrimNativeHeap"
        invoke.invoke(server, given)
    except Py4JError:
        pass


def give_back() -> None:
    """Return freed memory to the system. Workers live on from step to step, and several idle ones of an executor would
    each keep the most that any of their tasks took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def thrifty(work: Callable) -> Callable:
    """``work`` (batches of a task to batches), giving back its memory at the end of the task."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def thrifty_group(work: Callable) -> Callable:
    """The same for a function of a key and its group, or of two groups."""

    def run(left, right):
        out = work(left, right)
        give_back()
        return out

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def salted_rank(
    df: DataFrame, key: list[str], order: list[str], bucket: Column, amount: str, out_start: str
) -> DataFrame:
    """Running total of ``amount`` before each row, per ``key``, in the order (bucket, *order).

    A plain window over ``key`` puts a hot key in one task. Here a key's rows are dealt over ``bucket`` (which must
    follow the wanted order), each bucket is summed, the small table of bucket sums is accumulated, and only rows of
    one (key, bucket) share a task. Null keys are kept: joins are null-safe.
    """
    df = df.withColumn("__b", bucket)
    sums = df.groupBy(*key, "__b").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*key, "__b", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    renamed = bases.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__b").alias("__kb"), "__base")
    on = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)] + [F.col("__b") == F.col("__kb")]
    )
    inside = Window.partitionBy(*key, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return (
        local.join(renamed, on)
        .withColumn(out_start, F.col("__base") + F.col("__local"))
        .drop("__b", "__kb", "__base", "__local", *[f"__k{i}" for i in range(len(key))])
    )


def connected_components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b: long); component is its smallest reachable node.

    Alternating large-star and small-star steps: each moves edges towards smaller nodes, every step is written to the
    shared folder and re-read, and the loop ends when a count and checksum of the edge set stop changing. Nothing but
    that one row of totals reaches the driver.
    """
    spark = ws.spark
    current = ws.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    seen, step = state(current), 0
    while seen[0]:
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = ws.save(least, f"{name}-m{step}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = ws.save(large.distinct(), f"{name}-l{step}")
        # small star: a node and its smaller neighbours are tied to the smallest of them; all edges point down already
        least = ws.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-s{step}")
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        following = ws.save(small.where("a <> b").distinct(), f"{name}-{step + 1}")
        ws.drop(f"{name}-m{step}", f"{name}-l{step}", f"{name}-s{step}", f"{name}-{step}")
        now = state(following)
        current, step = following, step + 1
        if now == seen:
            break
        seen = now
    out = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return out.unionByName(roots)


def write_bytes(uri: str, data: bytes) -> None:
    """Write a whole file below the shared folder from a task: to a name of this attempt, then moved into place, so a
    retried or speculative task leaves one complete file."""
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt, compression=None) as out:
        out.write(data)
    fs.move(attempt, path)


def read_bytes(uri: str, most: int | None = None) -> bytes:
    """A file, or its first ``most`` bytes."""
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read(most)
