"""Shared pieces: written tables, integer settings and distributed connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, as in tests, a temporary one is set, but on a local master only: executors elsewhere would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("callweave.scratch.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="callweave-")
        spark.conf.set("callweave.scratch.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a parquet table in the shared folder, read back: cuts lineage and survives lost executors. The shuffle files of the write go when it is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    relieved(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._callweave_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame made by written()."""
    path = getattr(df, "_callweave_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def collected(spark: SparkSession) -> None:
    """Collects the driver's garbage, of plans and broadcasts that nothing refers to any more, so that its heap shrinks; otherwise it grows to its limit over a run of many plans."""
    gc.collect()  # Python's handles keep the JVM's objects alive
    spark._jvm.System.gc()
    _trim_jvm(spark)
    pa.default_memory_pool().release_unused()
    _trim()


#: Share of the driver's largest heap beyond which a written table ends with a collection.
HEAP = 0.6


def relieved(spark: SparkSession) -> None:
    """collected(), if the driver's heap has taken more than the share HEAP of its limit: a stage of many short plans would take all of it before the JVM does so itself."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP * runtime.maxMemory():
        collected(spark)


def _trim_jvm(spark: SparkSession) -> str | None:
    """Gives what the driver's JVM has freed outside its heap back to the machine, as glibc keeps it for each thread; the JVM's answer, None from one without that command."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class
    types, given = array(kind, 4), array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[k] = kind.forName(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by reflection, as the bean's own class is not open to py4j
        return kind.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return None


def _trim() -> None:
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a function of glibc alone
    if trim:
        trim(0)


def collected_on_executors(spark: SparkSession) -> None:
    """Collects the garbage of the executors, whose heaps otherwise stay as large as the largest stage made them, beside the memory of the Python workers of the next."""
    n = max(2, spark.sparkContext.defaultParallelism)
    # a task for each core, so that each executor gets some
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("append").save()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of rows that go to a Python worker, or come from it, at once; a longer row goes alone.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, not by rows alone, so that long texts fill neither executors nor workers. A setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def trimmed(task: Callable) -> Callable:
    """A function over batches that, when done, gives the memory its worker no longer uses back to the machine; workers outlive tasks."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        _trim()

    return run


#: A key that this share of all rows has, as 1 / HOT keys at most can, is not dealt by its hash.
HOT = 0.0005


def joined_once(rows: DataFrame, facts: DataFrame, keys: list[str], copies: str = "copies") -> DataFrame:
    """rows with the one row of facts that has their keys; copies counts a key's rows. Facts of hot keys go to all tasks, so the rows of those stay where they are."""
    many = facts.where(F.col(copies) >= F.lit(HOT * rows.count()))
    rest = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(facts, keys)
    return rest.unionByName(rows.join(F.broadcast(many), keys)).drop(copies)


def text_or_empty(df: DataFrame, name: str = "text"):
    return F.coalesce(df[name].cast("string"), F.lit(""))


def crc_fold(column, folds: int):
    """crc32 of the value as text, modulo folds; a null value falls in fold 0."""
    return F.coalesce(F.crc32(column.cast("string")) % folds, F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a, b (long). Nulls and loops are ignored, repeated edges allowed. Returns one row (id, component) for each end of an
    edge; component is the smallest id reachable. Alternates the large-star and small-star steps, each a minimum by key and a join, until the
    edges no longer change, which they do after a number of rounds that grows with the logarithm of the graph; every round is a written table. Least
    neighbours are found with partial aggregation, so a hot node isn't gathered; in the joins with them adaptive execution splits its edges.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stage = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        low = stage.groupBy("u").agg(F.min("v").alias("m"))
        moved = stage.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        dropped(stage)
        dropped(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).groupBy("id").agg(F.min("component").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
