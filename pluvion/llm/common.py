"""Helpers that several operators share: scratch storage, prefix sums, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, as in tests on one machine, a temporary folder is set; on a cluster that
    would lie on each executor's own disk, so there it raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="pluvion-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return spark.conf.get("spark.checkpoint.dir", None) or named


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From here on Python workers of this session get at most ``rows`` rows at a time.

    For a DataFrame that is returned and run later, which ``batches_of`` can't reach. The text of
    a batch is in memory several times (in the JVM, as Arrow and as Python strings), so the
    default of 10,000 whole texts is much for an executor. Never raises a lower setting.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, before) if before > 0 else rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, Python workers get at most ``rows`` at a time: for jobs whose rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these tables, once nothing reads them any more."""
    for path in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        if path.rpartition("/")[2].startswith("table-"):
            spark = tables[0].sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def perhaps_in(df: DataFrame, column: str, ids: DataFrame, flag: str | None = None, log_bits: int = 24) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among ``ids`` (one column), or all with ``flag``.

    ``ids`` become a bitmap of 2 ** ``log_bits`` bits by hash, so what is broadcast has at most
    2 ** (log_bits - 6) rows whatever the size of ``ids``. Rows outside need no shuffle; those
    inside are still to be joined exactly. Nulls are not inside.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << log_bits))
    at = ids.select(place(F.col(ids.columns[0])).alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("_bits"))
    spot = place(F.col(column))
    both = df.withColumn("_spot", F.when(F.col(column).isNotNull(), spot)).withColumn("_word", F.shiftright("_spot", 6)).join(F.broadcast(at), "_word", "left")
    inside = F.coalesce(F.expr("shiftright(_bits, cast(_spot & 63 AS int)) & 1") == 1, F.lit(False))
    if flag is None:
        return both.where(inside).select(*df.columns)
    return both.select(*df.columns, inside.alias(flag))


def cut(df: DataFrame, rows_each: int = 50_000) -> DataFrame:
    """``df`` checkpointed reliably, read in partitions of ``rows_each`` rows or more: what follows
    a small table need not write a shuffle file for each of many empty partitions."""
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    gc.collect()  # frames of earlier rounds hold their plans in the driver until they are let go
    df.sparkSession._jvm.System.gc()  # and the driver's heap grows beyond what it needs before it lets them go itself
    return done.coalesce(max(1, done.count() // rows_each))


def running_total(values: Column, block: int = 256) -> Column:
    """Inclusive prefix sums of an array of longs.

    A fold that appends to its own result copies it at every step, so the array is
    cut into blocks: a fold over block sums, and a fold inside each block.
    """
    def scan(xs: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("t"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(
            xs, zero,
            lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.array_append(acc["a"], acc["t"] + x).alias("a")),
            lambda acc: acc["a"],
        )

    n = F.size(values)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.slice(values, i, block))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    before = F.aggregate(
        sums,
        F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("a")),
        lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.array_append(acc["a"], acc["t"]).alias("a")),
        lambda acc: acc["a"],
    )
    return F.when(n <= block, scan(values, F.lit(0))).otherwise(
        F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before.alias("s")), lambda z: scan(z["b"], z["s"])))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``.

    Returns ``(node, component)`` with the smallest node of each component, for nodes
    that have an edge. Alternates large-star and small-star steps (Kiveris et al.,
    2014); each is a grouped minimum and an equi-join, so a node with very many edges
    is combined before the shuffle and its join partition can be split by AQE.
    The edge table is checkpointed every round. Loops and repeated edges are ignored.
    """
    cur = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        ends = cur.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(cur.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        unfinished = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1")
        if unfinished.isEmpty():  # every node points at the smallest of its component, and that at none
            break
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
