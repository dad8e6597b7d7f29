"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.session import cut, shared_dir, written

__all__ = ["components", "cut", "discard", "fresh", "release", "shared_dir", "shuffle_partitions", "small", "trimmed", "written"]


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, which nothing reads any more."""
    spark = table.sparkSession
    for place in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trimmed() -> None:
    """Give a worker's free memory back to the system at the end of its task; the
    worker lives on, and would hold the most that it ever used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files that no DataFrame needs any more.

    It works on what the JVM has found unreachable, in a thread of its own, so
    this asks a few times, some seconds in all."""
    for _ in range(4):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few texts are Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


#: so many edges' nodes are broadcast: some 20 MB
FEW_EDGES = 500_000
SALTS = 16


def _with_least(arcs: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    if edges <= FEW_EDGES:
        return arcs.join(F.broadcast(least), "u")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = arcs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.withColumn("salt", salts), ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: rows (node, root), root the
    smallest node of the component.  Nodes without an edge do not appear.

    Alternating large-star and small-star rounds (Kiveris et al., Connected
    Components in MapReduce and Beyond, 2014).  Each round is two joins and
    aggregations on the edge list, cut by a checkpoint.  The joins give each
    arc the least neighbour of its end: up to FEW_EDGES these are broadcast,
    beyond that the arcs of a node are salted, as a star's centre may have any
    number of them.
    """
    both = [F.col("u"), F.col("v")]
    edges = cut(
        edges.select(F.greatest(*both).alias("u"), F.least(*both).alias("v")).filter("u <> v").distinct()
    )
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        seen = now
        arcs = edges.union(edges.select("v", "u"))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(arcs, least, now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _with_least(large, least, now[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        edges = cut(small)
