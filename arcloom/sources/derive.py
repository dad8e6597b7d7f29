"""Lattices derived from the relational tables.

order_sausage: an order is a lattice, a line number a position, the parts
ordered under it (mod 50, plus 1) the alternatives, weighted by quantity.
order_lattice adds arcs that skip a position.  token_chain: a document's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.lattice import Lattices

#: so many lines of orders to a task: their lattices, and what operators make of them, are a hundred times as large, which
#: the sizes of shuffled lines, by which Spark would make tasks fewer, do not tell
LINES = 50_000


def order_arcs(spark: SparkSession, sf_dir: str, skips: bool = True) -> DataFrame:
    """lattice_id, src, dst, ilabel, olabel, weight."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("lattice_id"), "l_linenumber", (F.col("l_partkey") % 50 + 1).cast("int").alias("label"), "l_quantity"
    )
    # dealt by order once: all that follows is keyed by it
    lines = lines.repartition(max(2, lines.count() // LINES + 1), "lattice_id")
    slots = lines.groupBy("lattice_id", "l_linenumber", "label").agg(F.sum("l_quantity").alias("q"))
    by_order = Window.partitionBy("lattice_id")
    pos = F.dense_rank().over(by_order.orderBy("l_linenumber"))
    total = F.sum("q").over(Window.partitionBy("lattice_id", "l_linenumber"))
    slots = slots.select("lattice_id", pos.alias("pos"), "label", "q", total.alias("total"))
    slots = slots.withColumn("last", F.max("pos").over(by_order))

    def step(dst: Column, p: Column) -> Column:
        return F.struct(dst.alias("dst"), (-F.log(p)).alias("weight"))

    steps = [step(F.col("pos"), F.col("q") / (1.25 * F.col("total")))]
    if skips:
        skip = step(F.col("pos") + 1, 0.2 * F.col("q") / F.col("total"))
        steps = F.when(F.col("pos") < F.col("last"), F.array(*steps, skip)).otherwise(F.array(*steps))
    else:
        steps = F.array(*steps)
    return slots.select(
        "lattice_id",
        (F.col("pos") - 1).alias("src"),
        F.explode(steps).alias("step"),
        F.col("pos").alias("ilabel"),
        F.col("label").alias("olabel"),
    ).select("lattice_id", "src", F.col("step.dst").alias("dst"), "ilabel", "olabel", F.col("step.weight").alias("weight"))


def order_lattice(spark: SparkSession, sf_dir: str) -> Lattices:
    return Lattices.from_frames(order_arcs(spark, sf_dir))


def order_sausage(spark: SparkSession, sf_dir: str) -> Lattices:
    return Lattices.from_frames(order_arcs(spark, sf_dir, skips=False))
