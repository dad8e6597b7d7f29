"""Lattices as a stream.

An operator that is an expression over a lattice's row (distances, posteriors,
normalisation, masks, pruning, trimming, best paths) keeps no state, so it
applies to a stream of rows as it does to a table.  Counts of labels over
event time are windowed aggregations with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.lattice import ARCS, Lattices
from arcloom.operators.paths import arcs_with_posterior

SCHEMA = f"lattice_id bigint, start int, finals array<double>, arcs {ARCS}"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16, more: str = "") -> Lattices:
    """Lattices from the Parquet files that arrive in a folder; ``more`` names further columns."""
    schema = SCHEMA + (f", {more}" if more else "")
    return Lattices(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def label_rates(lattices: Lattices, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window, olabel, expected: how often each label is expected per window of the
    lattices' timestamp column ``time``; rows later than ``late`` are left out."""
    stamped = Lattices(
        lattices.rows.select(F.struct("lattice_id", time).alias("lattice_id"), "start", "finals", "arcs", F.col(time).alias("at"))
    )
    p = arcs_with_posterior(stamped).select(F.col(f"lattice_id.{time}").alias("at"), "olabel", "p").withWatermark("at", late)
    return p.groupBy(F.window("at", window), "olabel").agg(F.sum("p").alias("expected"))
