"""Choice of the physical strategy of the distance kernel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: beyond so many states or arcs a lattice is no longer folded within one row
FOLD_STATES, FOLD_ARCS = 2_000, 50_000


@dataclass(frozen=True)
class Shape:
    lattices: int
    most_states: int
    most_arcs: int


def shape(arcs: DataFrame) -> Shape:
    """Sizes of lattices given by arcs (lattice_id, src, dst): one aggregation."""
    per = arcs.groupBy("lattice_id").agg(F.max("dst").alias("states"), F.count("*").alias("arcs"))
    row = per.agg(F.count("*").alias("n"), F.max("states").alias("s"), F.max("arcs").alias("a")).first()
    return Shape(row.n, (row.s or 0) + 1, row.a or 0)


def plan_kernel(sizes: Shape) -> str:
    """``fold`` for many small lattices: one exchange, no Python; ``levels`` for large
    ones: a join and an aggregation per level, no lattice in one row."""
    return "fold" if sizes.most_states <= FOLD_STATES and sizes.most_arcs <= FOLD_ARCS else "levels"
