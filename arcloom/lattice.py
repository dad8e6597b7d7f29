"""Collections of weighted lattices.

A lattice is an acyclic graph of states 0..n-1 numbered so that every arc leads
to a larger number, with arcs (ilabel, olabel, cost) and final costs.  A
collection is one DataFrame with a row per lattice, dealt by lattice_id:

    lattice_id, start, finals ARRAY<DOUBLE> (by state, +inf: not final),
    arcs ARRAY<STRUCT<dst, src, arc_id, ilabel, olabel, weight, features>>, ordered

so operators are expressions over a row and need no further exchange.  The
relational frames (states, arcs) are views of it, and collections are built
from such frames with one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import let

ARC = "struct<dst:int,src:int,arc_id:bigint,ilabel:int,olabel:int,weight:double,features:array<double>>"
ARCS = f"array<{ARC}>"
EPSILON = 0
KEYS = ("lattice_id", "start", "finals", "arcs")


def arc(dst, src, arc_id, ilabel, olabel, weight, features=None) -> Column:
    features = F.lit(None).cast("array<double>") if features is None else features
    return F.struct(
        dst.cast("int").alias("dst"),
        src.cast("int").alias("src"),
        arc_id.cast("long").alias("arc_id"),
        ilabel.cast("int").alias("ilabel"),
        olabel.cast("int").alias("olabel"),
        weight.cast("double").alias("weight"),
        features.alias("features"),
    )


def lattice(start: Column, finals: Column, arcs: Column) -> Column:
    """What ``Lattices.derive`` takes and gives."""
    return F.struct(start.cast("int").alias("start"), finals.alias("finals"), arcs.alias("arcs"))


def with_fields(a: Column, **fields: Column) -> Column:
    names = ("dst", "src", "arc_id", "ilabel", "olabel", "weight", "features")
    return arc(*[fields.get(n, a[n]) for n in names])


def inlined(rows: DataFrame, structs: Column, never_null: str) -> DataFrame:
    """lattice_id and the fields of the structs, a row each.

    The optimizer puts a test for an empty array before an inner generator, and
    pushes it below what makes the array, which is then computed once more; an
    outer one has no such test."""
    return rows.select("lattice_id", F.inline_outer(structs)).filter(F.col(never_null).isNotNull())


@dataclass(frozen=True)
class Lattices:
    rows: DataFrame
    symbols: DataFrame | None = None
    meta: DataFrame | None = None

    @property
    def arcs(self) -> DataFrame:
        """One row per arc: lattice_id, dst, src, arc_id, ilabel, olabel, weight, features."""
        return inlined(self.rows, F.col("arcs"), "dst")

    @property
    def states(self) -> DataFrame:
        """One row per state: lattice_id, state, final, is_start."""
        each = F.transform("finals", lambda f, s: F.struct(s.alias("state"), f.alias("final"), (s == F.col("start")).alias("is_start")))
        return inlined(self.rows, each, "state")

    def with_columns(self, **columns: Column) -> Lattices:
        return replace(self, rows=self.rows.withColumns(columns))

    def map_arcs(self, change: Callable[[Column], Column]) -> Lattices:
        return self.with_columns(arcs=F.transform("arcs", change))

    def derive(self, then: Callable[[Column], Column]) -> Lattices:
        """``then`` maps a struct of start, finals and arcs, computed once however
        often it is used, to one with the new start, finals and arcs."""
        rows = self.rows.select("lattice_id", let(F.struct("start", "finals", "arcs"), then).alias("new"))
        return replace(self, rows=rows.select("lattice_id", "new.start", "new.finals", "new.arcs"))

    @staticmethod
    def from_frames(arcs: DataFrame, states: DataFrame | None = None, symbols: DataFrame | None = None) -> Lattices:
        """From arcs (lattice_id, src, dst, ilabel, olabel, weight[, arc_id, features])
        and states (lattice_id, state, final[, is_start]).  Without states the
        first state starts and the last one is final."""
        names = arcs.columns
        one = arc(
            F.col("dst"),
            F.col("src"),
            F.col("arc_id") if "arc_id" in names else F.lit(0),
            F.col("ilabel"),
            F.col("olabel"),
            F.col("weight"),
            F.col("features") if "features" in names else None,
        )
        rows = arcs.groupBy("lattice_id").agg(F.sort_array(F.collect_list(one)).alias("arcs"))
        if "arc_id" not in names:
            rows = rows.withColumn("arcs", numbered(F.col("arcs")))
        if states is None:
            last = F.array_max(F.transform("arcs", lambda a: a["dst"]))
            finals = F.concat(F.array_repeat(F.lit(math.inf), last), F.array(F.lit(0.0)))
            rows = rows.select("lattice_id", F.lit(0).alias("start"), finals.alias("finals"), "arcs")
        else:
            is_start = F.col("is_start") if "is_start" in states.columns else F.col("state") == 0
            per = states.groupBy("lattice_id").agg(
                F.transform(F.sort_array(F.collect_list(F.struct("state", "final"))), lambda s: s["final"].cast("double")).alias("finals"),
                F.min(F.when(is_start, F.col("state"))).cast("int").alias("start"),
            )
            rows = per.join(rows, "lattice_id", "left")
            rows = rows.select("lattice_id", "start", "finals", F.coalesce("arcs", F.array().cast(ARCS)).alias("arcs"))
        return Lattices(rows, symbols)


def numbered(arcs: Column) -> Column:
    """Arcs with arc_id set to their place in state-major order."""
    by_source = F.sort_array(F.transform(arcs, lambda a: F.struct(a["src"].alias("src"), a.alias("arc"))))
    placed = F.transform(by_source, lambda s, i: with_fields(s["arc"], arc_id=i))
    return F.sort_array(placed)
