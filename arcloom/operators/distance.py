"""Semiring distances: the kernel of most lattice operators.

``forward`` and ``backward`` are folds over a lattice's arcs in the order of
their end states, for the many lattices that fit a row.  Lattices too large for
that are taken as frames, one join and aggregation per level (operators/frames.py; see plans/kernels.py).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import entropy_term, let, log_sum
from arcloom.lattice import Lattices, inlined
from arcloom.operators.frames import Levelled
from arcloom.plans.kernels import plan_kernel, shape


def _total(n: Column) -> Column:
    return F.aggregate(n, F.lit(0.0), lambda t, x: t + x)


def _expected(d: Column, a: Column) -> Column:
    """Of an expectation semiring: p ln p of the arc, and p of what follows it."""
    return entropy_term(a["weight"], F.lit(0.0)) + F.exp(-a["weight"]) * d


#: by name: the sum of an array, and what a distance becomes along an arc.  ``count`` counts paths and reads no weights;
#: ``entropy`` sums p ln p over arcs, each weighted by the paths to it; ``label`` has the greatest input label, negated
SEMIRINGS = {
    "log": (log_sum, lambda d, a: d + a["weight"]),
    "tropical": (F.array_min, lambda d, a: d + a["weight"]),
    "count": (_total, lambda d, a: d),
    "entropy": (_total, _expected),
    "label": (F.array_min, lambda d, a: -a["ilabel"].cast("double")),
}


def by_end(arcs: Column) -> Column:
    """The places lo..hi-1 of each run of arcs with one end state."""

    def runs(first: Column) -> Column:
        return F.transform(first, lambda lo, k: F.struct(lo.alias("lo"), F.coalesce(F.get(first, k + 1), F.size(arcs)).alias("hi")))

    heads = F.filter(
        F.transform(arcs, lambda a, i: F.when((i == 0) | (F.get(arcs, i - 1)["dst"] != a["dst"]), i)), lambda i: i.isNotNull()
    )
    return let(heads, runs)


def fold(arcs: Column, seeds: Column, semiring: str = "log") -> Column:
    """Distances d with d[t] = seeds[t] + sum over arcs s -> t of d[s] times weight;
    ``arcs`` are ordered by dst and lead to larger numbers.  ``semiring`` is one of SEMIRINGS.

    One step for each state that arcs lead to, of all of its arcs, so the array of
    distances grows by a copy for a state and not by one for an arc."""
    total, times = SEMIRINGS[semiring]

    def step(done: Column, run: Column) -> Column:
        state, have = F.get(arcs, run["lo"])["dst"], F.size(done)
        # a state that no arc leads to has its seed only
        costs = F.transform(
            F.slice(arcs, run["lo"] + 1, run["hi"] - run["lo"]),
            lambda a: times(F.coalesce(F.get(done, a["src"]), F.get(seeds, a["src"])), a),
        )
        return F.concat(done, F.slice(seeds, have + 1, state - have), F.array(total(F.concat(costs, F.array(F.get(seeds, state))))))

    done = F.aggregate(by_end(arcs), F.array().cast("array<double>"), step)
    return let(done, lambda d: F.concat(d, F.slice(seeds, F.size(d) + 1, F.size(seeds))))


def forward(arcs: Column, start: Column, n: Column, semiring: str = "log") -> Column:
    """Array by state: the sum over all paths from the start."""
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    seeds = let(start, lambda first: F.transform(places, lambda s: F.when(s == first, F.lit(0.0)).otherwise(F.lit(math.inf))))
    return let(seeds, lambda z: fold(arcs, z, semiring))


def backward(arcs: Column, finals: Column, semiring: str = "log") -> Column:
    """Array by state: the sum over all paths to a final state, final costs included."""

    def turned(ends: Column) -> Column:
        last = F.size(ends) - 1
        back = F.transform(
            arcs, lambda a: F.struct((last - a["src"]).alias("dst"), (last - a["dst"]).alias("src"), a["weight"].alias("weight"))
        )
        return F.reverse(let(F.sort_array(back), lambda sorted_back: fold(sorted_back, ends, semiring)))

    return let(F.reverse(finals), turned)


def distances(lattices: Lattices, semiring: str = "log") -> DataFrame:
    """One row per state: lattice_id, state, alpha, beta."""
    rows = with_distances(lattices, semiring)
    each = F.zip_with(F.col("alpha"), F.col("beta"), lambda a, b: F.struct(a.alias("alpha"), b.alias("beta")))
    return inlined(rows, F.transform(each, lambda d, s: F.struct(s.alias("state"), d["alpha"].alias("alpha"), d["beta"].alias("beta"))), "state")


def with_distances(lattices: Lattices, semiring: str = "log") -> DataFrame:
    """The rows with arrays alpha and beta."""
    return lattices.rows.withColumns(
        {
            "alpha": forward(F.col("arcs"), F.col("start"), F.size("finals"), semiring),
            "beta": backward(F.col("arcs"), F.col("finals"), semiring),
        }
    )


def mass(lattices: Lattices, semiring: str = "log") -> DataFrame:
    """lattice_id, mass: the cost of all paths (log) or of the best one (tropical)."""
    beta = backward(F.col("arcs"), F.col("finals"), semiring)
    return lattices.rows.select("lattice_id", F.get(beta, F.col("start")).alias("mass"))


def level_distances(arcs: DataFrame, states: DataFrame, levels: int, semiring: str = "log") -> DataFrame:
    """lattice_id, state, alpha of the states up to level ``levels``, for states that have their level."""
    return Levelled(arcs, states.filter(F.col("level") <= levels)).forward(semiring)


def frame_distances(arcs: DataFrame, states: DataFrame, semiring: str = "log") -> DataFrame:
    """lattice_id, state, alpha for lattices given as frames (arcs and states as ``Lattices`` has them): folded within
    rows where all are small enough for that, else level by level, so that no lattice needs to fit a row."""
    if plan_kernel(shape(arcs)) == "fold":
        found = distances(Lattices.from_frames(arcs, states), semiring).select("lattice_id", "state", "alpha")
        return found.filter(F.col("alpha") < math.inf)
    return Levelled(arcs, states).forward(semiring)
