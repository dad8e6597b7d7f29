"""Predicates on arcs, masks, pruning, trimming and length constraints."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import let
from arcloom.lattice import ARCS, EPSILON, Lattices, lattice, with_fields
from arcloom.operators.distance import backward, forward
from arcloom.plans.batches import Batch, changed, kept, spread

Predicate = Callable[[Column], Column]


def query_filter(label: int | Column, member: int | Column) -> Predicate:
    """Arcs with another input label, or with output label ``member``."""
    return lambda a: (a["ilabel"] != label) | (a["olabel"] == member)


def valid_weight(a: Column) -> Column:
    return ~F.isnan(a["weight"]) & (a["weight"] < math.inf) & (a["weight"] > -math.inf)


def constrained(constraints: str = "constraints") -> Predicate:
    """By a column of structs (position from 0, match, exclude): the output label at
    input label position + 1 must be ``match``, or without one not in ``exclude``."""

    def holds(a: Column) -> Column:
        return F.forall(
            F.filter(constraints, lambda c: c["position"] + 1 == a["ilabel"]),
            lambda c: F.coalesce(c["match"] == a["olabel"], ~F.array_contains(c["exclude"], a["olabel"]), F.lit(True)),
        )

    return holds


def with_constraints(lattices: Lattices, constraints: DataFrame) -> Lattices:
    """Attach constraints (lattice_id, position, match, exclude) as the column that ``constrained`` reads."""
    own = constraints.groupBy("lattice_id").agg(F.collect_list(F.struct("position", "match", "exclude")).alias("constraints"))
    rows = lattices.rows.join(own, "lattice_id", "left")
    none = F.array().cast(own.schema["constraints"].dataType)
    return replace(lattices, rows=rows.withColumn("constraints", F.coalesce("constraints", none)))


def mask_zero(lattices: Lattices, keep: Predicate) -> Lattices:
    """Failing arcs stay, with weight Zero."""
    return lattices.map_arcs(lambda a: with_fields(a, weight=F.when(keep(a), a["weight"]).otherwise(F.lit(math.inf))))


def mask_dead(lattices: Lattices, keep: Predicate) -> Lattices:
    """Failing arcs lead to a dead state, the last."""

    def masked(v: Column) -> Column:
        dead = F.size(v["finals"])
        arcs = F.transform(v["arcs"], lambda a: with_fields(a, dst=F.when(keep(a), a["dst"]).otherwise(dead)))
        return lattice(v["start"], F.concat(v["finals"], F.array(F.lit(math.inf))), F.sort_array(arcs))

    return lattices.derive(masked)


def rm_arc(lattices: Lattices, keep: Predicate) -> Lattices:
    """Failing arcs go, and the states that lie on no path any more."""
    return connect(lattices.with_columns(arcs=F.filter("arcs", keep)))


def connect(lattices: Lattices) -> Lattices:
    """States that the start reaches and that reach a final state, numbered anew;
    a lattice without a path has no states and no start."""
    return lattices.derive(trimmed)


def trimmed(lattice_struct: Column) -> Column:
    """What ``connect`` makes of a struct of start, finals and arcs."""

    def alive(v: Column) -> Column:
        free = F.transform(v["arcs"], lambda a: F.struct(a["dst"].alias("dst"), a["src"].alias("src"), F.lit(0.0).alias("weight")))
        ends = F.transform(v["finals"], lambda f: F.when(f < math.inf, F.lit(0.0)).otherwise(F.lit(math.inf)))
        seen = let(
            free,
            lambda fr: F.zip_with(
                forward(fr, v["start"], F.size(v["finals"]), "tropical"), backward(fr, ends, "tropical"), lambda a, b: a + b
            ),
        )
        return F.filter(F.transform(seen, lambda d, s: F.when(d < math.inf, s)), lambda s: s.isNotNull())

    def placed(k: Column, n: Column) -> Column:
        """Array by old state: the new number, null for those that go."""
        here = F.transform(k, lambda s, i: F.struct(s.alias("state"), i.alias("new")))
        gone = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), k), lambda s: F.struct(s.alias("state"), F.lit(None).cast("int").alias("new")))
        return F.transform(F.sort_array(F.concat(here, gone)), lambda s: s["new"])

    def fewer(v: Column, k: Column, new: Column) -> Column:
        arcs = F.filter(v["arcs"], lambda a: F.get(new, a["src"]).isNotNull() & F.get(new, a["dst"]).isNotNull())
        return lattice(
            F.when(F.size(k) > 0, F.get(new, v["start"])),
            F.transform(k, lambda s: F.get(v["finals"], s)),
            F.transform(arcs, lambda a: with_fields(a, src=F.get(new, a["src"]), dst=F.get(new, a["dst"]))),
        )

    def kept(v: Column, k: Column) -> Column:
        some = let(placed(k, F.size(v["finals"])), lambda new: fewer(v, k, new))
        return F.when(F.size(k) == F.size(v["finals"]), whole(v)).otherwise(some)

    def whole(v: Column) -> Column:
        return lattice(v["start"], v["finals"], v["arcs"])

    def is_whole(v: Column) -> Column:
        """Whether an arc leads to every state but the start, and one from every state that is not final: as arcs lead to
        larger numbers, going back, or on, then ends in the start, or a final state.  No fold over the arcs is needed."""
        n = F.size(v["finals"])
        ends = F.filter(F.transform(v["finals"], lambda f, s: F.when(f < math.inf, s)), lambda s: s.isNotNull())
        led_to = F.array_union(v["arcs"]["dst"], F.array(v["start"]))
        return v["start"].isNotNull() & (F.size(led_to) == n) & (F.size(F.array_union(v["arcs"]["src"], ends)) == n)

    return let(lattice_struct, lambda v: F.when(is_whole(v), whole(v)).otherwise(let(alive(v), lambda k: kept(v, k))))


def _posterior_costs(v: Column, semiring: str = "log") -> Column:
    """Struct of the mass and the posterior cost of each arc."""
    both = F.struct(
        forward(v["arcs"], v["start"], F.size(v["finals"]), semiring).alias("alpha"),
        backward(v["arcs"], v["finals"], semiring).alias("beta"),
    )
    return let(
        both,
        lambda d: F.struct(
            F.get(d["beta"], v["start"]).alias("mass"),
            F.transform(v["arcs"], lambda a: F.get(d["alpha"], a["src"]) + a["weight"] + F.get(d["beta"], a["dst"])).alias("costs"),
        ),
    )


def prune_arcs(lattices: Lattices, threshold: float, floor: float | None = None) -> Lattices:
    """Arcs whose posterior is over ``threshold`` costlier than the best arc's go; with a
    ``floor`` they stay with that weight, which also bounds the best."""
    least = math.inf if floor is None else floor

    def pruned(v: Column) -> Column:
        def weighed(p: Column) -> Column:
            best = F.least(F.coalesce(F.array_min(p["costs"]), F.lit(math.inf)), F.lit(least))
            return let(
                best,
                lambda b: F.zip_with(
                    v["arcs"], p["costs"], lambda a, c: with_fields(a, weight=F.when(c > b + threshold, F.lit(least)).otherwise(a["weight"]))
                ),
            )

        return lattice(v["start"], v["finals"], F.filter(let(_posterior_costs(v), weighed), valid_weight))

    return connect(lattices.derive(pruned))


def prune_paths(lattices: Lattices, threshold: float) -> Lattices:
    """What lies on a path within ``threshold`` of the best one stays."""

    def pruned(v: Column) -> Column:
        arcs = let(
            _posterior_costs(v, "tropical"),
            lambda p: F.filter(
                F.zip_with(v["arcs"], p["costs"], lambda a, c: F.when(c <= p["mass"] + threshold + 1e-9, a)), lambda a: a.isNotNull()
            ),
        )
        return lattice(v["start"], v["finals"], arcs)

    return connect(lattices.derive(pruned))


def expand_positions(arcs: Column, most: Column, label: str) -> Column:
    """Arcs over states (state, k), numbered state * (most + 1) + k: k counts the arcs
    passed whose ``label`` is not epsilon."""
    wide = most + 1

    def at(a: Column, k: Column) -> Column:
        to = k + F.when(a[label] != EPSILON, 1).otherwise(0)
        return F.when(to <= most, with_fields(a, src=a["src"] * wide + k, dst=a["dst"] * wide + to))

    every = F.flatten(F.transform(arcs, lambda a: F.transform(F.sequence(F.lit(0), most), lambda k: at(a, k))))
    return F.sort_array(F.filter(every, lambda a: a.isNotNull()).cast(ARCS))


def set_length(lattices: Lattices, n: int) -> Lattices:
    """Paths with exactly n output labels other than epsilon.

    A state is split by how many labels paths to it have, up to n; of these states and their arcs those
    on a path are kept, numbered in the order of the old ones."""

    def counted(b: Batch) -> pa.Array:
        spoken = (b.olabel != EPSILON).astype(np.int64)
        low, high = b.reads(spoken)
        wide = np.maximum(np.minimum(high, n) - low + 1, 0)
        base = np.cumsum(wide) - wide
        arc, read = np.repeat(np.arange(len(b.src)), wide[b.src]), spread(low[b.src], wide[b.src])
        within = read + spoken[arc] <= n
        arc, read = arc[within], read[within]
        src = base[b.src[arc]] + read - low[b.src[arc]]
        dst = base[b.dst[arc]] + read + spoken[arc] - low[b.dst[arc]]
        old = np.repeat(np.arange(len(wide)), wide)
        finals = np.where(spread(low, wide) == n, b.finals[old], math.inf)
        own = {k: b.fields[k].take(pa.array(arc)) for k in ("ilabel", "olabel", "weight", "features")}
        # a start is read before any label, so it is split into one state; none where that is over n
        starts = base[b.start[b.begun]]
        return kept(b.n, b.of_state[old], b.local[old], finals, starts, {"src": src, "dst": dst, **own})

    return replace(lattices, rows=changed(lattices.rows, counted))


def rm_prefix(lattices: Lattices, k: int) -> tuple[Lattices, DataFrame]:
    """Without the first k states, each of which must have exactly one arc; their
    weight goes to the new start.  Lattices that fail stay; (lattice_id, ok) tells."""

    def walk(v: Column) -> Column:
        def at(state: Column, weight: Column, ok: bool) -> Column:
            return F.struct(state.alias("state"), weight.alias("weight"), F.lit(ok).alias("ok"))

        def step(here: Column, _: Column) -> Column:
            return let(
                F.filter(v["arcs"], lambda a: a["src"] == here["state"]),
                lambda out: F.when(
                    here["ok"] & (F.size(out) == 1),
                    at(F.get(out, F.lit(0))["dst"], here["weight"] + F.get(out, F.lit(0))["weight"], True),
                ).otherwise(at(v["start"], F.lit(0.0), False)),
            )

        first = at(v["start"], F.lit(0.0), True)
        return F.aggregate(F.sequence(F.lit(1), F.lit(k)), first, step) if k else first

    def moved(v: Column, w: Column) -> Column:
        arcs = F.transform(
            v["arcs"], lambda a: with_fields(a, weight=F.when(a["src"] == w["state"], a["weight"] + w["weight"]).otherwise(a["weight"]))
        )
        finals = F.transform(v["finals"], lambda f, s: F.when(s == w["state"], f + w["weight"]).otherwise(f))
        return lattice(w["state"], finals, arcs)

    ok = lattices.rows.select("lattice_id", let(F.struct("start", "finals", "arcs"), walk)["ok"].alias("ok"))
    return connect(lattices.derive(lambda v: let(walk(v), lambda w: moved(v, w)))), ok
