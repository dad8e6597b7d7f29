"""Best paths, path counts and position posteriors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.semiring import let
from arcloom.lattice import EPSILON, Lattices, inlined
from arcloom.operators.distance import backward, by_end
from arcloom.plans.batches import Batch, rows_of, summed, with_values

#: a path while it is searched: its cost, its arcs' ids, which settle ties, their places, and its labels where those count
PATH = "array<struct<cost:double,ids:array<bigint>,at:array<int>,hyp:array<int>>>"


def _k_best(arcs: Column, start: Column, finals: Column, k: int, unique: bool) -> Column:
    """The k cheapest complete paths, ties by their arc ids from the start.

    One step for each state that arcs lead to, of all of its arcs: a state keeps its k best, and labels and scores
    are read from the arcs at the end."""

    def shortest(paths: Column) -> Column:
        ordered = F.sort_array(paths)
        if unique:
            # ordered by cost, so the first path with a label sequence is its best
            ordered = F.aggregate(
                ordered,
                F.array().cast(PATH),
                lambda kept, p: F.when(F.exists(kept, lambda q: q["hyp"] == p["hyp"]), kept).otherwise(F.concat(kept, F.array(p))),
            )
        return F.slice(ordered, F.lit(1), F.lit(k))

    def extended(paths: Column, a: Column, at: Column) -> Column:
        longer = F.transform(
            paths,
            lambda p: F.struct(
                (p["cost"] + a["weight"]).alias("cost"),
                F.concat(p["ids"], F.array(a["arc_id"])).alias("ids"),
                F.concat(p["at"], F.array(at)).alias("at"),
                (F.concat(p["hyp"], F.array(a["olabel"])) if unique else p["hyp"]).alias("hyp"),
            ),
        )
        return F.filter(longer, lambda p: p["cost"] < math.inf)

    ints = F.array().cast("array<int>")
    nothing = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<bigint>").alias("ids"), ints.alias("at"), ints.alias("hyp")))
    none = F.array().cast(PATH)

    def seed(state: Column) -> Column:
        return F.when(state == start, nothing.cast(PATH)).otherwise(none)

    def step(done: Column, run: Column) -> Column:
        state, have = F.get(arcs, run["lo"])["dst"], F.size(done)
        own = F.slice(arcs, run["lo"] + 1, run["hi"] - run["lo"])
        reached = F.transform(own, lambda a, i: extended(F.coalesce(F.get(done, a["src"]), seed(a["src"])), a, run["lo"] + i))
        between = F.when(state > have, F.transform(F.sequence(have, state - 1), seed)).otherwise(F.array().cast(f"array<{PATH}>"))
        return F.concat(done, between, F.array(shortest(F.concat(F.flatten(reached), seed(state)))))

    done = F.aggregate(by_end(arcs), F.array().cast(f"array<{PATH}>"), step)

    def complete(d: Column) -> Column:
        every = F.transform(
            finals,
            lambda final, s: F.transform(
                F.when(final < math.inf, F.coalesce(F.get(d, s), seed(s))).otherwise(none),
                lambda p: F.struct((p["cost"] + final).alias("cost"), p["ids"].alias("ids"), p["at"].alias("at"), p["hyp"].alias("hyp")),
            ),
        )
        return F.transform(
            shortest(F.flatten(every).cast(PATH)),
            lambda p: F.struct(
                p["cost"].alias("cost"),
                p["ids"].alias("ids"),
                F.transform(p["at"], lambda i: F.get(arcs, i)["olabel"]).alias("hyp"),
                F.transform(p["at"], lambda i: F.get(arcs, i)["weight"]).alias("scores"),
            ),
        )

    return let(done, complete)


def k_best(lattices: Lattices, k: int, unique: bool = False, weight_threshold: float | None = None) -> DataFrame:
    """lattice_id, rank (from 1), cost (final weight included), hyp, scores.

    ``weight_threshold`` drops paths so much costlier than the best."""
    best = _k_best(F.col("arcs"), F.col("start"), F.col("finals"), k, unique)
    ranked = F.transform(best, lambda p, i: F.struct(i.alias("rank"), p.alias("p")))
    rows = inlined(lattices.rows, ranked, "rank")
    rows = rows.select("lattice_id", (F.col("rank") + 1).alias("rank"), "p.cost", "p.hyp", "p.scores", "p.ids")
    if weight_threshold is not None:
        first = F.min("cost").over(Window.partitionBy("lattice_id"))
        rows = rows.withColumn("first", first).filter(F.col("cost") <= F.col("first") + weight_threshold).drop("first")
    return rows


def shortest_path(lattices: Lattices, include_final: bool = False) -> DataFrame:
    """lattice_id, hyp (output labels, epsilons kept), scores (arc costs), logprob:
    minus the sum of the arc costs, and of the final cost if asked for."""
    best = k_best(lattices, 1)
    total = F.aggregate("scores", F.lit(0.0), lambda t, s: t + s)
    return best.select("lattice_id", "hyp", "scores", (-(F.col("cost") if include_final else total)).alias("logprob"))


def best_logprob(arcs: Column, start: Column, finals: Column) -> Column:
    """Log-probability of the best path, without its final cost where that is 0."""
    return -F.get(backward(arcs, finals, "tropical"), start)


def path_counts(arcs: Column, finals: Column) -> Column:
    """Array by state: the number of paths to a final state."""
    ends = F.transform(finals, lambda f: F.when(f < math.inf, F.lit(1.0)).otherwise(F.lit(0.0)))
    return let(ends, lambda e: backward(arcs, e, "count"))


def path_count(lattices: Lattices) -> DataFrame:
    counts = path_counts(F.col("arcs"), F.col("finals"))
    return lattices.rows.select("lattice_id", F.get(counts, F.col("start")).alias("paths"))


def summary(lattices: Lattices) -> DataFrame:
    """lattice_id, states, n_arcs, mass, paths of the lattices that have a path."""

    def found(b: Batch) -> dict:
        paths = b.backward(0.0, "count", np.where(b.finals < math.inf, 1.0, 0.0))
        paths = np.where(b.begun, paths[b.start] if len(paths) else 0.0, 0.0)
        at = np.flatnonzero(paths > 0)
        sizes = {"states": b.sizes[at].astype(np.int32), "n_arcs": b.arc_sizes[at].astype(np.int32)}
        return {"lattice": at, **sizes, "mass": b.at_start(b.backward())[at], "paths": paths[at]}

    made = rows_of(lattices.rows, found, "states int, n_arcs int, mass double, paths double")
    return made.withColumn("paths", F.col("paths").cast("long"))


def _shares(b: Batch) -> dict:
    """The arcs of ``arcs_with_posterior``, and their outputs."""
    keep = b.weight < math.inf
    depth = b.depths()[b.src[keep]]
    position = pa.array(np.where(depth < math.inf, depth, 0).astype(np.int32), mask=depth == math.inf)
    named = {n: b.fields[n].filter(pa.array(keep)) for n in ("src", "dst", "arc_id", "ilabel", "olabel")}
    return {"lattice": b.of[keep], "position": position, **named, "p": b.posteriors()[keep]}


def arcs_with_posterior(lattices: Lattices) -> DataFrame:
    """One row per arc of non-Zero weight: lattice_id, position (arcs from the start), the
    arc's fields, and p, the probability that a path takes it."""
    return rows_of(lattices.rows, _shares, "position int, src int, dst int, arc_id bigint, ilabel int, olabel int, p double")


def _marginals(b: Batch, by: np.ndarray) -> dict:
    """The posteriors of a batch's arcs, summed within each lattice by ``by`` and output label."""
    keep = b.weight < math.inf
    lattice, key, label, p = summed((b.of[keep], by[keep], b.olabel[keep]), b.posteriors()[keep])
    return {"lattice": lattice, "key": key.astype(np.int32), "olabel": label.astype(np.int32), "p": p}


def position_posteriors(lattices: Lattices) -> DataFrame:
    """lattice_id, position, olabel, p: by distance from the start; meant for
    lattices whose paths to a state are equally long (see sequence_length)."""
    found = rows_of(lattices.rows, lambda b: _marginals(b, np.where((d := b.depths()) < math.inf, d, -1)[b.src]), "key int, olabel int, p double")
    return found.select("lattice_id", F.when(F.col("key") >= 0, F.col("key")).alias("position"), "olabel", "p")


def position_probabilities(lattices: Lattices) -> DataFrame:
    """lattice_id, ilabel, olabel, p: marginals of the output labels by input label."""
    return rows_of(lattices.rows, lambda b: _marginals(b, b.ilabel), "key int, olabel int, p double").withColumnRenamed("key", "ilabel")


def shortest_hamming_path(lattices: Lattices) -> DataFrame:
    """lattice_id, hyp (the likeliest label of each position, the lowest of equals),
    scores (their log-probabilities) and expected_correct."""
    best = position_posteriors(lattices).groupBy("lattice_id", "position").agg(
        F.max(F.struct("p", (-F.col("olabel")).alias("label"))).alias("b")
    )
    rows = best.groupBy("lattice_id").agg(
        F.sort_array(F.collect_list(F.struct("position", (-F.col("b.label")).alias("olabel"), F.log("b.p").alias("score")))).alias("path"),
        F.sum("b.p").alias("expected_correct"),
    )
    return rows.select(
        "lattice_id",
        F.transform("path", lambda s: s["olabel"]).alias("hyp"),
        F.transform("path", lambda s: s["score"]).alias("scores"),
        "expected_correct",
    )


def with_length(rows: DataFrame) -> DataFrame:
    """The rows with a column length, as ``sequence_length`` has it."""
    return with_values(rows, lambda b: pa.array(b.lengths()), "length", "int")


def sequence_length(lattices: Lattices) -> DataFrame:
    """lattice_id, length: the common length of all paths, or -1 if paths to a state
    or to the end differ in length or a label is negative."""
    return with_length(lattices.rows.select("lattice_id", "start", "finals", "arcs")).select("lattice_id", "length")
