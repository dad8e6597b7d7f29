"""Normalisation, posteriors, entropy and measures under hypotheses."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import entropy_term, let, log_plus, log_sum, plus, power_scale, without_weight
from arcloom.functions.text import hamming
from arcloom.lattice import Lattices, inlined, lattice, with_fields
from arcloom.operators.distance import backward, fold, forward
from arcloom.operators.paths import best_logprob, position_probabilities, shortest_path
from arcloom.plans.batches import Batch, changed, connected


def scale_weights(lattices: Lattices, k: float) -> Lattices:
    """Costs times k, final ones too; Zero stays Zero."""
    scaled = lattices.map_arcs(lambda a: with_fields(a, weight=power_scale(a["weight"], k)))
    return scaled.with_columns(finals=F.transform("finals", lambda f: power_scale(f, k)))


def remove_weights(lattices: Lattices) -> Lattices:
    bare = lattices.map_arcs(lambda a: with_fields(a, weight=without_weight(a["weight"])))
    return bare.with_columns(finals=F.transform("finals", without_weight))


def normalize(lattices: Lattices, scale: float = 1.0) -> Lattices:
    """Weights pushed so that what leaves each state, its final weight included, sums to 1."""
    scaled = lattices if scale == 1.0 else scale_weights(lattices, scale)

    def pushed(b: Batch) -> pa.Array:
        beta = b.backward()
        with np.errstate(invalid="ignore"):
            return connected(b, b.finals - beta, b.weight + beta[b.dst] - beta[b.src])

    return replace(scaled, rows=changed(scaled.rows, pushed))


def arc_posteriors(lattices: Lattices) -> DataFrame:
    """lattice_id, arc_id, src, dst, ilabel, olabel, weight: forward times weight
    times backward, not divided by the mass."""
    return normalize_posteriors(lattices, divide=False)[0].arcs.drop("features")


def normalize_posteriors(lattices: Lattices, scale: float = 1.0, divide: bool = True) -> tuple[Lattices, DataFrame]:
    """Arcs and finals weighted by their posteriors; and lattice_id, mass."""
    scaled = lattices if scale == 1.0 else scale_weights(lattices, scale)
    n = F.size("finals")
    both = F.struct(
        forward(F.col("arcs"), F.col("start"), n).alias("alpha"), backward(F.col("arcs"), F.col("finals")).alias("beta")
    )

    def weighted(d: Column) -> Column:
        mass = F.get(d["beta"], F.col("start"))
        off = mass if divide else F.lit(0.0)
        return F.struct(
            F.zip_with("finals", d["alpha"], lambda f, x: f + x - off).alias("finals"),
            F.transform(
                "arcs",
                lambda a: with_fields(a, weight=F.get(d["alpha"], a["src"]) + a["weight"] + F.get(d["beta"], a["dst"]) - off),
            ).alias("arcs"),
            mass.alias("mass"),
        )

    rows = scaled.rows.select("lattice_id", "start", let(both, weighted).alias("new"))
    return replace(scaled, rows=rows.select("lattice_id", "start", "new.finals", "new.arcs")), rows.select("lattice_id", "new.mass")


def is_probabilistic(lattices: Lattices, delta: float = 1e-6) -> DataFrame:
    """lattice_id, ok: whether the weights that leave every state sum to 1."""
    out = lattices.rows.select(
        "lattice_id",
        F.explode(
            F.concat(
                F.transform("arcs", lambda a: F.struct(a["src"].alias("state"), a["weight"].alias("w"))),
                F.transform("finals", lambda f, s: F.struct(s.alias("state"), f.alias("w"))),
            )
        ).alias("o"),
    )
    sums = out.groupBy("lattice_id", "o.state").agg(F.sum(F.exp(-F.col("o.w"))).alias("total"))
    return sums.groupBy("lattice_id").agg(F.bool_and(F.abs(F.col("total") - 1) <= delta).alias("ok"))


def num_states(lattices: Lattices) -> DataFrame:
    return lattices.rows.select("lattice_id", F.size("finals").alias("states"))


def sum_suffixes(lattices: Lattices, semiring: str = "log", with_suffix_mass: bool = False) -> DataFrame:
    """lattice_id, ilabel, weight: the arcs that leave the start summed by input
    label, relative to the mass; the start's final weight under label 0 if no
    arc has it.  ``with_suffix_mass`` multiplies in what follows each arc,
    needless for normalised lattices."""
    add = plus(semiring)
    rows = lattices.rows.select(
        "lattice_id", "start", "finals", "arcs", backward(F.col("arcs"), F.col("finals"), semiring).alias("beta")
    )
    first = F.filter("arcs", lambda a: a["src"] == F.col("start"))
    mass = F.get(F.col("beta"), F.col("start"))
    after = (lambda a: F.get(F.col("beta"), a["dst"])) if with_suffix_mass else (lambda a: F.lit(0.0))
    items = F.transform(first, lambda a: F.struct(a["ilabel"].alias("ilabel"), (a["weight"] + after(a) - mass).alias("w")))
    end = F.get(F.col("finals"), F.col("start"))
    items = F.when((end < math.inf) & ~F.exists(first, lambda a: a["ilabel"] == 0), F.concat(items, F.array(F.struct(F.lit(0).alias("ilabel"), (end - mass).alias("w"))))).otherwise(items)
    grouped = inlined(rows, items, "ilabel").groupBy("lattice_id", "ilabel").agg(F.collect_list("w").alias("ws"))
    total = log_sum(F.col("ws")) if add is log_plus else F.array_min("ws")
    return grouped.select("lattice_id", "ilabel", total.alias("weight"))


def neg_entropy_of(arcs: Column, start: Column, finals: Column) -> Column:
    """Sum of p ln p over arcs and final weights, each weighted by the mass that reaches it."""
    alpha = forward(arcs, start, F.size(finals))
    return let(
        alpha,
        lambda al: F.aggregate(arcs, F.lit(0.0), lambda t, a: t + entropy_term(a["weight"], F.get(al, a["src"])))
        + F.aggregate(F.zip_with(finals, al, entropy_term), F.lit(0.0), lambda t, x: t + x),
    )


def entropy(lattices: Lattices) -> DataFrame:
    """lattice_id, neg_entropy, entropy, perplexity of normalised lattices, in nats."""
    rows = lattices.rows.select("lattice_id", neg_entropy_of(F.col("arcs"), F.col("start"), F.col("finals")).alias("neg_entropy"))
    return rows.withColumn("entropy", -F.col("neg_entropy")).withColumn("perplexity", F.exp(F.col("entropy")))


def hypotheses(lattices: Lattices) -> DataFrame:
    """A row per lattice, position (input label) and output label there: the masked
    lattice (arcs of the position with other labels taken out) and the label's
    marginal p.  No exchange beyond the one that the marginals share."""
    p = position_probabilities(lattices).withColumnRenamed("ilabel", "l").withColumnRenamed("olabel", "m")
    rows = lattices.rows.join(p, "lattice_id")
    masked = F.filter("arcs", lambda a: (a["ilabel"] != F.col("l")) | (a["olabel"] == F.col("m")))
    return rows.select("lattice_id", "l", "m", "p", "start", "finals", masked.alias("arcs"))


def _over_hypotheses(rows: DataFrame, value: Column) -> DataFrame:
    return rows.withColumn("v", F.col("p") * value).groupBy("lattice_id", F.col("l").alias("ilabel")).agg(F.sum("v").alias("value"))


def _entropies_given_labels(lattices: Lattices) -> DataFrame:
    """lattice_id, ilabel, entropy, surprise: by position, the mean signed entropy of the lattice given the label there,
    and the sum of p ln p of its labels.

    Where no path has two arcs of a position, one pass each way does: with a[s] the mass that reaches a state and G[s] the
    sum of p ln p over what follows it (an expectation semiring), arc b is part of C(b) = a (p ln p + p G) of the whole
    sum G[start], and the lattice whose arcs of position l other than m are taken out keeps G[start] less C of all arcs of l
    plus C of those with m.  Work is linear in arcs.  Other lattices are masked, label by label, within their row.
    """
    n = F.size("finals")
    none = F.transform("finals", lambda f: F.lit(math.inf))
    known = F.struct(
        forward(F.col("arcs"), F.col("start"), n).alias("alpha"),
        backward(F.col("arcs"), F.col("finals")).alias("beta"),
        let(F.transform("finals", lambda f: entropy_term(f, F.lit(0.0))), lambda e: backward(F.col("arcs"), e, "entropy")).alias("follows"),
        let(none, lambda z: fold(F.col("arcs"), z, "label")).alias("label"),
    )

    def p_of(d: Column, a: Column) -> Column:
        return F.exp(F.get(d["beta"], F.col("start")) - F.get(d["alpha"], a["src"]) - a["weight"] - F.get(d["beta"], a["dst"]))

    def part(d: Column, a: Column) -> Column:
        return F.struct(
            a["ilabel"].alias("ilabel"),
            a["olabel"].alias("olabel"),
            p_of(d, a).alias("p"),
            (entropy_term(a["weight"], F.get(d["alpha"], a["src"])) + F.exp(-F.get(d["alpha"], a["src"]) - a["weight"]) * F.get(d["follows"], a["dst"])).alias("part"),
            F.get(d["follows"], F.col("start")).alias("whole"),
            F.lit(None).cast("double").alias("masked"),
        )

    def masked(d: Column, k: Column) -> Column:
        own = F.filter("arcs", lambda a: (a["ilabel"] == k["ilabel"]) & (a["olabel"] == k["olabel"]))
        left = F.filter("arcs", lambda a: (a["ilabel"] != k["ilabel"]) | (a["olabel"] == k["olabel"]))
        return F.struct(
            k["ilabel"].alias("ilabel"),
            k["olabel"].alias("olabel"),
            F.aggregate(own, F.lit(0.0), lambda t, a: t + p_of(d, a)).alias("p"),
            F.lit(0.0).alias("part"),
            F.lit(0.0).alias("whole"),
            neg_entropy_of(left, F.col("start"), F.col("finals")).alias("masked"),
        )

    def parts(d: Column) -> Column:
        alive = F.filter("arcs", lambda a: a["weight"] < math.inf)
        # labels that grow along every path: the greatest of the arcs into a state is below all that leave it
        once = F.forall("arcs", lambda a: (a["ilabel"] > 0) & ((F.get(d["label"], a["src"]) == math.inf) | (a["ilabel"] > -F.get(d["label"], a["src"]))))
        labels = F.array_distinct(F.transform(alive, lambda a: F.struct(a["ilabel"].alias("ilabel"), a["olabel"].alias("olabel"))))
        return F.when(once, F.transform(alive, lambda a: part(d, a))).otherwise(F.transform(labels, lambda k: masked(d, k)))

    found = inlined(lattices.rows, let(known, parts), "ilabel")
    by_label = found.groupBy("lattice_id", "ilabel", "olabel").agg(F.sum("p").alias("p"), F.sum("part").alias("part"), F.max("whole").alias("whole"), F.max("masked").alias("masked"))
    p = F.col("p")
    linear = (F.max("whole") - F.sum("part")) * F.sum("p") + F.sum(p * F.col("part"))
    return by_label.groupBy("lattice_id", "ilabel").agg(
        F.coalesce(F.sum(p * F.col("masked")), linear).alias("entropy"), F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0)).alias("surprise")
    )


def conditional_entropy(lattices: Lattices) -> DataFrame:
    """lattice_id, ilabel, value: mean signed entropy of the lattice given the label
    at the position, masked lattices not renormalised."""
    return _entropies_given_labels(lattices).select("lattice_id", "ilabel", F.col("entropy").alias("value"))


def mutual_information(lattices: Lattices) -> DataFrame:
    return _entropies_given_labels(lattices).select("lattice_id", "ilabel", (F.col("entropy") - F.col("surprise")).alias("value"))


def conditional_expected_shortest_path(lattices: Lattices) -> DataFrame:
    """Mean log-probability of the best path given the label at the position."""
    return _over_hypotheses(hypotheses(lattices), best_logprob(F.col("arcs"), F.col("start"), F.col("finals")))


def _masked(rows: DataFrame) -> Lattices:
    """The masked lattices as a collection of their own, lattice_id a struct."""
    return Lattices(rows.select(F.struct("lattice_id", "l", "m", "p").alias("lattice_id"), "start", "finals", "arcs"))


def conditional_expected_accuracy(lattices: Lattices) -> DataFrame:
    """Mean expected number of correct labels given the label at the position."""
    from arcloom.operators.paths import shortest_hamming_path

    found = shortest_hamming_path(_masked(hypotheses(lattices))).select("lattice_id.*", "expected_correct")
    return _over_hypotheses(found, F.col("expected_correct"))


def conditional_expected_num_changes(lattices: Lattices, search=shortest_path) -> DataFrame:
    """Mean number of labels by which the best sequence changes given the label at
    the position; ``search`` is shortest_path or shortest_hamming_path."""
    now = search(lattices).select("lattice_id", F.col("hyp").alias("now"))
    found = search(_masked(hypotheses(lattices))).select("lattice_id.*", "hyp").join(now, "lattice_id")
    return _over_hypotheses(found, hamming(F.col("hyp"), F.col("now")))


