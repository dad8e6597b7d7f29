"""Prefix-conditioned edit distance: how well a typed prefix matches the beginnings
of a lattice's paths, and features of the words that may follow."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import let
from arcloom.lattice import EPSILON, Lattices, inlined
from arcloom.operators.distance import backward

#: fixed values: edit kinds in their order of preference among equals, and their costs
KINDS = ("none", "substitution", "deletion", "insertion", "noise_match", "noise_deletion", "noise_insertion", "unknown")
COSTS = {"none": 0.0, "substitution": 1.0, "deletion": 1.0, "insertion": 1.0, "noise_match": 0.0, "noise_deletion": 0.0, "noise_insertion": 0.0, "unknown": 4.0}
END = -1


def feature_names(n_features: int = 0) -> list[str]:
    return [*(f"feature{i}" for i in range(n_features)), "logprob", "contiguous", "cost", *KINDS]


def _cell(cost: Column, score: Column, kind: Column, forward: Column, contiguous: Column, counts: Column) -> Column:
    """Ordered by cost, then by the cost of the best-scoring sentence, then by kind."""
    return F.struct(
        cost.cast("double").alias("cost"),
        score.cast("double").alias("score"),
        kind.cast("int").alias("kind"),
        forward.cast("double").alias("forward"),
        contiguous.cast("int").alias("contiguous"),
        counts.alias("counts"),
    )


def _edited(c: Column, kind: str, weight: Column, rest: Column, noise: Column | None = None, noise_kind: str = "none") -> Column:
    """The cell after an edit; ``rest`` is the backward cost of the state it leads to."""

    def made(name: str) -> Column:
        k = KINDS.index(name)
        counts = F.transform(c["counts"], lambda n, i: F.when(i == k, n + 1).otherwise(n))
        contiguous = c["contiguous"] + 1 if name == "none" else (c["contiguous"] if name.startswith("noise") else F.lit(0))
        forward = c["forward"] + weight
        return _cell(c["cost"] + COSTS[name], forward + rest, F.lit(k), forward, contiguous, counts)

    return made(kind) if noise is None else F.when(noise, made(noise_kind)).otherwise(made(kind))


def first_row(arcs: Column, start: Column, beta: Column) -> Column:
    """Array by state: the best cell for the empty prefix; ``beta`` are the backward costs."""
    free = F.lit(0.0)
    nothing = F.array_repeat(F.lit(0), len(KINDS))
    first = F.transform(beta, lambda b, s: F.when(s == start, _cell(free, b, F.lit(0), free, F.lit(0), nothing)).otherwise(_far()))
    return F.aggregate(arcs, first, lambda cells, a: _put(cells, a, _deleted(cells, a, beta)))


def next_row(arcs: Column, beta: Column, before: Column, word: Column) -> Column:
    """The row after one more word of the prefix."""
    silent = word == EPSILON
    inserted = F.zip_with(before, beta, lambda c, b: _edited(c, "insertion", F.lit(0.0), b, silent, "noise_insertion"))

    def step(cells: Column, a: Column) -> Column:
        c, rest = F.get(before, a["src"]), F.get(beta, a["dst"])
        match = _edited(c, "none", a["weight"], rest, silent, "noise_match")
        change = _edited(c, "substitution", a["weight"], rest)
        across = F.when(a["olabel"] == word, match).when((a["olabel"] == EPSILON) == silent, change).otherwise(_far())
        return _put(cells, a, F.least(_deleted(cells, a, beta), across))

    return F.aggregate(arcs, inserted, step)


def _far() -> Column:
    return _cell(F.lit(math.inf), F.lit(math.inf), F.lit(len(KINDS)), F.lit(math.inf), F.lit(0), F.array_repeat(F.lit(0), len(KINDS)))


def _put(cells: Column, a: Column, new: Column) -> Column:
    return F.transform(cells, lambda c, s: F.when(s == a["dst"], F.least(c, new)).otherwise(c))


def _deleted(cells: Column, a: Column, beta: Column) -> Column:
    return _edited(F.get(cells, a["src"]), "deletion", a["weight"], F.get(beta, a["dst"]), a["olabel"] == EPSILON, "noise_deletion")


def last_row(arcs: Column, start: Column, finals: Column, prefix: Column) -> Column:
    """Array by state: the best cell for the whole prefix against the paths to the state; two rows are held at a time."""

    def row(v: Column) -> Column:
        return F.aggregate(prefix, first_row(v["arcs"], start, v["beta"]), lambda before, word: next_row(v["arcs"], v["beta"], before, word))

    return let(F.struct(arcs.alias("arcs"), backward(arcs, finals).alias("beta")), row)


def trellis(lattices: Lattices, prefixes: DataFrame) -> DataFrame:
    """lattice_id, start, finals, arcs, beta, prefix, trellis (a row of cells for each beginning of the prefix)
    for (lattice_id, prefix ARRAY<INT>), to be taken on by ``set_prefix`` as the prefix is edited."""
    rows = lattices.rows.join(prefixes, "lattice_id").withColumn("beta", backward(F.col("arcs"), F.col("finals")))
    first = F.array(first_row(F.col("arcs"), F.col("start"), F.col("beta")))
    return rows.withColumn("trellis", _grown(first, F.col("prefix")))


def _grown(rows: Column, words: Column) -> Column:
    return F.aggregate(words, rows, lambda done, word: F.concat(done, F.array(next_row(F.col("arcs"), F.col("beta"), F.element_at(done, -1), word))))


def set_prefix(trellises: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The trellises for other prefixes (lattice_id, prefix): the rows of what the old and
    the new prefix have in common stay, only those past it are computed."""
    new = prefixes.select("lattice_id", F.col("prefix").alias("wanted"))
    alike = F.zip_with("prefix", "wanted", lambda a, b: F.coalesce(a == b, F.lit(False)))
    both = F.least(F.size("prefix"), F.size("wanted"))
    shared = F.coalesce(F.array_position(alike, F.lit(False)).cast("int") - 1, F.lit(-1))
    rows = trellises.join(new, "lattice_id").withColumn("shared", F.when(shared >= 0, shared).otherwise(both))
    kept = F.slice("trellis", F.lit(1), F.col("shared") + 1)
    rest = F.slice("wanted", F.col("shared") + 1, F.greatest(F.size("wanted") - F.col("shared"), F.lit(0)))
    return rows.withColumn("trellis", _grown(kept, rest)).withColumn("prefix", F.col("wanted")).drop("wanted", "shared")


def trellis_features(trellises: DataFrame, unique: bool = True) -> DataFrame:
    """As ``edit_distance_features``, from the last rows of trellises."""
    return _features(trellises.select("lattice_id", "arcs", "finals", F.element_at("trellis", -1).alias("cells")), unique)


def edit_distance_features(lattices: Lattices, prefixes: DataFrame, unique: bool = True) -> DataFrame:
    """lattice_id, word, cost, weight, features for (lattice_id, prefix ARRAY<INT>): a
    row for every arc that may come next and every final state (word -1), or with
    ``unique`` the cheapest, then likeliest, of each word."""
    rows = lattices.rows.join(prefixes, "lattice_id")
    return _features(rows.select("lattice_id", "arcs", "finals", last_row(F.col("arcs"), F.col("start"), F.col("finals"), F.col("prefix")).alias("cells")), unique)


def _features(rows: DataFrame, unique: bool) -> DataFrame:
    def candidate(word: Column, c: Column, weight: Column, own: Column) -> Column:
        total = c["forward"] + weight
        shown = F.concat(own, F.array(-total, c["contiguous"].cast("double"), c["cost"]), F.transform(c["counts"], lambda n: n.cast("double")))
        return F.struct(word.alias("word"), c["cost"].alias("cost"), total.alias("weight"), shown.alias("features"))

    none = F.array().cast("array<double>")
    words = F.transform("arcs", lambda a: candidate(a["olabel"], F.get(F.col("cells"), a["src"]), a["weight"], F.coalesce(a["features"], none)))
    ends = F.filter(F.zip_with("cells", "finals", lambda c, f: F.when(f < math.inf, candidate(F.lit(END), c, f, none))), lambda x: x.isNotNull())
    found = inlined(rows, F.concat(words, ends), "word").filter("cost < double('infinity') and weight < double('infinity')")
    if not unique:
        return found
    best = found.groupBy("lattice_id", "word").agg(F.min(F.struct("cost", "weight", "features")).alias("b"))
    return best.select("lattice_id", "word", "b.cost", "b.weight", "b.features")
