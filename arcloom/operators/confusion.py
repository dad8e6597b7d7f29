"""Consensus: position word posteriors (minimum Bayes risk table) and confusion networks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arcloom.lattice import ARCS, EPSILON, Lattices
from arcloom.plans.batches import Batch, lists, rows_of, spread, with_values

#: label of the end of a lattice
END = -1


def _cells(lattices: Batch) -> dict:
    """The table of a batch."""
    lattice, position, label, p = lattices.words(EPSILON, END)
    return {"lattice": lattice, "position": position.astype(np.int32), "label": label.astype(np.int32), "p": p}


def mbr_table(lattices: Lattices) -> DataFrame:
    """lattice_id, position (from 1), label, p: the probability that the position-th
    input label that is not epsilon is ``label`` or that the lattice ends there."""
    return rows_of(lattices.rows.filter("start is not null"), _cells, "position int, label int, p double")


def confusion_network(lattices: Lattices) -> Lattices:
    """The table as a lattice: state k follows the k-th word; arcs carry the word
    posteriors, final weights those of the end.

    The last position of the table has the end only, and every other one a word, so what
    is made needs no trimming."""

    def network(b: Batch) -> pa.Array:
        lattice, position, label, p = b.words(EPSILON, END)
        # states before each position up to the last, which is the end of a longest path
        sizes = np.zeros(b.n, np.int64)
        np.maximum.at(sizes, lattice, position)
        first = np.cumsum(sizes) - sizes
        finals = np.full(int(sizes.sum()), math.inf)
        end, cost = label == END, -np.log(p)
        finals[first[lattice[end]] + position[end] - 1] = cost[end]
        lattice, position, label, cost = lattice[~end], position[~end], label[~end], cost[~end]
        count = np.bincount(lattice, minlength=b.n)
        word = pa.array(label.astype(np.int32))
        fields = [pa.array(position.astype(np.int32)), pa.array((position - 1).astype(np.int32)), pa.array(spread(np.zeros(b.n, np.int64), count)), word, word]
        fields += [pa.array(cost), pa.nulls(len(cost), pa.list_(pa.float64()))]
        arcs = pa.StructArray.from_arrays(fields, names=["dst", "src", "arc_id", "ilabel", "olabel", "weight", "features"])
        start = pa.array(np.zeros(b.n, np.int32), mask=sizes == 0)
        return pa.StructArray.from_arrays([start, lists(pa.array(finals), sizes), lists(arcs, count)], names=["start", "finals", "arcs"])

    rows = lattices.rows.filter("start is not null").select("lattice_id", "start", "finals", "arcs")
    made = with_values(rows, network, "network", f"struct<start:int,finals:array<double>,arcs:{ARCS}>")
    return Lattices(made.select("lattice_id", "network.start", "network.finals", "network.arcs").filter("start is not null"))
