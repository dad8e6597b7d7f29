"""Epsilon removal, determinisation, minimisation, and normalisation over the
minimal automaton.

Subset construction is sequential within a lattice, so these run a kernel over the rows of
a collection, as Arrow batches.  Epsilons are removed, and posteriors over an automaton found, for all lattices of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arcloom.lattice import KEYS, Lattices
from arcloom.operators.filters import connect
from arcloom.operators.normalise import normalize
from arcloom.plans.batches import Batch, changed, collection, fold, kept, log_summed, matched, runs, sent, spread
from arcloom.session import cut

ARROW_ARC = pa.struct(
    [("dst", pa.int32()), ("src", pa.int32()), ("arc_id", pa.int64()), ("ilabel", pa.int32()), ("olabel", pa.int32()), ("weight", pa.float64()), ("features", pa.list_(pa.float64()))]
)


def _plus(a: float, b: float) -> float:
    lo, hi = min(a, b), max(a, b)
    return lo if hi == math.inf else lo - math.log1p(math.exp(lo - hi))


class _Machine:
    """One lattice: arcs by state as (label, next, weight), labels pairs."""

    def __init__(self, arcs: list[list[tuple]], finals: list[float], start: int = 0):
        self.arcs, self.finals, self.start = arcs, finals, start

    @staticmethod
    def each(b: Batch) -> Iterator[_Machine]:
        """The lattices of a batch."""
        labels = list(zip(b.ilabel.tolist(), b.olabel.tolist(), strict=True))
        src, dst, weight, finals = b.at_src.tolist(), b.at_dst.tolist(), b.weight.tolist(), b.finals.tolist()
        state = arc = 0
        for n, m, start in zip(b.sizes.tolist(), b.arc_sizes.tolist(), (b.start - b.first).tolist(), strict=True):
            arcs: list[list[tuple]] = [[] for _ in range(n)]
            for k in range(arc, arc + m):
                arcs[src[k]].append((labels[k], dst[k], weight[k]))
            yield _Machine(arcs, finals[state : state + n], max(start, 0))
            state, arc = state + n, arc + m

    def without_weights(self) -> _Machine:
        bare = [[(x, t, 0.0 if w < math.inf else w) for x, t, w in out] for out in self.arcs]
        return _Machine(bare, [0.0 if f < math.inf else f for f in self.finals], self.start)

    def without_epsilons(self) -> _Machine:
        """Epsilon arcs folded into what follows them; the states are in topological order."""
        arcs, finals = [list(out) for out in self.arcs], list(self.finals)
        for s in reversed(range(len(arcs))):
            merged: dict[tuple, float] = {}
            for x, t, w in self.arcs[s]:
                if x == (0, 0):
                    finals[s] = _plus(finals[s], w + finals[t])
                    for y, u, v in arcs[t]:
                        merged[y, u] = _plus(merged.get((y, u), math.inf), w + v)
                else:
                    merged[x, t] = _plus(merged.get((x, t), math.inf), w)
            arcs[s] = [(x, t, w) for (x, t), w in merged.items()]
        return _Machine(arcs, finals, self.start)

    def determinized(self, most: int | None = None) -> _Machine | None:
        """Weighted subset construction in the log semiring; None beyond ``most`` states,
        where that is given."""
        first = ((self.start, 0.0),)
        number, todo, arcs, finals = {first: 0}, [first], [], []
        while todo:
            subset = todo.pop(0)
            final, out = math.inf, {}
            for s, r in subset:
                final = _plus(final, r + self.finals[s])
                for x, t, w in self.arcs[s]:
                    d = out.setdefault(x, {})
                    d[t] = _plus(d.get(t, math.inf), r + w)
            finals.append(final)
            arcs.append([])
            for x in sorted(out):
                total = math.inf
                for w in out[x].values():
                    total = _plus(total, w)
                if total == math.inf:
                    continue
                to = tuple(sorted((t, round(w - total, 9)) for t, w in out[x].items()))
                if to not in number:
                    if most is not None and len(number) >= most:
                        return None
                    number[to] = len(number)
                    todo.append(to)
                arcs[-1].append((x, number[to], total))
        return _Machine(arcs, finals)

    def order(self) -> list[int]:
        seen, out = set(), []
        stack = [(self.start, iter(self.arcs[self.start]))] if self.arcs else []
        seen.add(self.start)
        while stack:
            s, rest = stack[-1]
            for _, t, _w in rest:
                if t not in seen:
                    seen.add(t)
                    stack.append((t, iter(self.arcs[t])))
                    break
            else:
                out.append(s)
                stack.pop()
        return out[::-1]

    def numbered(self) -> _Machine:
        """The same, its states in topological order."""
        order = self.order()
        at = {s: i for i, s in enumerate(order)}
        return _Machine([[(x, at[t], w) for x, t, w in self.arcs[s]] for s in order], [self.finals[s] for s in order], 0)

    def minimized(self) -> _Machine:
        """States with equal futures made one, from the end; numbered topologically."""
        order = self.order()
        of: dict[int, int] = {}
        by_future: dict[tuple, int] = {}
        kept: list[tuple[list, float]] = []
        for s in reversed(order):
            out = sorted((x, of[t], round(w, 9)) for x, t, w in self.arcs[s])
            key = (tuple(out), round(self.finals[s], 9))
            if key not in by_future:
                by_future[key] = len(kept)
                kept.append((out, self.finals[s]))
            of[s] = by_future[key]
        last = len(kept) - 1  # successors were kept first, so counting down is topological
        arcs = [[(x, last - t, w) for x, t, w in kept[last - i][0]] for i in range(len(kept))]
        return _Machine(arcs, [kept[last - i][1] for i in range(len(kept))], last - of[self.start] if order else 0)


def _collected(machines: list[_Machine]) -> pa.Array:
    """Machines as ``collection`` has lattices; arcs are numbered by the states that they leave."""
    arcs = [(i, t, s, x[0], x[1], w) for i, m in enumerate(machines) for s, out in enumerate(m.arcs) for x, t, w in out]
    of, dst, src, ilabel, olabel, weight = (np.array(v) for v in zip(*arcs, strict=True)) if arcs else np.zeros((6, 0))
    of, dst, src = (v.astype(np.int64) for v in (of, dst, src))
    count = np.bincount(of, minlength=len(machines))
    number = spread(np.zeros(len(machines), np.int64), count)
    at = np.lexsort((number, src, dst, of))
    fields = {"dst": dst, "src": src, "arc_id": number, "ilabel": ilabel, "olabel": olabel}
    made = {k: v[at].astype(np.int64 if k == "arc_id" else np.int32) for k, v in fields.items()}
    made |= {"weight": weight[at].astype(float), "features": pa.nulls(len(at), pa.list_(pa.float64()))}
    finals = np.array([f for m in machines for f in m.finals], dtype=float)
    return collection(finals, np.array([len(m.finals) for m in machines], np.int64), made, count, np.array([m.start for m in machines]))


def posteriors_over(lattices: Lattices, automata: Lattices, match: str = "pairs") -> Lattices:
    """The posteriors of the lattices on given deterministic automata without weights, one for each
    lattice_id: what ``determinize_and_normalize`` does with the minimal automaton of each lattice.
    Labels that the lattice lacks get Zero; a lattice without an automaton is left out.

    ``match`` says which arcs of the lattice an arc of the automaton stands for: those with both labels (``pairs``), or
    those with its input label (``input``); for acceptors these are the same."""
    plain = rm_epsilon(normalize(lattices))
    return _weighted(automata, plain, match)


def _weighted(shapes: Lattices, plain: Lattices, match: str = "pairs") -> Lattices:
    """``shapes`` weighted by the posteriors of ``plain``, normalised lattices without epsilons.

    Which lattice states a state of the automaton stands for is the reach of both starts through equal labels.  Each
    arc that leaves one of them with the arc's label counts once for it; shares of what leaves a state sum to 1.
    Pairs of states are followed within a batch of lattices, each pair once."""

    def weighted(b: Batch, spoken: Batch) -> pa.Array:
        both = [np.concatenate(v).astype(np.int64) for v in ((b.ilabel, spoken.ilabel), (b.olabel, spoken.olabel))]
        _, label = np.unique(both[0] if match == "input" else (both[0] << 32) + both[1], return_inverse=True)
        own, heard = label[: len(b.src)], label[len(b.src) :]
        labels = int(label.max(initial=0)) + 1
        alpha, beta = spoken.forward(), spoken.backward()
        p = np.exp(-(alpha[spoken.src] + spoken.weight + beta[spoken.dst]))
        # arcs of the automaton by the state that they leave, the lattice's by that and their label
        by_state = np.argsort(b.src, kind="stable")
        key = spoken.src * labels + heard
        by_label = np.argsort(key, kind="stable")
        key = key[by_label]
        # arcs between the same states with the same labels have one share
        order = np.lexsort((own, b.dst, b.src))
        heads = runs(b.src[order], b.dst[order], own[order])
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        shares, met = np.zeros(len(heads)), np.zeros(len(heads), bool)
        begun = b.begun & spoken.begun
        width = len(spoken.finals) + 1
        seen = now = np.unique(b.start[begun] * width + spoken.start[begun])
        while len(now):
            q, at = now // width, now % width
            pair, arc = matched(q, b.src[by_state])
            arc = by_state[arc]
            step, one = matched(at[pair] * labels + own[arc], key)
            arc, one = arc[step], by_label[one]
            met[group[arc]] = True
            shares += np.bincount(group[arc], p[one], len(heads))
            now = np.setdiff1d(b.dst[arc] * width + spoken.dst[one], seen)
            seen = np.union1d(seen, now)
        out = np.bincount(b.src[order][heads], shares, len(b.finals))[b.src]
        share = shares[group]
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(met[group] & (share > 0), np.log(out / share), math.inf)
        fields = {n: b.fields[n] for n in ("dst", "src", "arc_id", "ilabel", "olabel")}
        made = fields | {"weight": cost, "features": pa.nulls(len(cost), pa.list_(pa.float64()))}
        return collection(b.finals, b.sizes, made, b.arc_sizes, b.start - b.first)

    return Lattices(changed(shapes.rows, weighted, plain.rows), shapes.symbols, shapes.meta)


def _per_lattice(lattices: Lattices, change) -> Lattices:
    """``change`` maps each row, as a machine, to another, or to None where it gives up.  Rows stay where they are."""

    def run(batches):
        none = _Machine([], [])
        for b in batches:
            made = [change(m) for m in _Machine.each(Batch(b))]
            lost = pa.array([None if m else "too many states" for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *_collected([m or none for m in made]).flatten(), lost], names=[*KEYS, "error"])

    begun = lattices.rows.filter("start is not null").select(*KEYS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in begun.schema) + ", error string"
    # written once, as lattices and errors are read from it
    rows = cut(sent(begun).mapInArrow(run, schema))
    errors = rows.filter("error is not null").select("lattice_id", "error")
    return Lattices(rows.filter("error is null").drop("error"), lattices.symbols, errors)


def _silenced(b: Batch) -> pa.Array:
    """Epsilon arcs folded into what follows them, and what lies on no path left out: from the last states to the first, the
    k-th of every lattice at once, each taking over the arcs of the states that its epsilons lead to."""
    silent = (b.ilabel == 0) & (b.olabel == 0)
    loud = np.flatnonzero(~silent)
    finals = fold(b.finals, b.dst[silent], b.src[silent], -b.at_src[silent], b.weight[silent])
    arcs = log_summed((b.src[loud], b.dst[loud], b.ilabel[loud], b.olabel[loud]), b.weight[loud])
    states = np.arange(len(b.finals))
    first = np.searchsorted(arcs[0], states)
    count = np.searchsorted(arcs[0], states, "right") - first
    quiet = np.flatnonzero(silent)
    quiet = quiet[np.argsort(-b.at_src[quiet], kind="stable")]
    for at in np.split(quiet, runs(b.at_src[quiet])[1:]) if len(quiet) else ():
        to, own = b.dst[at], np.unique(b.src[at])
        arc = np.concatenate([spread(first[to], count[to]), spread(first[own], count[own])])
        lead = np.concatenate([np.repeat(b.weight[at], count[to]), np.zeros(int(count[own].sum()))])
        src = np.concatenate([np.repeat(b.src[at], count[to]), np.repeat(own, count[own])])
        more = log_summed((src, *[v[arc] for v in arcs[1:4]]), arcs[4][arc] + lead)
        first[own] = len(arcs[0]) + np.searchsorted(more[0], own)
        count[own] = np.searchsorted(more[0], own, "right") - np.searchsorted(more[0], own)
        arcs = tuple(np.concatenate(v) for v in zip(arcs, more, strict=True))
    at = spread(first, count)
    names = {"src": arcs[0], "dst": arcs[1], "ilabel": arcs[2].astype(np.int32), "olabel": arcs[3].astype(np.int32), "weight": arcs[4]}
    return kept(b.n, b.of_state, b.local, finals, b.start[b.begun], {k: v[at] for k, v in names.items()})


def rm_epsilon(lattices: Lattices) -> Lattices:
    # written once, as callers read it more often
    return Lattices(cut(changed(lattices.rows.filter("start is not null"), _silenced)), lattices.symbols)


def determinize(lattices: Lattices, max_states: int | None = None, minimal: bool = True) -> Lattices:
    """Deterministic over pairs of labels, and minimal unless told otherwise.  Lattices that would need more than
    ``max_states`` states, if that is given, are left out and named in ``meta`` (lattice_id, error)."""

    def change(m: _Machine) -> _Machine | None:
        made = m.determinized(max_states)
        return made and (made.minimized() if minimal else made.numbered())

    return _per_lattice(connect(lattices), change)


def minimize(lattices: Lattices) -> Lattices:
    """The minimal machine of deterministic lattices with pushed weights."""
    return _per_lattice(connect(lattices), lambda m: m.minimized())


def determinize_weights_and_normalize(lattices: Lattices, max_states: int | None = None) -> Lattices:
    """Epsilons removed, determinised and minimised with their weights, then normalised."""

    def change(m: _Machine) -> _Machine | None:
        made = m.without_epsilons().determinized(max_states)
        return made and made.minimized()

    return normalize(_per_lattice(connect(lattices), change))


def determinize_and_normalize(lattices: Lattices, scale: float = 1.0, max_states: int | None = None) -> Lattices:
    """The lattice's posteriors on the minimal automaton of its label sequences: each
    arc gets the sum of the posteriors of the arcs it stands for, and the arcs
    of a state are made to sum to 1 (final weights are not part of the sum)."""

    def change(m: _Machine) -> _Machine | None:
        shape = m.without_weights().determinized(max_states)
        return shape and shape.without_weights().minimized()

    # normalised first, so that alpha and beta are those of a distribution
    plain = rm_epsilon(normalize(lattices, scale))
    return _weighted(_per_lattice(plain, change), plain)
