"""Interactive labelling of sequences: which label to ask for next.

A simulation runs in rounds.  In each round every sample with labels left is
masked by the answers so far, its best labels and their scores are computed by
the batch operators, and one position of it is asked.  What a sample is asked
depends on its own answers only, so all samples go in step, and the number of rounds is the length of the longest sample.
Methods that show the likeliest labels and ask by what a lattice tells by itself go through all rounds of a batch of
samples in one pass over the rows (IN_ONE_PASS); with others a round is a few passes over them.  The order
in which a system would ask across samples is a sort: a pool that always takes
the least score takes the steps of each sample by the largest score so far.
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions.semiring import let
from arcloom.functions.text import hamming
from arcloom.lattice import KEYS, Lattices, inlined, lattice
from arcloom.operators import normalise, paths
from arcloom.operators.automata import determinize_and_normalize
from arcloom.operators.filters import prune_arcs, trimmed
from arcloom.operators.structure import encode_symbols
from arcloom.operators.structure import reverse as reversed_lattices
from arcloom.plans.batches import Batch, lists, parts, runs, sent, summed, with_values
from arcloom.session import cut, written
from arcloom.sources.text_lattices import read_htk


SHOWN = "array<struct<position:int,hyp:int,score:double>>"


@dataclass(frozen=True)
class Method:
    """``system`` traversal, local or global; ``recompute`` random, sequential, greedy,
    viterbi or hamming; ``order`` score, label or label_desc; ``sample`` orders the
    samples of a local system; ``update`` scores them anew with every answer."""

    system: str
    recompute: str
    order: str
    label: str = "identity"
    sample: str = "position"
    update: bool = False
    flipped: bool = False
    backwards: bool = False
    normalized: bool = True


def _methods() -> dict[str, Method]:
    t = lambda r, o, **k: Method("traversal", r, o, **k)
    loc = lambda r, o, s="entropy", **k: Method("local", r, o, sample=s, **k)
    out = {
        "random": t("random", "score"),
        "sequential-path": t("sequential", "label"),
        "sequential-symbol": t("greedy", "label"),
        "sorted-viterbi": loc("viterbi", "label"),
        "sorted-viterbi-hamming": loc("viterbi", "label", label="expected_hamming"),
        "sorted-sequential-symbol": loc("greedy", "label"),
        "sorted-sequential-hamming": loc("hamming", "label"),
        "sorted-hamming": loc("hamming", "score"),
        "sorted-hamming-num-changes": loc("hamming", "score", label="num_changes"),
        "sorted-hamming-mutual-information": loc("hamming", "score", label="mutual_information"),
        "sorted-hamming-expected-accuracy": loc("hamming", "score", label="expected_accuracy"),
        "sorted-viterbi-expected-accuracy": loc("hamming", "score", label="expected_accuracy"),
        "sorted-sequential-symbol-posterior": loc("greedy", "score"),
        "sorted-sequential-mutual-information": loc("greedy", "label", "max_mutual_information"),
        "sorted-sequential-expected-error": loc("greedy", "label", "expected_error"),
        "sorted-updated-sequential-symbol": loc("greedy", "label", update=True),
        "sorted-updated-sequential-mutual-information": loc("greedy", "label", "max_mutual_information", update=True),
        "sorted-updated-sequential-expected-error": loc("greedy", "label", "expected_error", update=True),
        "reverse-sequential-path": t("sequential", "label_desc"),
        "reverse-sequential-symbol": t("greedy", "label_desc", backwards=True),
        "sequential-greedy": t("greedy", "label", normalized=False),
        "reverse-sequential-greedy": t("greedy", "label_desc", backwards=True, normalized=False),
        "active-path": t("sequential", "score"),
        "sequential-viterbi": loc("viterbi", "label", "position"),
        "sequential-hamming": loc("hamming", "label", "position"),
        "active-structure-random": loc("greedy", "label", "random"),
        "active-structure-entropy": loc("greedy", "label"),
        "active-structure-least-confident": loc("greedy", "label", "least_confident"),
        "active-structure-error": loc("greedy", "label", "expected_error"),
        "active-label-sequential": loc("greedy", "label", "least_confident"),
        "active-label-random": loc("hamming", "score", "least_confident", label="random"),
        "active-label-random-global": Method("global", "hamming", "score", label="random"),
    }
    scorers = {
        "entropy": "entropy",
        "least-confident": "identity",
        "viterbi-error": "expected_path",
        "hamming-error": "expected_accuracy",
        "mutual-information": "mutual_information",
        "num-changes": "num_changes",
        "num-changes-hamming": "num_changes_hamming",
    }
    for name, scorer in scorers.items():
        for flipped in (False, True):
            m = "-m" if flipped else ""
            out[f"active-label-{name}{m}"] = loc("hamming", "score", "least_confident", label=scorer, flipped=flipped)
            # the one name in which the words stand in another order
            whole = f"global-{name}-m" if flipped and name == "mutual-information" else f"{name}-global{m}"
            out[f"active-label-{whole}"] = Method("global", "hamming", "score", label=scorer, flipped=flipped)
    return out


#: the sixty methods by name
METHODS = _methods()


def greedy_path(arcs: Column, start: Column, n: Column) -> Column:
    """From the start always the cheapest arc, of equals the last: array of (position, hyp, score)."""

    def step(at: Column, _: Column) -> Column:
        out = F.filter(arcs, lambda a: (a["src"] == at["state"]) & (a["weight"] < float("inf")))
        best = F.array_min(
            F.transform(out, lambda a: F.struct(a["weight"].alias("w"), (-a["arc_id"]).alias("last"), a["dst"].alias("dst"), a["ilabel"].alias("l"), a["olabel"].alias("o")))
        )
        return let(
            best,
            lambda b: F.when(b.isNull(), at).otherwise(
                F.struct(
                    b["dst"].alias("state"),
                    F.concat(at["path"], F.array(F.struct(b["l"].alias("position"), b["o"].alias("hyp"), (-b["w"]).alias("score")))).alias("path"),
                )
            ),
        )

    first = F.struct(start.cast("int").alias("state"), F.array().cast("array<struct<position:int,hyp:int,score:double>>").alias("path"))
    return F.aggregate(F.sequence(F.lit(1), n), first, step)["path"]


def _likely(b: Batch) -> tuple[np.ndarray, ...]:
    """lattice, position, label, p: of each position the likeliest label, of equals the lowest, in order."""
    keep = (b.weight < math.inf) & (b.ilabel > 0)
    lattice, position, label, p = summed((b.of[keep], b.ilabel[keep], b.olabel[keep]), b.posteriors()[keep])
    order = np.lexsort((label, -p, position, lattice))
    best = order[runs(lattice[order], position[order])]
    return lattice[best], position[best], label[best], p[best]


def _likeliest(b: Batch) -> pa.Array:
    """By lattice, of each position the likeliest label, of equals the lowest, in order of position."""
    lattice, position, label, p = _likely(b)
    with np.errstate(divide="ignore"):
        score = pa.array(np.log(p), mask=~(p > 0))
    fields = [pa.array(position.astype(np.int32)), pa.array(label.astype(np.int32)), score]
    return lists(pa.StructArray.from_arrays(fields, names=["position", "hyp", "score"]), np.bincount(lattice, minlength=b.n))


#: what labels are asked by in one pass over the rows
IN_ONE_PASS = ("identity", "entropy", "mutual_information")


def _with_arcs(b: Batch, keep: np.ndarray) -> Batch:
    out = copy.copy(b)
    for n in ("of", "at_src", "at_dst", "src", "dst", "ilabel", "olabel", "weight"):
        setattr(out, n, getattr(b, n)[keep])
    return out


def _on_paths(b: Batch) -> Batch:
    """The batch without arcs that no path takes, as ``trimmed`` leaves them out; lattices without a path are not begun."""
    reached = b.forward(0.0, "tropical")
    ends = b.backward(0.0, "tropical", np.where(b.finals < math.inf, 0.0, math.inf))
    out = _with_arcs(b, (reached[b.src] < math.inf) & (ends[b.dst] < math.inf))
    out.begun = b.begun & (b.at_start(ends) < math.inf)
    out.start = np.where(out.begun, b.start, -1)
    return out


def _term(cost: np.ndarray, forward: np.ndarray | float) -> np.ndarray:
    """As ``entropy_term``."""
    member = np.isfinite(cost)
    cost = np.where(member, cost, 0.0)
    return np.where(member, -cost * np.exp(-cost - forward), 0.0)


def _given_labels(b: Batch) -> tuple[np.ndarray, ...]:
    """lattice, position, entropy, surprise, as ``normalise._entropies_given_labels`` has them."""
    alpha, p = b.forward(), b.posteriors()
    follows = _term(b.finals, 0.0)
    order = np.argsort(-b.at_src, kind="stable")
    bounds = np.append(runs(b.at_src[order]), len(order))
    own, step = _term(b.weight, 0.0), np.exp(-b.weight)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        at = order[lo:hi]
        follows += np.bincount(b.src[at], own[at] + step[at] * follows[b.dst[at]], minlength=len(follows))
    keep = b.weight < math.inf
    part = _term(b.weight, alpha[b.src]) + np.exp(-alpha[b.src] - b.weight) * follows[b.dst]
    labels = (b.of[keep], b.ilabel[keep], b.olabel[keep])
    lattice, position, label, p_label = summed(labels, p[keep])
    part = summed(labels, part[keep])[-1]
    slots = runs(lattice, position)
    add = lambda v: np.add.reduceat(v, slots) if len(slots) else v
    whole = b.at_start(follows)[lattice[slots]]
    entropy = (whole - add(part)) * add(p_label) + add(p_label * part)
    # where a path may have two arcs of a position the lattice is masked, label by label
    greatest = np.full(len(b.finals), -math.inf)
    np.maximum.at(greatest, b.dst, b.ilabel)
    twice = np.bincount(b.of[(b.ilabel <= 0) | (b.ilabel <= greatest[b.src])], minlength=b.n) > 0
    if twice.any():
        number = np.arange(len(lattice)) - np.searchsorted(lattice, lattice)
        value = np.zeros(len(lattice))
        for k in range(int(number[twice[lattice]].max(initial=-1)) + 1):
            at = np.flatnonzero((number == k) & twice[lattice])
            masked_at, masked_to = np.full(b.n, -(1 << 40)), np.zeros(b.n, np.int64)
            masked_at[lattice[at]], masked_to[lattice[at]] = position[at], label[at]
            left = _with_arcs(b, (b.ilabel != masked_at[b.of]) | (b.olabel == masked_to[b.of]))
            mass = left.forward()
            total = np.bincount(left.of, _term(left.weight, mass[left.src]), minlength=b.n) + np.bincount(b.of_state, _term(b.finals, mass), minlength=b.n)
            value[at] = total[lattice[at]]
        entropy = np.where(twice[lattice[slots]], add(p_label * value), entropy)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = add(np.where(p_label > 0, p_label * np.log(p_label), 0.0))
    return lattice[slots], position[slots], entropy, surprise


def _code(lattice: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (lattice.astype(np.int64) << 32) + position


def _questions(b: Batch, refs: pa.ListArray, how: Method, by_sample: bool) -> dict[str, np.ndarray | pa.Array]:
    """The questions of all rounds of a batch of samples: lattice (its place), round, position, hyp, ref, score, errors, corrected, labels."""
    counts = np.diff(refs.offsets.to_numpy())
    flat = refs.flatten()
    known, ref = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(counts) - counts
    sign = -1.0 if how.flipped else 1.0
    asked, out, number = np.zeros(0, np.int64), [], 0

    def right(lattice: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The right labels, and whether there is one."""
        inside = (place >= 0) & (place < counts[lattice])
        at = np.where(inside, first[lattice] + place, 0)
        return (ref[at], inside & known[at]) if len(ref) else (np.zeros(len(lattice), np.int64), np.zeros(len(lattice), bool))

    b = _on_paths(b)
    while True:
        lattice, position, hyp, p = _likely(b)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(p > 0, sign * np.log(p), np.nan)
        null = ~(p > 0)
        if how.label != "identity":
            of, at, entropy, surprise = _given_labels(b)
            value = entropy - surprise if how.label == "mutual_information" else entropy
            place = np.searchsorted(_code(of, at), _code(lattice, position))
            score, null = -sign * value[place], np.zeros(len(lattice), bool)
        shown = np.bincount(lattice, minlength=b.n)
        label, there = right(lattice, np.arange(len(lattice)) - (np.cumsum(shown) - shown)[lattice])
        errors = np.maximum(shown, counts) - np.bincount(lattice[there & (label == hyp)], minlength=b.n)
        left = np.flatnonzero(~np.isin(_code(lattice, position), asked) & ((errors[lattice] > 0) | (not by_sample)))
        key = {"score": np.where(null, -math.inf, score), "label": position, "label_desc": -position}[how.order][left]
        order = left[np.lexsort((position[left], key, lattice[left]))]
        pick = order[runs(lattice[order])]
        if not len(pick):
            break
        lattice, position, hyp = lattice[pick], position[pick], hyp[pick]
        label, there = right(lattice, position.astype(np.int64) - 1)
        out.append((lattice, np.full(len(pick), number), position, hyp, label, ~there, score[pick], null[pick], errors[lattice]))
        asked = np.append(asked, _code(lattice, position))
        answered, answer, told = np.full(b.n, -(1 << 40)), np.zeros(b.n, np.int64), np.zeros(b.n, bool)
        answered[lattice], answer[lattice], told[lattice] = position, label, there
        goes_on = np.zeros(b.n, bool)
        goes_on[lattice] = True
        heard = (b.ilabel != answered[b.of]) | (b.olabel == answer[b.of]) | ~told[b.of]
        b = _with_arcs(b, heard & goes_on[b.of])
        b.begun = b.begun & goes_on
        b.start = np.where(b.begun, b.start, -1)
        b = _on_paths(b)
        number += 1
    lattice, number, position, hyp, label, unknown, score, null, errors = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)]
    return {
        "lattice": lattice,
        "round": pa.array(number.astype(np.int32)),
        "position": pa.array(position.astype(np.int32)),
        "hyp": pa.array(hyp.astype(np.int32)),
        "ref": pa.array(label.astype(np.int32), mask=unknown),
        "score": pa.array(score, pa.float64(), mask=null),
        "errors": pa.array(errors.astype(np.int32)),
        "corrected": pa.array(hyp != label, mask=unknown),
        "labels": pa.array(counts[lattice].astype(np.int32)),
    }


def _in_one_pass(rows: DataFrame, how: Method, by_sample: bool) -> DataFrame:
    """The log of a simulation, of samples with ``ref`` and ``sample_score``."""

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                own = dict(zip(part.schema.names, part.columns, strict=True))
                made = _questions(Batch(part), own["ref"], how, by_sample)
                at = pa.array(made.pop("lattice"), pa.int64())
                yield pa.RecordBatch.from_arrays([own["lattice_id"].take(at), own["sample_score"].take(at), *made.values()], names=["lattice_id", "sample_score", *made])

    kind = rows.schema["lattice_id"].dataType.simpleString()
    columns = "sample_score double, round int, position int, hyp int, ref int, score double, errors int, corrected boolean, labels int"
    log = written(sent(rows.select(*KEYS, "ref", "sample_score")).mapInArrow(run, f"lattice_id {kind}, {columns}"))
    rounds = log.agg(F.max("labels")).first()[0] or 0
    return log.filter(F.col("round") < rounds).drop("labels")


def best_labels(lattices: Lattices, method: Method, seed: int = 0) -> DataFrame:
    """lattice_id, position (input label), hyp, score: the labels a system would show now."""
    if method.recompute == "greedy":
        walked = reversed_lattices(lattices) if method.backwards else lattices
        steps = greedy_path(F.col("arcs"), F.col("start"), F.size("finals"))
        return inlined(walked.rows, steps, "position").filter("position > 0")
    if method.recompute == "hamming":
        return inlined(with_values(lattices.rows, _likeliest, "shown", SHOWN), F.col("shown"), "position")
    found = paths.shortest_path(lattices)
    rows = found.select("lattice_id", F.posexplode(F.arrays_zip("hyp", "scores")).alias("at", "s"))
    score = F.col("s.scores") if method.recompute == "viterbi" else -F.col("s.scores") if method.recompute == "sequential" else F.log(_chance("at", seed))
    return rows.select("lattice_id", (F.col("at") + 1).alias("position"), F.col("s.hyp").alias("hyp"), score.alias("score"))


def _shown(masked: DataFrame, method: Method, seed: int) -> DataFrame:
    """The rows that have a path, with their best labels and scores as an array ``shown``, ordered by position.

    What a lattice's row tells by itself is added to it where it is; other measures are joined."""
    if method.recompute == "hamming":
        rows = with_values(masked, _likeliest, "shown", SHOWN).filter("start is not null")
        if method.label in ("identity", "random"):
            sign = -1.0 if method.flipped else 1.0
            score = (lambda s: F.log(_chance(s["position"], seed))) if method.label == "random" else (lambda s: sign * s["score"])
            return rows.withColumn("shown", F.transform("shown", lambda s: F.struct(s["position"].alias("position"), s["hyp"].alias("hyp"), score(s).alias("score"))))
        rows = cut(rows)
        found = inlined(rows, F.col("shown"), "position")
    else:
        rows = cut(masked)
        rows = rows.filter("start is not null")
        found = best_labels(Lattices(rows.select(*KEYS)), method, seed)
    pool = label_scores(Lattices(rows.select(*KEYS)), found, method, seed)
    per = pool.groupBy("lattice_id").agg(F.sort_array(F.collect_list(F.struct("position", "hyp", "score"))).alias("shown"))
    return rows.drop("shown").join(per, "lattice_id")


def _chance(at: str | Column, seed: int) -> Column:
    """A number in (0, 1) drawn by the sample and position."""
    return (F.pmod(F.xxhash64("lattice_id", at, F.lit(seed)), F.lit(1_000_003)) + 1) / 1_000_005


def label_scores(lattices: Lattices, pool: DataFrame, method: Method, seed: int = 0) -> DataFrame:
    """``pool`` with the scores by which labels are asked, the least first."""
    sign = -1.0 if method.flipped else 1.0
    if method.label == "identity":
        return pool.withColumn("score", sign * F.col("score"))
    if method.label == "random":
        return pool.withColumn("score", F.log(_chance("position", seed)))
    if method.label == "expected_hamming":
        p = paths.position_probabilities(lattices).select("lattice_id", F.col("ilabel").alias("position"), F.col("olabel").alias("hyp"), "p")
        return pool.join(p, ["lattice_id", "position", "hyp"], "left").withColumn("score", -sign * F.coalesce("p", F.lit(0.0))).drop("p")
    measures = {
        "entropy": (normalise.conditional_entropy, -1),
        "mutual_information": (normalise.mutual_information, -1),
        "expected_accuracy": (normalise.conditional_expected_accuracy, 1),
        "expected_path": (normalise.conditional_expected_shortest_path, -1),
        "num_changes": (normalise.conditional_expected_num_changes, 1),
        "num_changes_hamming": (lambda x: normalise.conditional_expected_num_changes(x, paths.shortest_hamming_path), 1),
    }
    measure, direction = measures[method.label]
    value = measure(lattices).select("lattice_id", F.col("ilabel").alias("position"), "value")
    return pool.join(value, ["lattice_id", "position"], "left").withColumn("score", sign * direction * F.col("value")).drop("value")


def sample_scores(lattices: Lattices, scorer: str, seed: int = 0) -> DataFrame:
    """lattice_id, sample_score, the least first."""
    if scorer == "position":
        return lattices.rows.select("lattice_id", F.col("lattice_id").cast("double").alias("sample_score"))
    if scorer == "random":
        return lattices.rows.select("lattice_id", F.log(_chance("lattice_id", seed)).alias("sample_score"))
    if scorer == "entropy":
        return normalise.entropy(lattices).select("lattice_id", F.col("neg_entropy").alias("sample_score"))
    if scorer == "expected_error":
        return paths.shortest_hamming_path(lattices).select("lattice_id", F.col("expected_correct").alias("sample_score"))
    if scorer == "least_confident":
        return paths.shortest_path(lattices).select("lattice_id", F.col("logprob").alias("sample_score"))
    value = normalise.mutual_information(lattices)
    pick = {"max_mutual_information": F.max, "avg_mutual_information": F.avg}[scorer]
    return value.groupBy("lattice_id").agg((-pick("value")).alias("sample_score"))


def _until_right(log: DataFrame) -> DataFrame:
    """The questions asked while the errors of all samples together are not 0.

    Sorted into ranges, of which only the sums and least running sums pass through
    the driver; within each range a running sum finds the question that ends it."""
    by_sample = Window.partitionBy("lattice_id").orderBy("round")
    change = F.coalesce(F.lead("errors").over(by_sample), F.lit(0)) - F.col("errors")
    total = log.filter("round = 0").agg(F.coalesce(F.sum("errors"), F.lit(0))).first()[0]
    keys = ["order_1", "order_2", "lattice_id", "round"]
    dealt = written(log.withColumn("change", change).repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.withColumn("sum", F.sum("change").over(within))
    at, before = total, {}
    for r in running.groupBy("range").agg(F.sum("change").alias("all"), F.min("sum").alias("least")).orderBy("range").collect():
        before[r.range] = at
        if not at or at + r.least <= 0:
            break
        at += r["all"]
    if not total:
        return log.limit(0)
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range"))
    kept = running.withColumn("start", start).filter("start is not null").withColumn("left", F.col("start") + F.col("sum"))
    earlier = F.min("left").over(Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("earlier", earlier).filter("earlier is null or earlier > 0").select(*log.columns)


def simulate(lattices: Lattices, references: DataFrame, method: str | Method, seed: int = 0, by_sample: bool = False) -> DataFrame:
    """The questions of a simulated labelling: lattice_id, round, position, hyp, ref,
    corrected, score, errors (of the sample before the answer), order_1 and order_2
    (the keys by which the system asks across samples).

    ``references`` has lattice_id and ref ARRAY<INT>, the right label of each
    position from 1.  Lattices whose input labels do not number the positions of
    equally long paths take no part.  Samples are asked, those without error too, until
    none of all shows an error; with ``by_sample`` each until it shows none itself.
    """
    how = METHODS[method] if isinstance(method, str) else method
    rows = paths.with_length(lattices.rows.select(*KEYS)).filter("length > 0")
    rows = rows.join(references.select("lattice_id", "ref"), "lattice_id").filter("length = size(ref)")
    if how.normalized and how.recompute == "greedy":
        rows = cut(rows)
        made = determinize_and_normalize(replace(lattices, rows=rows.select(*KEYS)))
        rows = made.rows.join(rows.select("lattice_id", "ref"), "lattice_id")
    asked = F.array().cast("array<int>").alias("asked")
    rows = rows.select(*KEYS, "ref", asked, F.lit(None).cast("int").alias("position"), F.col("lattice_id").cast("double").alias("sample_score"))
    at_once = how.recompute == "hamming" and how.label in IN_ONE_PASS and not (how.update and how.system == "local")
    scored = how.system == "local" and how.sample != "position"
    if scored or not at_once:
        rows = cut(rows)
    if how.system == "local" and how.sample != "position":
        own = sample_scores(replace(lattices, rows=rows.select(*KEYS)), how.sample, seed)
        rows = cut(rows.drop("sample_score").join(own, "lattice_id"))
    log = _in_one_pass(rows, how, by_sample) if at_once else None
    rounds = 0 if at_once else rows.agg(F.max(F.size("ref"))).first()[0] or 0
    key = {"score": lambda s: s["score"], "label": lambda s: s["position"].cast("double"), "label_desc": lambda s: -s["position"].cast("double")}[how.order]
    for number in range(rounds):
        # masked by the last answer; those before it have been heard
        right = F.get("ref", F.col("position") - 1)
        heard = F.filter("arcs", lambda a: F.coalesce((a["ilabel"] != F.col("position")) | (a["olabel"] == right), F.lit(True)))
        masked = rows.select("lattice_id", "ref", "asked", "sample_score", trimmed(lattice(F.col("start"), F.col("finals"), heard)).alias("new"))
        masked = masked.select("lattice_id", "new.start", "new.finals", "new.arcs", "ref", "asked", "sample_score")
        state = _shown(masked, how, seed + number)
        if how.update and how.system == "local":
            state = state.drop("sample_score").join(sample_scores(Lattices(state.select(*KEYS)), how.sample, seed), "lattice_id", "left")
        left = F.filter("shown", lambda s: ~F.array_contains("asked", s["position"]))
        pick = F.array_min(F.transform(left, lambda s: F.struct(key(s).alias("k"), s["position"].alias("p"))))["p"]
        state = state.withColumns({"errors": hamming(F.transform("shown", lambda s: s["hyp"]), F.col("ref")), "position": pick})
        state = state.filter("errors > 0" if by_sample else "true").filter("position is not null")
        v = F.get(F.filter("shown", lambda s: s["position"] == F.col("position")), F.lit(0))
        state = state.select(*KEYS, "ref", F.concat("asked", F.array("position")).alias("asked"), "position", "sample_score", v["hyp"].alias("hyp"), v["score"].alias("score"), "errors")
        state = cut(state)
        ref = F.get("ref", F.col("position") - 1)
        asked_now = state.select("lattice_id", F.lit(number).alias("round"), "position", "hyp", ref.alias("ref"), "score", "errors", "sample_score", (F.col("hyp") != ref).alias("corrected"))
        log = asked_now if log is None else log.union(asked_now)
        rows = state.select(*KEYS, "ref", "asked", "position", "sample_score")
    if log is None:
        return rows.select("lattice_id", *[F.lit(None).cast("double").alias(c) for c in ("round", "position", "hyp", "ref", "score", "errors", "corrected", "order_1", "order_2")]).limit(0)
    if not at_once:
        # the rounds' rows hold lattices too: read once
        log = written(log)
    if how.system == "traversal":
        first, second = F.col("round").cast("double"), F.col("lattice_id").cast("double")
    elif how.system == "local":
        first, second = F.col("sample_score"), F.col("round").cast("double")
    else:
        so_far = Window.partitionBy("lattice_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
        first, second = F.max("score").over(so_far), F.col("round").cast("double")
    log = log.withColumn("order_1", first).withColumn("order_2", second).drop("sample_score")
    return log if by_sample else _until_right(log)


def prepared(lattices: Lattices, texts: DataFrame, scale: float = 1.0, threshold: float | None = None, normalized: bool = False) -> tuple[Lattices, DataFrame, DataFrame]:
    """What a simulation starts from: lattices with their costs scaled, and, with a threshold, pruned by
    arc posteriors and normalised if asked for; references (lattice_id, ref) of the
    texts (lattice_id, text) in the lattices' output symbols; and the share of paths that pruning left
    (lattice_id, paths, left), 0 where it left none."""
    scaled = lattices if scale == 1.0 else normalise.scale_weights(lattices, scale)
    kept = scaled if threshold is None else prune_arcs(scaled, threshold)
    if threshold is not None and normalized:
        kept = normalise.normalize(kept)
    side = "o" if lattices.symbols is None or lattices.symbols.filter("side = 'o'").head(1) else "i"
    refs = encode_symbols(texts, lattices.symbols, side).select("lattice_id", F.col("labels").alias("ref"))
    before = paths.path_count(scaled)
    after = paths.path_count(kept).withColumnRenamed("paths", "left")
    counts = before.join(after, "lattice_id", "left").select("lattice_id", F.coalesce("paths", F.lit(0.0)).alias("paths"), F.coalesce("left", F.lit(0.0)).alias("left"))
    return kept, refs, counts


def load_batch(spark: SparkSession, lattice_files: str, names: str, references: str, **options) -> tuple[Lattices, DataFrame, DataFrame]:
    """``prepared`` of HTK files: the n-th line of the text file ``references`` is the right text of the
    lattice in the file that the n-th line of ``names`` names (without its folder); options as there."""

    def lines(path: str, name: str) -> DataFrame:
        whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r?\n$", "").alias("value"))
        return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("number", name))

    found = read_htk(spark, lattice_files)
    wanted = lines(names, "name").join(lines(references, "text"), "number")
    named = found.meta.select("lattice_id", F.element_at(F.split("source", "/"), -1).alias("name")).distinct()
    last = F.element_at(F.split(F.trim("name"), "/"), -1)
    texts = wanted.withColumn("name", last).join(named, "name").select("lattice_id", "text")
    return prepared(found, texts, **options)


def progress(questions: DataFrame, references: DataFrame) -> DataFrame:
    """A row for each question in the order of the asking, and one, of step 0, before the first: step, lattice_id,
    position, asked, corrected, label_errors, wrong_samples (all so far or at that time) and their shares.

    Running sums over ranges of the order, of which one sum for each range passes through the driver."""
    sizes = references.agg(F.count("*").alias("samples"), F.sum(F.size("ref")).alias("labels")).first()
    by_sample = Window.partitionBy("lattice_id").orderBy("round")
    after = F.coalesce(F.lead("errors").over(by_sample), F.col("errors") - F.col("corrected").cast("int"))
    keys = ["order_1", "order_2", "lattice_id", "round"]
    changed = questions.select("*", after.alias("after")).select(
        *keys, "position", F.col("corrected").cast("int").alias("corrected"), F.lit(1).alias("asked"), (F.col("after") - F.col("errors")).alias("label_errors"),
        (F.when(F.col("after") > 0, 1).otherwise(0) - F.when(F.col("errors") > 0, 1).otherwise(0)).alias("wrong_samples"), "errors", "after",
    )
    names = ["asked", "corrected", "label_errors", "wrong_samples"]
    dealt = written(changed.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    start = questions.filter("round = 0").agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("label_errors"), F.count_if(F.col("errors") > 0).alias("wrong_samples")).first()
    before, so_far = {}, {"asked": 0, "corrected": 0, **start.asDict()}
    for r in dealt.groupBy("range").agg(*[F.sum(n).alias(n) for n in names]).orderBy("range").collect():
        before[r.range] = dict(so_far)
        so_far = {n: so_far[n] + r[n] for n in names}
    within = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)

    def total(n: str) -> Column:
        offset = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, int(v[n]))]) if before else F.create_map(F.lit(0), F.lit(0))
        return (F.element_at(offset, F.col("range")) + F.sum(n).over(within)).cast("long").alias(n)

    rows = dealt.select("lattice_id", "position", *[total(n) for n in names])
    first = dealt.sparkSession.range(1).select(
        F.lit(None).cast("long").alias("lattice_id"), F.lit(None).cast("int").alias("position"),
        F.lit(0).cast("long").alias("asked"), F.lit(0).cast("long").alias("corrected"), F.lit(int(start.label_errors)).cast("long").alias("label_errors"), F.lit(int(start.wrong_samples)).cast("long").alias("wrong_samples"),
    )
    rows = rows.withColumn("lattice_id", F.col("lattice_id").cast("long")).unionByName(first)
    share = {"asked_share": ("asked", sizes.labels), "corrected_share": ("corrected", sizes.labels), "label_error": ("label_errors", sizes.labels), "sample_error": ("wrong_samples", sizes.samples)}
    return rows.select(F.col("asked").alias("step"), "lattice_id", "position", *names, *[(F.col(a) / F.lit(n or 1)).alias(k) for k, (a, n) in share.items()])


def error_histogram(questions: DataFrame, references: DataFrame, step_round: int | None = None) -> DataFrame:
    """errors, samples: how many samples have how many errors before the first question, or before
    the questions of a round."""
    at = F.col("round") == (step_round or 0)
    own = questions.filter(at).select("lattice_id", "errors")
    every = references.select("lattice_id").join(own, "lattice_id", "left").select(F.coalesce("errors", F.lit(0)).alias("errors"))
    return every.groupBy("errors").agg(F.count("*").alias("samples"))


def statistics(questions: DataFrame, references: DataFrame) -> DataFrame:
    """One row: samples, labels, asked, corrected, errors at the start, and their shares."""
    first = F.col("round") == 0
    done = questions.agg(
        F.count("*").alias("asked"),
        F.count_if("corrected").alias("corrected"),
        F.coalesce(F.sum(F.when(first, F.col("errors"))), F.lit(0)).alias("errors"),
        F.count_if(first & (F.col("errors") > 0)).alias("wrong_samples"),
    ).first()
    rows = references.agg(F.count("*").alias("samples"), F.sum(F.size("ref")).alias("labels"))
    rows = rows.withColumns({k: F.lit(v) for k, v in done.asDict().items()})
    shares = {"asked_share": ("asked", "labels"), "corrected_share": ("corrected", "labels"), "label_error": ("errors", "labels"), "sample_error": ("wrong_samples", "samples")}
    return rows.withColumns({k: F.col(a) / F.col(b) for k, (a, b) in shares.items()})
