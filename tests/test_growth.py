"""What keeps the work of the lattice queries in proportion to their tables."""

import math
import os
from dataclasses import replace

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_lattices import build

from arcloom.lattice import Lattices
from arcloom.operators import automata, composition, confusion, distance, filters, frames, labelling, normalise, paths, structure
from arcloom.plans import batches
from arcloom.sources import automata_files, derive


def test_states_are_numbered_in_batches_of_lattices(spark):
    arcs = spark.createDataFrame([(1, "c", "b"), (1, "b", "a"), (1, "c", "a"), (2, "x", "y"), (2, "y", "x")], "lattice_id long, src string, dst string")
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "x"), (2, "y"), (3, "only")], "lattice_id long, node string")
    made = structure.topsort(arcs, nodes)
    got = {(r.lattice_id, r.node): r.state for r in made.collect()}
    assert got == {(1, "c"): 0, (1, "b"): 1, (1, "a"): 2, (2, "x"): -1, (2, "y"): -1, (3, "only"): 0}
    assert "FlatMapGroupsIn" not in made._jdf.queryExecution().executedPlan().toString()


def test_whole_lattices_are_trimmed_without_a_fold(spark):
    whole = build(spark, [(0, 1, 1, 1, 0.5), (0, 2, 2, 2, 0.5), (1, 2, 3, 3, 1.0)], 2)
    assert filters.connect(whole).rows.collect() == whole.rows.collect()
    # a state that no arc leads to, one that leads nowhere, and both at once
    for arcs in ([(0, 2, 1, 1, 1.0), (1, 2, 2, 2, 1.0)], [(0, 1, 1, 1, 1.0), (0, 2, 2, 2, 1.0)]):
        assert filters.connect(build(spark, arcs, 2)).rows.selectExpr("size(finals)", "size(arcs)").first() == (2, 1)
    dead = build(spark, [(1, 2, 1, 1, 1.0)], 2)
    assert filters.connect(dead).rows.selectExpr("start", "size(finals)").first() == (None, 0)
    other = build(spark, [(0, 1, 1, 1, 1.0)], 1, finals={1: math.inf})
    assert filters.connect(other).rows.selectExpr("start", "size(finals)").first() == (None, 0)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_tasks_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(derive, "LINES", 500)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    rows = derive.order_lattice(spark, SMALL).rows
    # as many tasks as the lines ask for, whatever the shuffled bytes are and the session's own number
    assert rows.rdd.getNumPartitions() == lines // 500 + 1 > 4


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_consensus_and_positions_stay_where_their_rows_are(spark):
    two = build(spark, [(0, 1, 1, 1, 0.5), (0, 2, 2, 2, 0.5), (1, 2, 3, 3, 1.0)], 2)
    base = _exchanges(two.rows)
    for made in (confusion.mbr_table(two), confusion.confusion_network(two).rows, structure.output_symbols_by_depth(two), paths.position_probabilities(two)):
        assert _exchanges(made) == base
    # paths of one and of two words: the end is the second word's alternative, and no third state is left
    net = confusion.confusion_network(two).rows.first()
    assert (len(net.finals), net.start, sorted((a.src, a.dst, a.ilabel) for a in net.arcs)) == (3, 0, [(0, 1, 1), (0, 1, 2), (1, 2, 3)])


def test_batch_distances_are_those_of_the_fold(spark):
    chain = [(s, s + 1, 1, 1 + s % 3, 0.9) for s in range(40)] + [(s, s + 2, 1, 2, 0.1) for s in range(39)]
    made = build(spark, chain, 40)
    got = {r.arc_id: r.p for r in paths.arcs_with_posterior(made).collect()}
    alpha = {(r.lattice_id, r.state): (r.alpha, r.beta) for r in distance.distances(made).collect()}
    for a in made.arcs.collect():
        total = alpha[a.lattice_id, 0][1]
        assert math.isclose(got[a.arc_id], math.exp(total - alpha[a.lattice_id, a.src][0] - a.weight - alpha[a.lattice_id, a.dst][1]), rel_tol=1e-9)
    assert [r.length for r in paths.sequence_length(made).collect()] == [-1]


def test_a_round_of_a_simulation_needs_no_exchange(spark):
    pair = build(spark, [(0, 1, 1, 1, 0.4), (0, 1, 1, 2, 0.6), (1, 2, 2, 3, 0.5), (1, 2, 2, 4, 0.5)], 2)
    held = spark.createDataFrame(pair.rows.withColumn("note", F.lit("kept")).collect(), pair.rows.withColumn("note", F.lit("")).schema)
    made = labelling._shown(held, labelling.METHODS["sequential-hamming"], 0)
    assert _exchanges(made) == 0
    row = made.first()
    # of equally likely labels the lowest; other columns stay
    assert [(s.position, s.hyp) for s in row.shown] == [(1, 2), (2, 3)] and row.note == "kept"


def test_paths_of_a_length_are_kept_without_a_fold_in_the_row(spark):
    made = build(spark, [(0, 1, 1, 1, 0.5), (0, 2, 2, 2, 0.5), (1, 2, 3, 3, 1.0), (2, 3, 4, 0, 1.0)], 3)
    for n, arcs in ((1, [(0, 1, 2), (1, 2, 0)]), (2, [(0, 1, 1), (1, 2, 3), (2, 3, 0)]), (3, [])):
        kept = filters.set_length(made, n)
        assert "aggregate(" not in kept.rows._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
        row = kept.rows.first()
        assert [(a.src, a.dst, a.olabel) for a in row.arcs] == arcs and row.start == (0 if arcs else None)
        assert [r.paths for r in paths.summary(kept).collect()] == [1] * bool(arcs)


def test_posteriors_over_an_automaton_take_one_join(spark):
    base = build(spark, [(0, 1, 1, 1, 0.25), (0, 2, 1, 1, 0.25), (0, 2, 2, 2, 0.5), (1, 2, 3, 3, 1.0)], 2)
    made = automata.posteriors_over(base, automata.determinize(normalise.remove_weights(base))).rows
    # pairs of states are followed within a batch, not by a join for each round
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1
    # the label 1 leads to both states, of which one has an arc
    assert {a.ilabel: round(math.exp(-a.weight), 6) for a in made.first().arcs} == {1: 0.5, 2: 0.5, 3: 1.0}


def test_batches_have_no_null_lists_within_structs(spark):
    """Spark's writer goes over all of these for each row, in the square of a batch's rows."""
    made = build(spark, [(0, 1, 1, 1, 0.4), (0, 1, 2, 2, 0.6), (1, 2, 3, 3, 1.0)], 2)
    one = F.transform("arcs", lambda a: a.withField("features", F.when(a["ilabel"] == 2, F.array(F.lit(7.0)))))
    for rows, features in ((made.rows, [None, None, None]), (made.rows.withColumn("arcs", one), [None, [7.0], None])):
        given = batches.sent(rows)
        assert "features" not in given.schema["arcs"].dataType.elementType.fieldNames()
        for back in (normalise.normalize(Lattices(rows)).rows, paths.with_length(rows)):
            assert [a.features for a in back.first().arcs] == features


def test_composition_with_one_automaton_needs_no_exchange(spark):
    base = build(spark, [(0, 1, 1, 5, 0.5), (0, 1, 2, 6, 0.5), (1, 2, 3, 5, 1.0)], 2)
    arcs = spark.createDataFrame([(0, 1, 5, 7, 0.5), (1, 1, 5, 8, 0.25), (0, 0, 6, 6, 0.0)], "src int, dst int, ilabel int, olabel int, weight double")
    states = spark.createDataFrame([(0, math.inf, True), (1, 0.0, False)], "state int, final double, is_start boolean")
    made = composition.compose(base, composition.Automaton(arcs, states)).rows
    assert _exchanges(made) == _exchanges(base.rows)
    row = made.first()
    assert [(a.src, a.dst, a.olabel) for a in row.arcs] == [(0, 1, 6), (0, 2, 7), (1, 3, 7), (2, 3, 8)] and row.finals[3] == 0.0


def test_binary_files_are_written_from_rows_without_null_lists(spark):
    made = build(spark, [(0, 1, 1, 1, 0.4), (0, 1, 2, 2, 0.6)], 1)
    written = automata_files.to_binary(made)
    plan = written._jdf.queryExecution().analyzed().toString()
    assert "features" in plan.split("MapInArrow")[1].split("\n")[0]
    assert automata_files.parse_binary(written).arcs.count() == 2


def test_words_are_split_by_batch_with_one_join(spark):
    base = build(spark, [(0, 1, 1, 1, 0.5), (0, 1, 2, 2, 0.5), (1, 2, 3, 3, 0.5), (1, 2, 0, 0, 0.5)], 2)
    names = spark.createDataFrame([(1, "i", 1, "ab_d"), (1, "i", 2, "ab_c")], "lattice_id long, side string, label int, symbol string")
    made = structure.split_symbols(replace(base, symbols=names))
    # rows meet their words once; nodes and labels are numbered within a batch
    before, plan = (x.rows._jdf.queryExecution().executedPlan().toString() for x in (base, made))
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == before.count("Join") + 1 and "Window" not in plan
    row = made.rows.first()
    # 3 has no word and stands for itself, an epsilon stays one; the two words share their beginning
    assert [(r.label, r.symbol) for r in made.symbols.filter("side = 'o'").orderBy("label").collect()] == [(1, "3"), (2, "ab"), (3, "c"), (4, "d")]
    assert [(a.src, a.dst, a.ilabel) for a in row.arcs] == [(0, 1, 2), (1, 2, 3), (1, 2, 4), (2, 3, 0), (2, 3, 1)]
    assert (row.start, row.finals) == (0, [math.inf] * 3 + [0.0])


def test_levels_of_small_lattices_are_gone_through_at_once(spark):
    """A small lattice and one of too many arcs: rows for the first, joins by level for the other only."""
    small = [(1, 0, 1, 1, 1, 0.5, 0, [2.0]), (1, 0, 2, 2, 2, 1.0, 1, None), (1, 1, 2, 3, 3, 0.25, 2, None), (1, 3, 2, 4, 4, 0.0, 3, None)]
    kind = "lattice_id long, src int, dst int, ilabel int, olabel int, weight double, arc_id long, features array<double>"
    arcs, states = spark.createDataFrame(small, kind), spark.createDataFrame([(1, s, math.inf if s < 2 else 0.0, s == 0) for s in range(4)], "lattice_id long, state int, final double, is_start boolean")
    wide = spark.range(frames.FOLD_ARCS + 1).selectExpr("2L AS lattice_id", "0 AS src", "1 AS dst", "CAST(id AS INT) AS ilabel", "7 AS olabel", "1.0D AS weight", "id AS arc_id", "CAST(null AS array<double>) AS features")
    ends = spark.createDataFrame([(2, 0, math.inf, True), (2, 1, 0.0, False)], states.schema)
    got = frames.Levelled(arcs, states)
    both = frames.Levelled(arcs.unionByName(wide), states.unionByName(ends))
    want = frames._Large(arcs, states)
    close = lambda a, b: a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in b)
    for name in ("forward", "backward", "mass"):
        key = lambda f: {tuple(r[:-1]): r[-1] for r in f.collect() if r.lattice_id == 1}
        assert close(key(getattr(got, name)()), key(getattr(want, name)())) and close(key(getattr(both, name)()), key(getattr(want, name)()))
    assert got.large is None and both.large is not None
    for made, other in ((got.posteriors(), want.posteriors()), (got.posteriors(False), want.posteriors(False)), (got.normalize()[0], want.normalize()[0])):
        assert made.columns == arcs.columns
        key = lambda f: {(r.arc_id, r.src, r.dst, r.ilabel, tuple(r.features or ())): r.weight for r in f.collect()}
        assert close(key(made), key(other)) and len(key(made)) == 3
    assert both.posteriors().groupBy("lattice_id").count().collect() and both.mass().filter("lattice_id = 2").count() == 1


def test_small_lattices_given_as_frames_are_minimised_at_once(spark):
    arcs = [(0, 1, 1), (0, 2, 2), (1, 3, 3), (2, 4, 3), (1, 5, 4), (2, 5, 4), (3, 5, 5), (4, 5, 5), (2, 3, 6)]
    tree = build(spark, [(s, d, x, x, 1.0) for s, d, x in arcs[:-1]], 5)
    uneven = build(spark, [(s, d, x, x, 1.0) for s, d, x in arcs], 5, lattice_id=2)
    both = [a.unionByName(b) for a, b in ((tree.arcs, uneven.arcs), (tree.states, uneven.states))]
    got, large = frames.minimize(*both), frames._minimize_large(*both, 9)
    for mine, theirs in zip(got, large, strict=True):
        assert mine.columns == theirs.columns and sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))
    assert {r.lattice_id: r["count"] for r in got[1].groupBy("lattice_id").count().collect()} == {1: 4, 2: 5}
