"""Literal lattices with values calculated by hand."""

import math
import struct
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from arcloom.functions import semiring, text
from arcloom.lattice import Lattices
from arcloom.operators import automata, composition, confusion, distance, edit_distance, filters, frames, labelling, normalise, paths, structure
from arcloom.plans.kernels import Shape, plan_kernel, shape
from arcloom.sources import automata_files, text_lattices


def build(spark, arcs, final, lattice_id=1, finals=None):
    """arcs: (src, dst, ilabel, olabel, probability)."""
    rows = [(lattice_id, s, d, i, o, -math.log(p), k) for k, (s, d, i, o, p) in enumerate(arcs)]
    a = spark.createDataFrame(rows, "lattice_id long, src int, dst int, ilabel int, olabel int, weight double, arc_id long")
    finals = {final: 0.0} if finals is None else finals
    s = spark.createDataFrame([(lattice_id, k, finals.get(k, math.inf)) for k in range(final + 1)], "lattice_id long, state int, final double")
    return Lattices.from_frames(a, s)


@pytest.fixture(scope="module")
def query3(spark):
    return build(spark, [(0, 1, 0, 0, 0.4), (0, 1, 0, 1, 0.6), (1, 2, 1, 2, 0.5), (1, 2, 1, 0, 0.5)], 2)


@pytest.fixture(scope="module")
def seqlab3(spark):
    return build(spark, [(0, 1, 1, 0, 0.4), (0, 1, 1, 1, 0.6), (1, 2, 2, 2, 0.6), (1, 2, 2, 0, 0.4)], 2)


@pytest.fixture(scope="module")
def eps_dag(spark):
    return build(spark, [(0, 1, 1, 1, 0.5), (0, 2, 2, 2, 0.5), (1, 2, 0, 0, 0.4), (1, 3, 3, 3, 0.6), (2, 3, 3, 3, 1.0)], 3)


def mass(lattices, semiring="log"):
    row = distance.mass(lattices, semiring).first()
    return 0.0 if row is None or row.mass is None else math.exp(-row.mass)


@pytest.mark.parametrize(
    "label,member,log,best", [(0, 0, 0.4, 0.2), (0, 1, 0.6, 0.3), (1, 0, 0.5, 0.3), (1, 2, 0.5, 0.3), (0, 2, 0, 0), (1, 1, 0, 0)]
)
def test_removing_and_redirecting_arcs_agree(query3, label, member, log, best):
    keep = filters.query_filter(label, member)
    for made in (filters.rm_arc(query3, keep), filters.mask_dead(query3, keep), filters.mask_zero(query3, keep)):
        assert mass(made) == pytest.approx(log)
        assert mass(made, "tropical") == pytest.approx(best)


def test_normalize(spark):
    made = normalise.normalize(build(spark, [(0, 1, 0, 0, 0.8), (0, 1, 0, 1, 1.2), (1, 2, 1, 2, 1.0), (1, 2, 1, 0, 1.0)], 2))
    assert sorted(round(math.exp(-r.weight), 6) for r in made.arcs.collect()) == [0.4, 0.5, 0.5, 0.6]
    assert normalise.is_probabilistic(made).first().ok
    assert normalise.entropy(made).first().neg_entropy == pytest.approx(-1.366159, abs=1e-6)


def test_sequence_measures(seqlab3):
    assert paths.sequence_length(seqlab3).first().length == 2
    assert normalise.entropy(seqlab3).first().neg_entropy == pytest.approx(-1.346023, abs=1e-6)
    for measure, want in ((normalise.conditional_entropy, (-0.680470, -1.003515)), (normalise.mutual_information, (-0.007458, -0.330504))):
        assert [r.value for r in measure(seqlab3).orderBy("ilabel").collect()] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("label,member,hyp", [(None, None, [1, 2]), (1, 0, [0, 2]), (1, 1, [1, 2]), (2, 2, [1, 2]), (2, 0, [1, 0])])
def test_best_path_under_masks(seqlab3, label, member, hyp):
    masked = seqlab3 if label is None else filters.mask_zero(seqlab3, filters.query_filter(label, member))
    assert paths.shortest_path(masked).first().hyp == hyp


def test_unequal_lengths_have_no_sequence_length(spark):
    bad = build(spark, [(0, 1, 1, 1, 0.5), (1, 2, 2, 2, 1.0), (0, 2, 1, 3, 0.5)], 2)
    assert paths.sequence_length(bad).first().length == -1


def test_epsilons(eps_dag):
    assert paths.path_count(eps_dag).first().paths == 3
    assert mass(eps_dag) == pytest.approx(1) and mass(eps_dag, "tropical") == pytest.approx(0.5)
    posts = [round(math.exp(-r.weight), 6) for r in normalise.arc_posteriors(eps_dag).orderBy("arc_id").collect()]
    assert posts == [0.5, 0.5, 0.2, 0.3, 0.7]
    table = {(r.position, r.label): round(r.p, 6) for r in confusion.mbr_table(eps_dag).collect()}
    assert table == {(1, 1): 0.5, (1, 2): 0.5, (2, 3): 1.0, (3, -1): 1.0}
    for n, count in ((2, 3), (1, None)):
        row = paths.summary(filters.set_length(eps_dag, n)).first()
        assert (row and row.paths) == count


def test_epsilon_removal_and_determinisation(eps_dag):
    plain = automata.rm_epsilon(eps_dag)
    assert not plain.arcs.filter("ilabel = 0 and olabel = 0").count()
    assert mass(plain) == pytest.approx(1)
    made = automata.determinize(plain)
    assert paths.summary(made).first().paths == 2 and mass(made) == pytest.approx(1)
    small = automata.determinize(plain, max_states=1)
    assert small.meta.first().error == "too many states"
    norm = automata.determinize_and_normalize(eps_dag)
    assert sorted(round(math.exp(-r.weight), 6) for r in norm.arcs.collect()) == [0.5, 0.5, 1.0]


def test_k_best_unique(spark):
    twice = build(spark, [(0, 1, 1, 7, 0.5), (0, 1, 1, 7, 0.2), (0, 1, 1, 8, 0.3)], 1)
    assert [r.hyp for r in paths.k_best(twice, 3).orderBy("rank").collect()] == [[7], [8], [7]]
    assert [r.hyp for r in paths.k_best(twice, 3, unique=True).orderBy("rank").collect()] == [[7], [8]]
    assert paths.k_best(twice, 3, weight_threshold=0.6).count() == 2


def test_rm_prefix(spark):
    chain = build(spark, [(0, 1, 1, 1, 0.5), (1, 2, 2, 2, 0.4), (1, 2, 2, 3, 0.6)], 2)
    cut, ok = filters.rm_prefix(chain, 1)
    assert ok.first().ok and mass(cut) == pytest.approx(0.5) and normalise.num_states(cut).first().states == 2
    same, ok = filters.rm_prefix(chain, 2)
    assert not ok.first().ok and normalise.num_states(same).first().states == 3


def test_prune_with_floor_keeps_arcs(seqlab3):
    assert filters.prune_arcs(seqlab3, 0.1).arcs.count() == 2
    assert filters.prune_arcs(seqlab3, 0.1, floor=50.0).arcs.count() == 4


def test_log_linear_weights(spark):
    one, zero, none = (semiring.vector_constant(k) for k in ("ONE", "ZERO", "NONE"))
    v = lambda w, *f: semiring.vector(F.lit(float(w)), F.array(*[F.lit(float(x)) for x in f]))
    df = spark.range(1).select(
        semiring.vector_text(semiring.vector_plus(v(1, 1), v(1, 2))).alias("tie"),
        semiring.vector_text(semiring.vector_times(v(1, 1, 2), v(2, 3, 4))).alias("times"),
        semiring.vector_text(semiring.vector_times(v(1, 1), v(2, 3, 4))).alias("mismatch"),
        semiring.vector_text(semiring.vector_times(one, zero)).alias("absorb"),
        semiring.vector_text(semiring.vector_divide(v(3, 5), v(1, 2))).alias("divide"),
        semiring.vector_text(semiring.vector_divide(v(3, 5), none)).alias("by_none"),
        semiring.vector_equal(v(1, 1), v(1.05, 1), 0.1).alias("near"),
        semiring.vector_text(semiring.vector_update(v(9, 1, 2), F.array(F.lit(2.0), F.lit(3.0)))).alias("update"),
        semiring.sub_log(F.lit(0.0), F.lit(0.0)).alias("nothing"),
        semiring.add_log(F.lit(-math.inf), F.lit(-1.0)).alias("some"),
    )
    r = df.first()
    assert (r.tie, r.times, r.mismatch, r.absorb, r.divide, r.by_none) == ("1.0,2.0", "3.0,4.0,6.0", "NONE", "ZERO", "2.0,3.0", "NONE")
    assert r.near and r.update == "8.0,1.0,2.0" and r.nothing == -math.inf and r.some == -1.0


def test_text_functions(spark):
    r = spark.range(1).select(
        text.tokenize(F.lit("a__b-c"), "_-").alias("t"),
        text.tokenize(F.lit("ab"), "").alias("chars"),
        text.common_length(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3))).alias("common"),
        text.hamming(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3), F.lit(4))).alias("hamming"),
        text.edit_distance(F.split(F.lit("kitten"), ""), F.split(F.lit("sitting"), "")).alias("edits"),
        text.edit_distance(F.array().cast("array<string>"), F.split(F.lit("abc"), "")).alias("from_empty"),
        text.to_number(F.lit(" -inf ")).alias("inf"),
        text.trim(F.lit("\t a \n")).alias("trim"),
    ).first()
    assert r.t == ["a", "b", "c"] and r.chars == ["a", "b"] and (r.common, r.hamming, r.edits, r.from_empty) == (1, 2, 3, 3)
    assert r.inf == -math.inf and r.trim == "a"


HTK = """# Header (generated by a recogniser)
VERSION=1.1
UTTERANCE=25730992H
NODES=173 LINKS=1513
# Nodes
I=0
I=1
# Links
J=0 S=0 E=1 W=Hello a=-10
J=1 S=0 E=1 W=Crocodile a=-12
"""


def htk(spark, text_, **options):
    return text_lattices.parse_htk(spark.createDataFrame([(1, text_)], "lattice_id long, text string"), **options)


def test_htk(spark):
    made = htk(spark, HTK)
    assert [(r.src, r.dst, r.ilabel, r.weight) for r in made.arcs.orderBy("arc_id").collect()] == [(0, 1, 1, 10.0), (0, 1, 2, 12.0)]
    assert {(r.label, r.symbol) for r in made.symbols.collect()} == {(1, "Hello"), (2, "Crocodile")}
    p = sorted(math.exp(-r.weight) for r in normalise.normalize_posteriors(made)[0].arcs.collect())
    assert p == pytest.approx([0.119203, 0.880797], abs=1e-6)
    assert normalise.entropy(normalise.normalize(made)).first().entropy == pytest.approx(0.365334, abs=1e-6)
    assert made.meta.first().utterance == "25730992H"


def test_htk_options(spark):
    made = htk(
        spark,
        'base=10\nlmscale=2 acscale=0.5\namscale=4\nx1scale=3\nN=3 L=2\nI=0\nI=010\nI=2\n'
        'J=0 S=0 E=8 W="a b" O=x a=-1 l=-2 x1=-1 foo=bar\nJ=1 S=8 E=2 W=!NULL d=:x,1: a=-4\n',
    )
    first, second = made.arcs.orderBy("src").collect()
    ten = math.log(10)
    assert first.weight == pytest.approx((0.5 + 4 + 3) * ten / 4) and second.weight == pytest.approx(2 * ten / 4)
    assert (first.ilabel, first.olabel, second.ilabel) == (1, 1, 0)
    assert made.meta.first().feature_names == ["language", "acoustic", "xscore1"]
    assert first.features == pytest.approx([2 * ten, ten, ten])
    assert text_lattices.set_feature_weights(made, [1.0, 0.0, 0.0]).arcs.orderBy("src").first().weight == pytest.approx(2 * ten)


@pytest.mark.parametrize("text_,error", [("I=0\nI=1\nI=2\nJ=0 S=0 E=2\nJ=1 S=1 E=2\n", "not a single start"), ("I=0\nI=1\nJ=0 S=0 E=1\nJ=1 S=1 E=0\n", "cycle"), ("base=0\nI=0\nI=1\nJ=0 S=0 E=1 a=1\n", "base")])
def test_htk_errors_are_told(spark, text_, error):
    made = htk(spark, text_)
    assert made.meta.first().error == error and made.rows.count() == 0


def test_thot(spark):
    made = text_lattices.parse_thot(spark.createDataFrame([(1, "# x\n2 3\n0 1 -1.5 good day\n1 2 -0.5 sir\n\n1 3 -1 madam\n")], "lattice_id long, text string"))
    assert normalise.num_states(made).first().states == 3
    assert mass(made) == pytest.approx(math.exp(-2) + math.exp(-2.5))
    assert "good day" in {r.symbol for r in made.symbols.collect()}


def test_compressed_files(spark, tmp_path):
    import bz2
    import gzip

    (tmp_path / "a.lat").write_text(HTK)
    (tmp_path / "b.lat.gz").write_bytes(gzip.compress(HTK.encode()))
    (tmp_path / "c.lat.bzip2").write_bytes(bz2.compress(HTK.encode()))
    made = text_lattices.read_htk(spark, str(tmp_path))
    assert made.rows.count() == 3 and made.arcs.count() == 6
    text_lattices.write_lattices(made, str(tmp_path / "out"))
    assert text_lattices.read_lattices(spark, str(tmp_path / "out"), symbols=True, meta=True).arcs.count() == 6
    text_lattices.write_texts(text_lattices.to_htk_text(made), str(tmp_path / "text"), "gzip")
    assert list((tmp_path / "text").glob("lattice_id=*/*.gz"))
    assert text_lattices.arc_lines(made).count() == 9


def test_split_symbols(spark):
    from dataclasses import replace

    base = build(spark, [(0, 1, 1, 1, 0.5), (0, 1, 2, 2, 0.5), (1, 2, 3, 3, 1.0)], 2)
    names = spark.createDataFrame([(1, "i", 1, "ab_c"), (1, "i", 2, "ab_d"), (1, "i", 3, "</s>")], "lattice_id long, side string, label int, symbol string")
    made = structure.split_symbols(replace(base, symbols=names))
    row = paths.summary(made).first()
    assert (row.paths, row.n_arcs, row.states) == (2, 4, 4) and math.exp(-row.mass) == pytest.approx(1)
    spaced = paths.summary(structure.split_symbols(replace(base, symbols=names), space="_")).first()
    assert (spaced.paths, spaced.n_arcs) == (2, 6)


def test_reverse_and_bounds(eps_dag):
    back = structure.reverse(eps_dag)
    assert mass(back) == pytest.approx(1) and paths.path_count(back).first().paths == 3
    ends = structure.add_start_end(eps_dag, 8, 9)
    best = paths.shortest_path(ends, include_final=True).first()
    assert best.hyp[0] == 8 and best.hyp[-1] == 9


def test_edit_distance_features(eps_dag, spark):
    prefix = spark.createDataFrame([(1, [1])], "lattice_id long, prefix array<int>")
    found = {r.word: r for r in edit_distance.edit_distance_features(eps_dag, prefix).collect()}
    assert found[3].cost == 0 and found[3].weight == pytest.approx(-math.log(0.3))
    # after "1 3": one word more than the prefix
    assert found[-1].cost == 1
    assert len(found[3].features) == len(edit_distance.feature_names())


def test_level_distances_agree_with_the_fold(eps_dag, spark):
    states = spark.createDataFrame([(1, 0, 0, True), (1, 1, 1, False), (1, 2, 2, False), (1, 3, 3, False)], "lattice_id long, state int, level int, is_start boolean")
    for kind in ("log", "tropical"):
        got = {r.state: r.alpha for r in distance.level_distances(eps_dag.arcs, states, 3, kind).collect()}
        want = {r.state: r.alpha for r in distance.distances(eps_dag, kind).collect()}
        assert got == pytest.approx(want)
    assert shape(eps_dag.arcs) == Shape(1, 4, 5)
    assert plan_kernel(shape(eps_dag.arcs)) == "fold" and plan_kernel(Shape(1, 10**6, 10**7)) == "levels"


def test_an_empty_collection(eps_dag):
    from dataclasses import replace

    none = replace(eps_dag, rows=eps_dag.rows.filter("false"))
    assert distance.mass(none).count() == 0 and normalise.normalize(none).rows.count() == 0 and paths.shortest_path(none).count() == 0


def test_sixty_methods():
    assert len(labelling.METHODS) == 60


@pytest.mark.parametrize("method", ["random", "sequential-path", "reverse-sequential-symbol", "sorted-viterbi", "sorted-updated-sequential-mutual-information", "active-label-num-changes-hamming-global-m", "active-label-entropy"])
def test_simulation_ends_with_all_labels_right(seqlab3, spark, method):
    from dataclasses import replace

    # labels from 1, as 0 is epsilon
    base = seqlab3.map_arcs(lambda a: a.withField("olabel", a["olabel"] + 1))
    base = replace(base, rows=base.rows)
    refs = spark.createDataFrame([(1, [1, 3])], "lattice_id long, ref array<int>")
    asked = labelling.simulate(base, refs, method).collect()
    assert 1 <= len(asked) <= 2 and sum(r.corrected for r in asked) == 1


def test_simulation_asks_until_the_corpus_is_right(seqlab3, spark):
    from dataclasses import replace

    base = seqlab3.map_arcs(lambda a: a.withField("olabel", a["olabel"] + 1))
    rows = base.rows.drop("lattice_id")
    base = replace(base, rows=rows.withColumn("lattice_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]))).select(base.rows.columns))
    refs = spark.createDataFrame([(1, [2, 3]), (2, [1, 3]), (3, [2, 3])], "lattice_id long, ref array<int>")
    asked = labelling.simulate(base, refs, "sequential-hamming").cache()
    assert sorted((r.lattice_id, r.position, r.errors, r.corrected) for r in asked.collect()) == [(1, 1, 0, False), (1, 2, 0, False), (2, 1, 1, True)]
    counted = labelling.statistics(asked, refs).first()
    assert (counted.asked, counted.corrected, counted.errors, counted.wrong_samples) == (3, 1, 1, 1)
    right = spark.createDataFrame([(1, [2, 3])], "lattice_id long, ref array<int>")
    assert labelling.simulate(base, right, "sequential-hamming").count() == 0


@pytest.mark.parametrize("method, by_sample", [("sequential-hamming", False), ("active-label-mutual-information-global", True)])
def test_all_rounds_of_a_batch_in_one_pass(spark, monkeypatch, method, by_sample):
    """The questions of a simulation that goes round by round, here of lattices of which paths have two arcs of a position;
    no round's lattices are written."""
    from conftest import SMALL

    from arcloom.lattice import with_fields
    from arcloom.sources import derive

    base = derive.order_sausage(spark, SMALL)
    base = replace(base, rows=base.rows.filter("lattice_id % 40 = 0"))
    refs = base.arcs.groupBy("lattice_id", "src").agg(F.max("olabel").alias("m")).groupBy("lattice_id")
    refs = refs.agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "m"))), lambda x: x["m"]).alias("ref"))
    base = base.map_arcs(lambda a: with_fields(a, ilabel=((a["ilabel"] + 1) / 2).cast("int")))

    def rows():
        names = ("lattice_id", "round", "position", "hyp", "ref", "corrected", "errors")
        found = labelling.simulate(base, refs, method, by_sample=by_sample).collect()
        return sorted((*(r[n] for n in names), *(round(r[n], 7) for n in ("score", "order_1", "order_2"))) for r in found)

    by_round = labelling.cut
    monkeypatch.setattr(labelling, "cut", None)
    got = rows()
    monkeypatch.setattr(labelling, "cut", by_round)
    monkeypatch.setattr(labelling, "IN_ONE_PASS", ())
    assert got == rows() and len(got) > 20


def test_read_text_lattices_are_not_kept_as_uncompressed_rows(spark, monkeypatch):
    """What reading goes through more than once is written as Parquet, half the disk of a checkpoint's rows or less."""
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", None)
    text = "VERSION=1.0\nN=3 L=2\nI=0\nI=1\nI=2\nJ=0 S=0 E=1 W=a l=-1.0\nJ=1 S=1 E=2 W=b l=-2.0\n"
    made = text_lattices.parse_htk(spark.createDataFrame([(1, text), (2, text.replace("W=b", "W=c"))], "lattice_id long, text string"))
    got = made.arcs.join(made.symbols.filter("side = 'i'"), [made.arcs.lattice_id == made.symbols.lattice_id, F.col("ilabel") == F.col("label")])
    assert sorted((r.src, r.dst, r.symbol, r.weight) for r in got.collect()) == [(0, 1, "a", 1.0), (0, 1, "a", 1.0), (1, 2, "b", 2.0), (1, 2, "c", 2.0)]


def test_determinization_has_no_cap_of_its_own(monkeypatch):
    n = 10_001
    machine = automata._Machine([[((1, k), k, 0.0) for k in range(1, n + 1)], *[[((2, 1), n + 1, 0.0)] for _ in range(n)], []], [math.inf] * (n + 1) + [0.0])
    assert machine.determinized(10_000) is None
    assert len(machine.determinized().arcs) == n + 2
    monkeypatch.setattr(automata, "_per_lattice", lambda _, change: change(machine))
    for other in ("connect", "normalize", "rm_epsilon"):
        monkeypatch.setattr(automata, other, lambda x, *_: x)
    monkeypatch.setattr(automata, "_weighted", lambda shape, _: shape)
    for made in (automata.determinize(None), automata.determinize_weights_and_normalize(None), automata.determinize_and_normalize(None)):
        assert made is not None


def test_bundles(spark, tmp_path):
    made = text_lattices.to_htk_text(text_lattices.parse_htk(spark.createDataFrame([(i, "f", HTK) for i in range(7)], "lattice_id long, source string, text string")))
    text_lattices.write_bundles(made.repartition(2), str(tmp_path / "b"), "gzip")
    back = {r.lattice_id: r.text for r in text_lattices.read_bundles(spark, str(tmp_path / "b")).collect()}
    assert back == {r.lattice_id: r.text for r in made.collect()} and len(back) == 7
    assert len(list((tmp_path / "b").glob("*.gz"))) == 2


def test_frames_by_levels_as_by_fold(spark, query3, eps_dag, monkeypatch):
    for made in (query3, eps_dag):
        folded = {(r.lattice_id, r.state): r.alpha for r in distance.frame_distances(made.arcs, made.states).collect()}
        monkeypatch.setattr("arcloom.plans.kernels.FOLD_STATES", 0)
        levels = {(r.lattice_id, r.state): r.alpha for r in distance.frame_distances(made.arcs, made.states).collect()}
        monkeypatch.undo()
        assert levels.keys() == folded.keys()
        assert all(abs(levels[k] - folded[k]) < 1e-9 for k in folded)


def test_lattice_of_a_million_arcs_as_frames(spark):
    """Eleven levels of 316 states, each joined to all of the next: distances, posteriors and normalisation by levels."""
    import numpy as np

    wide, deep = 316, 11
    arcs = spark.range(wide * wide * (deep - 1)).selectExpr(
        "1L AS lattice_id", f"CAST(id DIV {wide} AS INT) AS src", f"CAST((id DIV {wide * wide} + 1) * {wide} + id % {wide} AS INT) AS dst",
        "1 AS ilabel", "2 AS olabel", "(id % 97 + 1) / 10.0D AS weight", "id AS arc_id",
    )
    states = spark.range(wide * deep).selectExpr("1L AS lattice_id", "CAST(id AS INT) AS state", f"IF(id >= {wide * (deep - 1)}, id % 3, double('inf')) AS final", "id = 0 AS is_start")
    assert plan_kernel(shape(arcs)) == "levels"
    weight = (np.arange(wide * wide * (deep - 1)) % 97 + 1).reshape(deep - 1, wide, wide) / 10.0
    add = lambda x, axis: (m := x.min(axis)) - np.log(np.exp(np.expand_dims(m, axis) - x).sum(axis))
    alpha = [np.where(np.arange(wide) == 0, 0.0, 1e9)]
    for w in weight:
        alpha.append(add(alpha[-1][:, None] + w, 0))
    beta = [np.arange(wide * (deep - 1), wide * deep) % 3 * 1.0]
    for w in weight[::-1]:
        beta.insert(0, add(w + beta[0][None, :], 1))
    by_level = frames.Levelled(arcs, states)
    got = {r.state: r.beta for r in by_level.backward().collect()}
    reached = [0, *range(wide, wide * deep)]
    assert sorted(got) == reached and all(abs(got[s] - beta[s // wide][s % wide]) < 1e-9 for s in reached)
    assert abs(by_level.mass().first().mass - beta[0][0]) < 1e-9
    post = by_level.posteriors()
    cost = alpha[5][7] + weight[5][7][11] + beta[6][11] - beta[0][0]
    assert abs(post.filter(f"src = {5 * wide + 7} AND dst = {6 * wide + 11}").first().weight - cost) < 1e-9
    assert post.count() == wide + wide * wide * (deep - 2)
    sums = by_level.normalize()[0].groupBy("src").agg(F.sum(F.exp(-F.col("weight"))).alias("p"))
    assert sums.filter(F.abs(F.col("p") - 1) > 1e-9).count() == 0 and sums.count() == 1 + wide * (deep - 2)


def test_epsilon_closure_and_minimisation_of_frames(spark, eps_dag):
    """A chain of epsilons of seven arcs with a way round, and machines whose states stand for several, as per lattice."""
    chain = build(spark, [(s, s + 1, 0, 0, 0.5) for s in range(7)] + [(2, 5, 0, 0, 0.25), (7, 8, 1, 2, 0.75), (3, 8, 4, 4, 0.125)], 8)
    for base in (chain, eps_dag):
        arcs, states = frames.rm_epsilon(base.arcs, base.states)
        assert not arcs.filter("ilabel = 0 AND olabel = 0").count()
        want = automata.rm_epsilon(base)
        made = filters.connect(Lattices.from_frames(arcs, states))
        assert same_paths(all_paths(made), all_paths(want))
    tree = build(spark, [(0, 1, 1, 1, 0.5), (0, 2, 2, 2, 0.5), (1, 3, 3, 3, 1.0), (2, 4, 3, 3, 1.0), (3, 5, 4, 4, 0.5), (4, 6, 4, 4, 0.5), (3, 5, 5, 5, 0.5), (4, 6, 5, 5, 0.5)], 6)
    rows = tree.rows.withColumn("finals", F.transform("finals", lambda f, s: F.when((s == 5) | (s == 6), 0.0).otherwise(f)))
    tree = replace(tree, rows=rows)
    arcs, states = frames.minimize(tree.arcs, tree.states)
    assert states.count() == 4 == normalise.num_states(automata.minimize(tree)).first().states
    assert arcs.count() == 5 and states.filter("is_start").count() == 1
    assert abs(frames.Levelled(arcs, states).mass().first().mass - distance.mass(tree).first().mass) < 1e-9


def test_entropies_given_labels_of_any_lattice(spark, eps_dag):
    """Linear and masked ways against the measure of each masked lattice; a path with two arcs of a position, and epsilons."""
    once = normalise.normalize(build(spark, [(0, 1, 1, 5, 0.4), (0, 2, 1, 5, 0.3), (0, 2, 1, 6, 0.3), (1, 2, 2, 5, 0.5), (1, 3, 2, 7, 0.5), (2, 3, 3, 8, 0.9), (2, 3, 3, 9, 0.1)], 3))
    twice = normalise.normalize(build(spark, [(0, 1, 1, 5, 0.4), (0, 1, 1, 6, 0.6), (1, 2, 1, 5, 0.5), (1, 2, 2, 7, 0.5)], 2))
    for made in (once, twice, eps_dag):
        rows = normalise.hypotheses(made)
        value = normalise.neg_entropy_of(F.col("arcs"), F.col("start"), F.col("finals"))
        for measure, v in ((normalise.conditional_entropy, value), (normalise.mutual_information, value - F.log("p"))):
            want = {r.ilabel: r.value for r in normalise._over_hypotheses(rows, v).collect()}
            got = {r.ilabel: r.value for r in measure(made).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_lattice_of_ten_thousand_states(spark):
    n = 10_000
    arcs = spark.range(n).selectExpr("1L AS lattice_id", "CAST(id AS INT) AS src", "CAST(id + 1 AS INT) AS dst", "explode(array(1, 2)) AS ilabel").selectExpr(
        "*", "ilabel AS olabel", "-ln(ilabel / 2.0D) AS weight"
    )
    made = normalise.normalize(Lattices.from_frames(arcs))
    assert normalise.is_probabilistic(made, 1e-6).first().ok
    weights = made.arcs.groupBy("ilabel").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).orderBy("ilabel").collect()
    for row, p in zip(weights, (1 / 3, 2 / 3), strict=True):
        assert abs(row.lo + math.log(p)) < 1e-6 and abs(row.hi + math.log(p)) < 1e-6


def test_posteriors_over_a_given_automaton(spark, seqlab3):
    """The labels (1, 0) and (1, 1) lead to one state, (2, 2) has an arc and (2, 5), which no path has, another."""
    shape = build(spark, [(0, 1, 1, 0, 1.0), (0, 1, 1, 1, 1.0), (1, 2, 2, 0, 1.0), (1, 2, 2, 2, 1.0), (1, 2, 2, 5, 1.0)], 2)
    got = {(r.ilabel, r.olabel): round(math.exp(-r.weight), 6) for r in automata.posteriors_over(seqlab3, shape).arcs.collect()}
    assert got == {(1, 0): 0.4, (1, 1): 0.6, (2, 0): 0.4, (2, 2): 0.6, (2, 5): 0.0}


def test_automata_files(spark, eps_dag, tmp_path):
    """Binary and line forms: round trips with costs, states out of order, cycles and broken files named in meta."""
    (tmp_path / "a.fst").write_bytes(automata_files.to_binary(eps_dag, "log64").first().data)
    back = automata_files.read_binary(spark, str(tmp_path))
    assert same_paths(all_paths(back), all_paths(eps_dag))
    text = "\n".join(r.line for r in text_lattices.arc_lines(eps_dag).collect())
    texts = spark.createDataFrame(
        [(1, text), (2, "3 1 5 6 0.5\n1 2 7 7 0.25\n2 1.5\n0 2 9\n\n"), (3, "0 1 1\n1 0 1\n1"), (4, "x y z"), (5, ""), (6, None)], "lattice_id long, text string"
    )
    made = automata_files.parse_lines(texts)
    one = lambda i: all_paths(replace(made, rows=made.rows.filter(f"lattice_id = {i}")))
    assert same_paths(one(1), all_paths(eps_dag)) and same_paths(one(2), [((5, 7), (6, 7), 2.25)])
    assert {r.lattice_id: r.error for r in made.meta.collect()}.keys() == {3, 4}
    good = bytes(automata_files.to_binary(eps_dag).first().data)
    table = struct.pack("<ii", automata_files.SYMBOLS_MAGIC, 1) + b"t" + struct.pack("<qqi", 2, 1, 1) + b"a" + struct.pack("<q", 1)
    head = len(b"vector") + len(b"log") + 12
    with_table = good[: head + 4] + struct.pack("<i", 1) + good[head + 8 : head + 40] + table + good[head + 40 :]
    files = spark.createDataFrame([(1, good), (2, with_table), (3, good[:40]), (4, b"none"), (5, b""), (6, good[:-3])], "lattice_id long, data binary")
    made = automata_files.parse_binary(files)
    assert {r.lattice_id for r in made.meta.collect()} == {3, 4, 5, 6}
    for i in (1, 2):
        assert [(p[:2], round(p[2], 5)) for p in one(i)] == [(p[:2], round(p[2], 5)) for p in all_paths(eps_dag)]
    arcs, states = automata_files.line_frames(text_lattices.arc_lines(eps_dag))
    assert abs(frames.Levelled(arcs, states).mass().first().mass - distance.mass(eps_dag).first().mass) < 1e-9


def test_posteriors_by_input_labels(spark):
    """A transducer whose input label 1 has two outputs: an arc of the automaton stands for both by input labels."""
    base = build(spark, [(0, 1, 1, 7, 0.25), (0, 1, 1, 8, 0.25), (0, 1, 2, 7, 0.5)], 1)
    shape = build(spark, [(0, 1, 1, 7, 1.0), (0, 1, 2, 7, 1.0)], 1)
    weights = lambda match: {(r.ilabel, r.olabel): round(math.exp(-r.weight), 6) for r in automata.posteriors_over(base, shape, match).arcs.collect()}
    assert weights("pairs") == {(1, 7): 0.333333, (2, 7): 0.666667}
    assert weights("input") == {(1, 7): 0.5, (2, 7): 0.5}


def all_paths(lattices):
    """(input labels, output labels) without epsilons -> cost of each path, of the first lattice."""
    row = lattices.rows.first()
    out, todo = [], [(row.start, 0.0, (), ())] if row and row.start is not None else []
    while todo:
        s, w, i, o = todo.pop()
        if row.finals[s] < math.inf:
            out.append((i, o, w + row.finals[s]))
        for a in row.arcs:
            if a.src == s:
                todo.append((a.dst, w + a.weight, i + (a.ilabel,) * (a.ilabel != 0), o + (a.olabel,) * (a.olabel != 0)))
    return sorted(out)


def same_paths(found, want):
    return [p[:2] for p in found] == [p[:2] for p in want] and all(abs(p[2] - q[2]) < 1e-9 for p, q in zip(found, want, strict=True))


def composed_by_hand(left, right):
    """Pairs of paths whose labels in the middle are equal."""
    return sorted((i, o, w + v) for i, x, w in left for y, o, v in right if x == y)


def test_composition(spark, monkeypatch):
    """Epsilons on both sides, at the ends and in a row: each pair of paths once; a machine of its own for each lattice."""
    left = build(spark, [(0, 1, 1, 5, 0.5), (0, 1, 2, 0, 0.5), (1, 2, 3, 0, 0.4), (1, 2, 4, 6, 0.6), (2, 3, 5, 5, 0.7), (2, 3, 0, 0, 0.3)], 3)
    right = build(spark, [(0, 1, 0, 8, 0.9), (0, 1, 5, 7, 0.8), (1, 2, 6, 0, 0.7), (1, 2, 0, 9, 0.6), (2, 3, 5, 1, 0.5), (2, 3, 0, 0, 0.4), (0, 2, 5, 4, 0.3)], 3)
    want = composed_by_hand(all_paths(left), all_paths(right))
    made = composition.compose(left, composition.Automaton.like(right))
    assert want and same_paths(all_paths(made), want)
    arcs = right.arcs.select("src", "dst", "ilabel", "olabel", "weight")
    shared = composition.Automaton(arcs, right.states.drop("lattice_id"))
    assert same_paths(all_paths(composition.compose(left, shared)), want)
    monkeypatch.setattr(composition, "FEW_ARCS", 0)
    assert same_paths(all_paths(composition.compose(left, shared)), want)
    none = composition.Automaton(arcs.filter("ilabel = 77"), right.states.drop("lattice_id"))
    assert paths.summary(composition.compose(left, none)).count() == 0


def test_composition_with_cycles_and_sigma(spark, eps_dag):
    """Sigma counts labels as set_length does, in a loop of two states: an even number of labels."""
    arcs = spark.createDataFrame([(0, 1, -2, -2, 0.0), (1, 0, -2, -2, 0.0)], "src int, dst int, ilabel int, olabel int, weight double")
    states = spark.createDataFrame([(0, 0.0, True), (1, math.inf, False)], "state int, final double, is_start boolean")
    made = composition.compose(eps_dag, composition.Automaton(arcs, states))
    assert same_paths(all_paths(made), [p for p in all_paths(eps_dag) if len(p[1]) % 2 == 0])
    silent = spark.createDataFrame([(0, 1, 0, 1, 0.0), (1, 0, 0, 1, 0.0)], "src int, dst int, ilabel int, olabel int, weight double")
    with pytest.raises(ValueError):
        composition.compose(eps_dag, composition.Automaton(silent, states))


def test_prefix_taken_on(spark, eps_dag):
    prefixes = lambda *p: spark.createDataFrame([(1, list(p))], "lattice_id long, prefix array<int>")
    shown = lambda df: sorted((r.word, round(r.cost, 6), round(r.weight, 6), tuple(r.features)) for r in df.collect())
    typed = edit_distance.trellis(eps_dag, prefixes(1, 3))
    for new in ((1,), (1, 2), (2,), (), (1, 3), (1, 3, 3)):
        made = edit_distance.set_prefix(typed, prefixes(*new))
        assert made.select(F.size("trellis")).first()[0] == len(new) + 1
        assert shown(edit_distance.trellis_features(made)) == shown(edit_distance.edit_distance_features(eps_dag, prefixes(*new)))


def test_batch_of_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"l{i}.lat").write_text(HTK)
    (tmp_path / "names").write_text("some/l1.lat\nl0.lat\n")
    (tmp_path / "refs").write_text("Crocodile\nHello\n")
    made, refs, counts = labelling.load_batch(spark, str(tmp_path / "*.lat"), str(tmp_path / "names"), str(tmp_path / "refs"), scale=2.0, threshold=1.0, normalized=True)
    words = {(r.lattice_id, r.label): r.symbol for r in made.symbols.collect()}
    sources = {r.lattice_id: r.source.rsplit("/", 1)[1] for r in made.meta.collect()}
    assert {sources[r.lattice_id]: [words[r.lattice_id, x] for x in r.ref] for r in refs.collect()} == {"l0.lat": ["Hello"], "l1.lat": ["Crocodile"]}
    assert {(r.paths, r.left) for r in counts.collect()} == {(2.0, 1.0)}
