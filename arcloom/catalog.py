"""The registered queries of the lattice operators and their SQL counterparts.

A query applies its operator to the lattices of all orders; the SQL enumerates
whole paths instead, so the two share no algorithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions import semiring
from arcloom.functions.text import tokenize
from arcloom.lattice import with_fields
from arcloom.operators import automata, composition, confusion, distance, edit_distance, filters, frames, labelling, normalise, paths, structure
from arcloom.session import ship
from arcloom.sources import automata_files, derive, text_lattices

DIGITS = 6
#: for shares of whole quantities, of which some end in 5 at the seventh digit
SHARE_DIGITS = 9
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_ARCS = """
slots AS (SELECT l_orderkey AS lattice_id, l_linenumber, CAST(l_partkey % 50 + 1 AS INT) AS label, sum(l_quantity) AS q
          FROM lineitem GROUP BY 1, 2, 3),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY lattice_id ORDER BY l_linenumber) AS pos,
                  sum(q) OVER (PARTITION BY lattice_id, l_linenumber) AS total FROM slots),
ended AS (SELECT *, max(pos) OVER (PARTITION BY lattice_id) AS last FROM placed),
plain AS (SELECT lattice_id, pos - 1 AS src, pos AS dst, pos AS ilabel, label AS olabel, -ln(q / (1.25 * total)) AS weight FROM ended),
skips AS (SELECT lattice_id, pos - 1 AS src, pos + 1 AS dst, pos AS ilabel, label AS olabel, -ln(0.2 * q / total) AS weight
          FROM ended WHERE pos < last),
"""
_NUMBERED = """
arcs AS (SELECT *, row_number() OVER (PARTITION BY lattice_id ORDER BY src, dst, ilabel, olabel) - 1 AS arc_id FROM raw),
fin AS (SELECT lattice_id, max(dst) AS state FROM arcs GROUP BY 1),
steps(lattice_id, state, w, ids) AS (
  SELECT lattice_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST([] AS BIGINT[]) FROM fin
  UNION ALL
  SELECT s.lattice_id, a.dst, s.w + a.weight, list_append(s.ids, a.arc_id)
  FROM steps s JOIN arcs a ON a.lattice_id = s.lattice_id AND a.src = s.state),
paths AS (SELECT s.* FROM steps s JOIN fin USING (lattice_id, state)),
mass AS (SELECT lattice_id, sum(exp(-w)) AS m, max(exp(-w)) AS best, count(*) AS n FROM paths GROUP BY 1),
used AS (SELECT lattice_id, w, ids, unnest(ids) AS arc_id FROM paths),
post AS (SELECT a.lattice_id, a.arc_id, a.src, a.dst, a.ilabel, a.olabel, a.weight, sum(exp(-u.w)) AS through, max(exp(-u.w)) AS best_through
         FROM used u JOIN arcs a USING (lattice_id, arc_id) GROUP BY ALL),
tails(lattice_id, state, head, w) AS (
  SELECT lattice_id, state, state, CAST(0 AS DOUBLE) FROM fin
  UNION ALL
  SELECT t.lattice_id, a.src, t.head, t.w + a.weight FROM tails t JOIN arcs a ON a.lattice_id = t.lattice_id AND a.dst = t.state),
alpha AS (SELECT lattice_id, state, sum(exp(-w)) AS a FROM steps GROUP BY 1, 2),
beta AS (SELECT lattice_id, state, sum(exp(-w)) AS b FROM tails GROUP BY 1, 2)
"""
LATTICE = "WITH RECURSIVE" + _ARCS + "raw AS (SELECT * FROM plain UNION ALL SELECT * FROM skips)," + _NUMBERED
SAUSAGE = "WITH RECURSIVE" + _ARCS + "raw AS (SELECT * FROM plain)," + _NUMBERED
_EPS = "CASE WHEN olabel % 5 = 0 THEN 0 ELSE {} END AS {}"
#: the lattice with every fifth label an epsilon
EPSILONS = (
    "WITH RECURSIVE"
    + _ARCS
    + f"raw AS (SELECT lattice_id, src, dst, {_EPS.format('ilabel', 'ilabel')}, {_EPS.format('olabel', 'olabel')}, weight FROM (SELECT * FROM plain UNION ALL SELECT * FROM skips)),"
    + _NUMBERED
)
#: the sausage normalised, and per position its entropy and largest probability
SLOTS = (
    "WITH" + _ARCS.rstrip().rstrip(",")
    + """,
norm AS (SELECT lattice_id, ilabel, olabel, exp(-weight) * 1.25 AS p FROM plain),
pos AS (SELECT lattice_id, ilabel, sum(p * ln(p)) AS h, max(p) AS best FROM norm GROUP BY 1, 2),
around AS (SELECT *, coalesce(sum(h) OVER w, 0) - h AS h_before, sum(h) OVER (PARTITION BY lattice_id) AS h_all,
                  sum(ln(best)) OVER (PARTITION BY lattice_id) AS l_all, sum(best) OVER (PARTITION BY lattice_id) AS b_all
           FROM pos WINDOW w AS (PARTITION BY lattice_id ORDER BY ilabel))
"""
)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r(value: str, digits: int = DIGITS) -> str:
    """Rounded alike in both engines, without a negative zero."""
    return f"round({value}, {digits}) + 0.0"


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def lattice(spark: SparkSession, sf_dir: str):
    return derive.order_lattice(spark, sf_dir)


def sausage(spark: SparkSession, sf_dir: str):
    return derive.order_sausage(spark, sf_dir)


def epsilons(spark: SparkSession, sf_dir: str):
    silent = lambda a, name: F.when(a["olabel"] % 5 == 0, F.lit(0)).otherwise(a[name])
    return lattice(spark, sf_dir).map_arcs(lambda a: with_fields(a, ilabel=silent(a, "ilabel"), olabel=silent(a, "olabel")))


@query(
    "d1_forward_backward",
    LATTICE + f"SELECT lattice_id, CAST(state AS INT) AS state, {r('-ln(a)')} AS alpha, {r('-ln(b)')} AS beta FROM alpha JOIN beta USING (lattice_id, state)",
)
def d1(spark, d):
    return rounded(distance.distances(lattice(spark, d)), "alpha", "beta")


@query("d2_mass", LATTICE + f"SELECT lattice_id, {r('-ln(m)')} AS mass FROM mass")
def d2(spark, d):
    return rounded(distance.mass(lattice(spark, d)), "mass")


@query("d3_tropical_distance", LATTICE + f"SELECT lattice_id, {r('-ln(best)')} AS mass FROM mass")
def d3(spark, d):
    return rounded(distance.mass(lattice(spark, d), "tropical"), "mass")


@query("d4_shortest_path", LATTICE + f"SELECT lattice_id, {r('ln(best)')} AS logprob FROM mass")
def d4(spark, d):
    return rounded(paths.shortest_path(lattice(spark, d)).select("lattice_id", "logprob"), "logprob")


@query(
    "d6_k_best",
    LATTICE
    + f"SELECT lattice_id, CAST(row_number() OVER (PARTITION BY lattice_id ORDER BY w) AS INT) AS rank, {r('w')} AS cost FROM paths QUALIFY rank <= 4",
)
def d6(spark, d):
    return rounded(paths.k_best(lattice(spark, d), 4).select("lattice_id", "rank", "cost"), "cost")


def _shown_paths(found: DataFrame, first: int) -> DataFrame:
    """Ranks to ``first`` with hyp and each score times its place; a path as cheap as a neighbour shows neither, as
    engines may order the two differently."""
    by_rank = Window.partitionBy("lattice_id").orderBy("rank")
    alone = F.coalesce(F.col("cost") - F.lag("cost").over(by_rank) > 1e-7, F.lit(True)) & F.coalesce(F.lead("cost").over(by_rank) - F.col("cost") > 1e-7, F.lit(True))
    places = F.aggregate(F.transform("scores", lambda s, i: s * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    shown = found.withColumn("alone", alone).filter(F.col("rank") <= first)
    hyp = F.when(F.col("alone"), F.array_join(F.transform("hyp", lambda x: x.cast("string")), " ")).otherwise("")
    return rounded(shown.select("lattice_id", "rank", "cost", hyp.alias("hyp"), F.when(F.col("alone"), places).otherwise(0.0).alias("places")), "cost", "places")


_SHOWN = """, label AS (SELECT p.lattice_id, p.ids, p.w, {hyp} AS hyp, sum(a.weight * list_position(p.ids, a.arc_id)) AS places
  FROM paths p JOIN arcs a ON a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) GROUP BY p.lattice_id, p.ids, p.w),
best AS (SELECT * FROM label {unique}),
around AS (SELECT *, row_number() OVER by_cost AS rank, coalesce(w - lag(w) OVER by_cost > 1e-7, true) AND coalesce(lead(w) OVER by_cost - w > 1e-7, true) AS alone
  FROM best WINDOW by_cost AS (PARTITION BY lattice_id ORDER BY w, ids))
SELECT lattice_id, CAST(rank AS INT) AS rank, {w} AS cost, CASE WHEN alone THEN hyp ELSE '' END AS hyp, {places} AS places FROM around WHERE rank <= {first}"""
_HYP = "string_agg(a.olabel::VARCHAR, ' ' ORDER BY list_position(p.ids, a.arc_id))"


def _shown_sql(first: int, unique: str = "") -> str:
    return LATTICE + _SHOWN.format(hyp=_HYP, unique=unique, w=r("w"), places=r("CASE WHEN alone THEN places ELSE 0 END"), first=first)


@query("d4_shortest_path_labels", _shown_sql(1))
def d4_labels(spark, d):
    """Labels and scores of the best path, where the second is not as cheap."""
    return _shown_paths(paths.k_best(lattice(spark, d), 2), 1)


@query("d6_k_best_paths", _shown_sql(4))
def d6_paths(spark, d):
    return _shown_paths(paths.k_best(lattice(spark, d), 5), 4)


@query("d6_k_best_unique", "SELECT lattice_id, rank, cost, hyp FROM (" + _shown_sql(4, "QUALIFY row_number() OVER (PARTITION BY lattice_id, hyp ORDER BY w, ids) = 1") + ")")
def d6_unique(spark, d):
    """Of paths with the same labels, by skips or without, the best only; two of these may be as cheap, with other scores."""
    return _shown_paths(paths.k_best(lattice(spark, d), 5, unique=True), 4).drop("places")


@query("d7_path_count", LATTICE + "SELECT lattice_id, CAST(n AS DOUBLE) AS paths FROM mass")
def d7(spark, d):
    return paths.path_count(lattice(spark, d))


@query(
    "d8_position_posteriors",
    SAUSAGE + f"SELECT lattice_id, CAST(src AS INT) AS position, olabel, {r('sum(through) / any_value(m)', SHARE_DIGITS)} AS p FROM post JOIN mass USING (lattice_id) GROUP BY 1, 2, 3",
)
def d8(spark, d):
    return rounded(paths.position_posteriors(sausage(spark, d)), "p", digits=SHARE_DIGITS)


@query("d9_shortest_hamming_path", SLOTS + f""", pick AS (SELECT lattice_id, ilabel, min(olabel) AS label FROM norm JOIN pos USING (lattice_id, ilabel) WHERE p >= best - 1e-9 GROUP BY 1, 2),
words AS (SELECT lattice_id, string_agg(CAST(label AS VARCHAR), ' ' ORDER BY ilabel) AS hyp FROM pick GROUP BY 1)
SELECT lattice_id, hyp, count(*) AS length, {r('sum(best)', SHARE_DIGITS)} AS expected_correct FROM pos JOIN words USING (lattice_id) GROUP BY 1, 2""")
def d9(spark, d):
    found = paths.shortest_hamming_path(sausage(spark, d))
    words = F.array_join(F.transform("hyp", lambda x: x.cast("string")), " ")
    return rounded(found.select("lattice_id", words.alias("hyp"), F.size("hyp").cast("long").alias("length"), "expected_correct"), "expected_correct", digits=SHARE_DIGITS)


@query(
    "i3_position_probabilities",
    LATTICE + f"SELECT lattice_id, CAST(ilabel AS INT) AS ilabel, olabel, {r('sum(through) / any_value(m)', SHARE_DIGITS)} AS p FROM post JOIN mass USING (lattice_id) GROUP BY 1, 2, 3",
)
def i3(spark, d):
    return rounded(paths.position_probabilities(lattice(spark, d)), "p", digits=SHARE_DIGITS)


_ARC = "lattice_id, arc_id, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, CAST(ilabel AS INT) AS ilabel, olabel"
ARC_COLUMNS = ("lattice_id", "arc_id", "src", "dst", "ilabel", "olabel", "weight")


def _arcs(lattices) -> DataFrame:
    return rounded(lattices.arcs.select(*ARC_COLUMNS), "weight")


@query("n1_normalize", LATTICE + f"""SELECT {_ARC}, {r('weight - ln(t.b) + ln(h.b)')} AS weight FROM arcs a
JOIN (SELECT lattice_id, state AS src, b FROM beta) h USING (lattice_id, src) JOIN (SELECT lattice_id, state AS dst, b FROM beta) t USING (lattice_id, dst)""")
def n1(spark, d):
    return _arcs(normalise.normalize(lattice(spark, d)))


@query("n2_normalize_posteriors", LATTICE + f"SELECT {_ARC}, {r('-ln(through / m)')} AS weight FROM post JOIN mass USING (lattice_id)")
def n2(spark, d):
    return _arcs(normalise.normalize_posteriors(lattice(spark, d))[0])


@query("n3_arc_posteriors", LATTICE + f"SELECT {_ARC}, {r('-ln(through)')} AS weight FROM post")
def n3(spark, d):
    return rounded(normalise.arc_posteriors(lattice(spark, d)), "weight")


@query("n7_verify_probabilistic", LATTICE + """, outs AS (SELECT lattice_id, src, sum(exp(-weight)) AS t FROM arcs GROUP BY 1, 2)
SELECT lattice_id, bool_and(abs(t - 1) <= 1e-6) AS ok FROM outs GROUP BY 1""")
def n7(spark, d):
    return normalise.is_probabilistic(lattice(spark, d))


@query("n8_num_states", LATTICE + "SELECT lattice_id, CAST(state + 1 AS INT) AS states FROM fin")
def n8(spark, d):
    return normalise.num_states(lattice(spark, d))


@query("n9_sum_suffixes", LATTICE + f"SELECT lattice_id, CAST(ilabel AS INT) AS ilabel, {r('-ln(sum(exp(-weight)) / any_value(m))')} AS weight FROM arcs JOIN mass USING (lattice_id) WHERE src = 0 GROUP BY 1, 2")
def n9(spark, d):
    return rounded(normalise.sum_suffixes(lattice(spark, d)), "weight")


@query("i2_entropy", LATTICE + f"""SELECT lattice_id, {r('sum(exp(-w) / m * ln(exp(-w) / m))')} AS neg_entropy, {r('-sum(exp(-w) / m * ln(exp(-w) / m))')} AS entropy
FROM paths JOIN mass USING (lattice_id) GROUP BY 1""")
def i2(spark, d):
    return rounded(normalise.entropy(normalise.normalize(lattice(spark, d))).drop("perplexity"), "neg_entropy", "entropy")


def _measure(name: str, value: str, digits: int = DIGITS):
    ilabel = "CAST(ilabel AS INT) AS ilabel"
    return query(name, SLOTS + f"SELECT lattice_id, {ilabel}, {r(value, digits)} AS value FROM around")


@query(
    "i4_conditional_entropy",
    SLOTS + f""", sq AS (SELECT lattice_id, ilabel, sum(p * p) AS p2, sum(p * p * ln(p)) AS p2l FROM norm GROUP BY 1, 2)
SELECT lattice_id, CAST(ilabel AS INT) AS ilabel, {r('h_before + p2l + p2 * (h_all - h_before - h)')} AS value FROM around JOIN sq USING (lattice_id, ilabel)""",
)
def i4(spark, d):
    return rounded(normalise.conditional_entropy(normalise.normalize(sausage(spark, d))), "value")


@query(
    "i5_mutual_information",
    SLOTS + f""", sq AS (SELECT lattice_id, ilabel, sum(p * p) AS p2, sum(p * p * ln(p)) AS p2l FROM norm GROUP BY 1, 2)
SELECT lattice_id, CAST(ilabel AS INT) AS ilabel, {r('h_before + p2l + p2 * (h_all - h_before - h) - h')} AS value FROM around JOIN sq USING (lattice_id, ilabel)""",
)
def i5(spark, d):
    return rounded(normalise.mutual_information(normalise.normalize(sausage(spark, d))), "value")


#: sums over prefixes of paths and the arcs that follow them, by the labels that either holds, of the normalised lattice
_GIVEN = LATTICE + """, norm AS (SELECT a.lattice_id, a.arc_id, a.src, exp(-a.weight) * t.b / h.b AS p FROM arcs a
  JOIN beta h ON h.lattice_id = a.lattice_id AND h.state = a.src JOIN beta t ON t.lattice_id = a.lattice_id AND t.state = a.dst),
pairs AS (SELECT s.lattice_id, list_append(s.ids, n.arc_id) AS ids, exp(-s.w) * b.b / m.m * n.p * ln(n.p) AS e
  FROM steps s JOIN beta b USING (lattice_id, state) JOIN mass m USING (lattice_id) JOIN norm n ON n.lattice_id = s.lattice_id AND n.src = s.state),
whole AS (SELECT lattice_id, sum(e) AS t FROM pairs GROUP BY 1),
held AS (SELECT lattice_id, e, unnest(ids) AS arc_id FROM pairs),
by_label AS (SELECT lattice_id, ilabel, olabel, sum(e) AS e FROM held JOIN arcs USING (lattice_id, arc_id) GROUP BY 1, 2, 3),
share AS (SELECT lattice_id, ilabel, olabel, sum(through) / any_value(m) AS p FROM post JOIN mass USING (lattice_id) GROUP BY 1, 2, 3),
given AS (SELECT *, t - sum(e) OVER (PARTITION BY lattice_id, ilabel) + e AS h FROM by_label JOIN share USING (lattice_id, ilabel, olabel) JOIN whole USING (lattice_id))
"""


@query("i4_conditional_entropy_with_skips", _GIVEN + f"SELECT lattice_id, CAST(ilabel AS INT) AS ilabel, {r('sum(p * h)')} AS value FROM given GROUP BY 1, 2")
def i4_skips(spark, d):
    return rounded(normalise.conditional_entropy(normalise.normalize(lattice(spark, d))), "value")


@query("i5_mutual_information_with_skips", _GIVEN + f"SELECT lattice_id, CAST(ilabel AS INT) AS ilabel, {r('sum(p * (h - ln(p)))')} AS value FROM given GROUP BY 1, 2")
def i5_skips(spark, d):
    return rounded(normalise.mutual_information(normalise.normalize(lattice(spark, d))), "value")


@_measure("i6_conditional_expected_accuracy", "b_all - best + 1", SHARE_DIGITS)
def i6(spark, d):
    return rounded(normalise.conditional_expected_accuracy(normalise.normalize(sausage(spark, d))), "value", digits=SHARE_DIGITS)


@_measure("i7_conditional_expected_shortest_path", "l_all - ln(best) + h")
def i7(spark, d):
    return rounded(normalise.conditional_expected_shortest_path(normalise.normalize(sausage(spark, d))), "value")


@_measure("i8_conditional_expected_num_changes", "1 - best", SHARE_DIGITS)
def i8(spark, d):
    return rounded(normalise.conditional_expected_num_changes(normalise.normalize(sausage(spark, d))), "value", digits=SHARE_DIGITS)


@query("f1_query_filter", LATTICE + f"""SELECT lattice_id, {r('-ln(sum(exp(-w)))')} AS mass FROM paths p
WHERE NOT EXISTS (SELECT 1 FROM arcs a WHERE a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) AND a.ilabel = 1 AND a.olabel % 2 = 1) GROUP BY 1""")
def f1(spark, d):
    kept = filters.rm_arc(lattice(spark, d), lambda a: (a["ilabel"] != 1) | (a["olabel"] % 2 != 1))
    return rounded(paths.summary(kept).select("lattice_id", "mass"), "mass")


@query("f8_prune_arcs", LATTICE + f""", lim AS (SELECT lattice_id, min(-ln(through)) + 1.0 AS t FROM post GROUP BY 1),
bad AS (SELECT lattice_id, arc_id FROM post JOIN lim USING (lattice_id) WHERE -ln(through) > t),
ok AS (SELECT p.* FROM paths p WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.lattice_id = p.lattice_id AND list_contains(p.ids, b.arc_id)))
SELECT lattice_id, count(*) AS n_paths, {r('-ln(sum(exp(-w)))')} AS mass FROM ok GROUP BY 1""")
def f8(spark, d):
    kept = paths.summary(filters.prune_arcs(lattice(spark, d), 1.0))
    return rounded(kept.select("lattice_id", F.col("paths").alias("n_paths"), "mass"), "mass")


@query("f9_prune_paths", LATTICE + f""", near AS (SELECT lattice_id, arc_id FROM post JOIN mass USING (lattice_id) WHERE -ln(best_through) <= -ln(best) + 1.5 + 1e-9),
counts AS (SELECT lattice_id, count(*) AS n_arcs FROM near GROUP BY 1),
left_paths AS (SELECT u.lattice_id, u.ids, any_value(u.w) AS w FROM used u LEFT JOIN near USING (lattice_id, arc_id) GROUP BY 1, 2 HAVING count(*) = count(near.arc_id))
SELECT lattice_id, n_arcs, count(*) AS n_paths, {r('-ln(sum(exp(-w)))')} AS mass FROM left_paths JOIN counts USING (lattice_id) GROUP BY 1, 2""")
def f9(spark, d):
    kept = paths.summary(filters.prune_paths(lattice(spark, d), 1.5))
    return rounded(kept.select("lattice_id", F.col("n_arcs").cast("long").alias("n_arcs"), F.col("paths").alias("n_paths"), "mass"), "mass")


@query("f11_set_length", LATTICE + f"SELECT lattice_id, count(*) AS n_paths, {r('-ln(sum(exp(-w)))')} AS mass FROM paths WHERE len(ids) = 3 GROUP BY 1")
def f11(spark, d):
    kept = paths.summary(filters.set_length(lattice(spark, d), 3))
    return rounded(kept.select("lattice_id", F.col("paths").alias("n_paths"), "mass"), "mass")


@query("f12_rm_prefix", SAUSAGE + f""", outs AS (SELECT lattice_id, src, count(*) AS n FROM arcs GROUP BY 1, 2),
lead AS (SELECT lattice_id, n = 1 AS ok FROM outs WHERE src = 0)
SELECT lattice_id, ok, CAST(state + 1 - CASE WHEN ok THEN 1 ELSE 0 END AS INT) AS states, {r('-ln(m)')} AS mass FROM lead JOIN fin USING (lattice_id) JOIN mass USING (lattice_id)""")
def f12(spark, d):
    cut, ok = filters.rm_prefix(sausage(spark, d), 1)
    return rounded(ok.join(normalise.num_states(cut), "lattice_id").join(distance.mass(cut), "lattice_id"), "mass")


@query("c1_mbr_table", LATTICE + f""", words AS (SELECT p.lattice_id, exp(-p.w) AS e, g.k AS position, list_extract(p.ids, g.k) AS arc_id
  FROM paths p, (SELECT unnest(range(1, 20)) AS k) g WHERE g.k <= len(p.ids)),
cells AS (SELECT w.lattice_id, w.position, CAST(a.ilabel AS INT) AS label, sum(e) AS s FROM words w JOIN arcs a USING (lattice_id, arc_id) GROUP BY 1, 2, 3
  UNION ALL SELECT lattice_id, len(ids) + 1, -1, sum(exp(-w)) FROM paths GROUP BY 1, 2)
SELECT lattice_id, CAST(position AS INT) AS position, label, {r('s / sum(s) OVER (PARTITION BY lattice_id, position)', SHARE_DIGITS)} AS p FROM cells""")
def c1(spark, d):
    return rounded(confusion.mbr_table(lattice(spark, d)), "p", digits=SHARE_DIGITS)


@query("c1_mbr_table_with_epsilons", EPSILONS + f""", spoken AS (SELECT p.lattice_id, p.ids, exp(-p.w) AS e, CAST(a.ilabel AS INT) AS label,
    row_number() OVER (PARTITION BY p.lattice_id, p.ids ORDER BY list_position(p.ids, a.arc_id)) AS position
  FROM paths p JOIN arcs a ON a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) WHERE a.ilabel <> 0),
spoken_n AS (SELECT lattice_id, ids, count(*) AS n FROM spoken GROUP BY 1, 2),
cells AS (SELECT lattice_id, position, label, sum(e) AS s FROM spoken GROUP BY 1, 2, 3
  UNION ALL SELECT p.lattice_id, coalesce(n, 0) + 1, -1, sum(exp(-p.w)) FROM paths p LEFT JOIN spoken_n s ON s.lattice_id = p.lattice_id AND s.ids = p.ids GROUP BY 1, 2)
SELECT lattice_id, CAST(position AS INT) AS position, label, {r('s / sum(s) OVER (PARTITION BY lattice_id, position)', SHARE_DIGITS)} AS p FROM cells""")
def c1_eps(spark, d):
    return rounded(confusion.mbr_table(epsilons(spark, d)), "p", digits=SHARE_DIGITS)


@query("f11_set_length_with_epsilons", EPSILONS + f""", spoken AS (SELECT p.lattice_id, p.ids, p.w, count(*) FILTER (WHERE a.olabel <> 0) AS n
  FROM paths p JOIN arcs a ON a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) GROUP BY ALL)
SELECT lattice_id, count(*) AS n_paths, {r('-ln(sum(exp(-w)))')} AS mass FROM spoken WHERE n = 2 GROUP BY 1""")
def f11_eps(spark, d):
    kept = paths.summary(filters.set_length(epsilons(spark, d), 2))
    return rounded(kept.select("lattice_id", F.col("paths").alias("n_paths"), "mass"), "mass")


@query("t4_rm_epsilon", EPSILONS + f"SELECT lattice_id, {r('-ln(m)')} AS mass, 0 AS n_epsilons FROM mass")
def t4(spark, d):
    made = automata.rm_epsilon(epsilons(spark, d))
    left = F.size(F.filter("arcs", lambda a: (a["ilabel"] == 0) & (a["olabel"] == 0)))
    return rounded(distance.mass(made).join(made.rows.select("lattice_id", left.alias("n_epsilons")), "lattice_id"), "mass")


@query(
    "t4_epsilon_arcs",
    EPSILONS
    + f""", silent(lattice_id, head, state, w) AS (SELECT lattice_id, src, dst, weight FROM arcs WHERE ilabel = 0 AND olabel = 0
  UNION ALL SELECT s.lattice_id, s.head, a.dst, s.w + a.weight FROM silent s JOIN arcs a ON a.lattice_id = s.lattice_id AND a.src = s.state AND a.ilabel = 0 AND a.olabel = 0),
loud AS (SELECT lattice_id, src, dst, ilabel, olabel, weight FROM arcs WHERE ilabel <> 0 OR olabel <> 0),
led AS (SELECT * FROM loud UNION ALL SELECT s.lattice_id, s.head, l.dst, l.ilabel, l.olabel, s.w + l.weight FROM silent s JOIN loud l ON l.lattice_id = s.lattice_id AND l.src = s.state)
SELECT lattice_id, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, CAST(ilabel AS INT) AS ilabel, CAST(olabel AS INT) AS olabel, {r('-ln(sum(exp(-weight)))')} AS weight
FROM led GROUP BY ALL""",
)
def t4_arcs(spark, d):
    """The arcs that take the place of epsilons, by doubling paths of epsilons."""
    base = epsilons(spark, d)
    return rounded(frames.rm_epsilon(base.arcs, base.states)[0], "weight")


#: of each beginning of a label sequence the set of its endings: a state of the minimal automaton for each set
_FUTURES = LATTICE + """, spelled AS (SELECT DISTINCT p.lattice_id, list(a.ilabel::VARCHAR || ':' || a.olabel ORDER BY list_position(p.ids, a.arc_id)) AS labels
  FROM paths p JOIN arcs a ON a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) GROUP BY p.lattice_id, p.ids),
splits AS (SELECT lattice_id, labels, unnest(range(0, len(labels) + 1)) AS k FROM spelled),
futures AS (SELECT lattice_id, array_to_string(labels[:k], ' ') AS lead, string_agg(DISTINCT array_to_string(labels[k + 1:], ' '), '|' ORDER BY array_to_string(labels[k + 1:], ' ')) AS ends
  FROM splits GROUP BY 1, 2)
SELECT lattice_id, count(DISTINCT ends) AS states FROM futures GROUP BY 1"""


@query("t5_minimal_states", _FUTURES)
def t5_states(spark, d):
    """States of the minimal automaton of each lattice's label sequences."""
    made = normalise.num_states(automata.determinize(normalise.remove_weights(lattice(spark, d))))
    return made.select("lattice_id", F.col("states").cast("long").alias("states"))


@query("t5_minimal_states_by_level", _FUTURES)
def t5_levels(spark, d):
    """The same, minimised level by level as frames."""
    made = normalise.remove_weights(automata.determinize(normalise.remove_weights(lattice(spark, d)), minimal=False))
    return frames.minimize(made.arcs, made.states)[1].groupBy("lattice_id").agg(F.count("*").alias("states"))


@query("k2_frame_distances", LATTICE + f"SELECT lattice_id, CAST(state AS INT) AS state, {r('-ln(a)')} AS alpha FROM alpha")
def k2(spark, d):
    """Forward distances of lattices given as frames, by the kernel that suits their sizes."""
    base = lattice(spark, d)
    return rounded(distance.frame_distances(base.arcs, base.states), "alpha")


def _levelled(spark, d) -> frames.Levelled:
    base = lattice(spark, d)
    return frames.Levelled(base.arcs, base.states)


@query("d1_frames_forward_backward", ORACLES["d1_forward_backward"])
def d1_frames(spark, d):
    """Both distances of lattices given as frames, level by level."""
    return rounded(_levelled(spark, d).distances(), "alpha", "beta")


@query("n1_frames_normalize", ORACLES["n1_normalize"])
def n1_frames(spark, d):
    return rounded(_levelled(spark, d).normalize()[0].select(*ARC_COLUMNS), "weight")


@query("n2_frames_posteriors", ORACLES["n2_normalize_posteriors"])
def n2_frames(spark, d):
    return rounded(_levelled(spark, d).posteriors().select(*ARC_COLUMNS), "weight")


@query("c2_confusion_network", LATTICE + f""", words AS (SELECT p.lattice_id, exp(-p.w) AS e, g.k AS position, list_extract(p.ids, g.k) AS arc_id
  FROM paths p, (SELECT unnest(range(1, 20)) AS k) g WHERE g.k <= len(p.ids)),
cells AS (SELECT w.lattice_id, w.position, CAST(a.ilabel AS INT) AS label, sum(e) AS s FROM words w JOIN arcs a USING (lattice_id, arc_id) GROUP BY 1, 2, 3
  UNION ALL SELECT lattice_id, len(ids) + 1, -1, sum(exp(-w)) FROM paths GROUP BY 1, 2),
shares AS (SELECT *, s / sum(s) OVER (PARTITION BY lattice_id, position) AS p, max(position) OVER (PARTITION BY lattice_id) AS last FROM cells)
SELECT lattice_id, CAST(position - 1 AS INT) AS src, CAST(position AS INT) AS dst, label, CAST(last AS INT) AS states, {r('-ln(p)')} AS weight FROM shares WHERE label <> -1""")
def c2(spark, d):
    made = confusion.confusion_network(lattice(spark, d)).rows
    each = made.select("lattice_id", F.size("finals").alias("states"), F.inline_outer("arcs")).filter("dst is not null")
    return rounded(each.select("lattice_id", "src", "dst", F.col("ilabel").alias("label"), "states", "weight"), "weight")


def _named(lattices):
    """Labels as symbols: w<label>_<label mod 3>."""
    from dataclasses import replace

    labels = lattices.arcs.select("lattice_id", F.col("olabel").alias("label")).distinct()
    word = F.concat(F.lit("w"), F.col("label").cast("string"), F.lit("_"), (F.col("label") % 3).cast("string"))
    symbols = labels.select("lattice_id", F.lit("i").alias("side"), "label", word.alias("symbol"))
    swapped = lattices.map_arcs(lambda a: with_fields(a, ilabel=a["olabel"]))
    return replace(swapped, symbols=symbols)


_READ_BACK = f"SELECT lattice_id, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, 'w' || olabel || '_' || (olabel % 3) AS word, {r('weight')} AS weight FROM arcs"


def _read_back(parsed) -> DataFrame:
    words = parsed.symbols.filter("side = 'i'").select("lattice_id", F.col("label").alias("ilabel"), F.col("symbol").alias("word"))
    found = parsed.arcs.join(words, ["lattice_id", "ilabel"])
    return rounded(found.select("lattice_id", "src", "dst", "word", "weight"), "weight")


@query("s1_o1_htk_round_trip", LATTICE + _READ_BACK)
def s1(spark, d):
    """Printed as lattice files and read again."""
    return _read_back(text_lattices.parse_htk(text_lattices.to_htk_text(_named(lattice(spark, d)))))


@query("s5_o2_thot_round_trip", LATTICE + _READ_BACK)
def s5(spark, d):
    return _read_back(text_lattices.parse_thot(text_lattices.to_thot_text(_named(lattice(spark, d)))))


@query("s8_o4_binary_round_trip", LATTICE + f"SELECT {_ARC}, {r('weight::FLOAT::DOUBLE')} AS weight FROM arcs")
def s8_binary(spark, d):
    """Written as binary files and decoded; costs of single precision."""
    return _arcs(automata_files.parse_binary(automata_files.to_binary(lattice(spark, d))))


@query("s8_arc_lines_round_trip", LATTICE + f"SELECT lattice_id, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, CAST(ilabel AS INT) AS ilabel, olabel, {r('weight')} AS weight FROM arcs")
def s8_lines(spark, d):
    """Written as lines and read from them, each line by itself."""
    arcs, _ = automata_files.line_frames(text_lattices.arc_lines(lattice(spark, d)))
    return rounded(arcs, "weight")


@query("t1_split_symbols", LATTICE + f"""SELECT lattice_id, m.n AS paths, {r('-ln(m.m)')} AS mass, count(*) FILTER (WHERE true) AS n_arcs FROM (
  SELECT lattice_id, src, olabel, 0 AS k, -1 AS dst FROM arcs GROUP BY ALL UNION ALL SELECT lattice_id, src, olabel, 1 AS k, dst FROM arcs) JOIN mass m USING (lattice_id) GROUP BY ALL""")
def t1(spark, d):
    made = paths.summary(structure.split_symbols(_named(lattice(spark, d))))
    return rounded(made.select("lattice_id", "paths", "mass", F.col("n_arcs").cast("long").alias("n_arcs")), "mass")


@query("t2_reverse", LATTICE + f"SELECT lattice_id, n AS paths, {r('-ln(m)')} AS mass, CAST(state + 2 AS INT) AS states FROM mass JOIN fin USING (lattice_id)")
def t2(spark, d):
    return rounded(paths.summary(structure.reverse(lattice(spark, d))).drop("n_arcs"), "mass")


@query("t7_decode_encode", LATTICE + "SELECT lattice_id, string_agg('w' || olabel || '_' || (olabel % 3), ' ' ORDER BY arc_id) AS text FROM arcs GROUP BY 1")
def t7(spark, d):
    """Labels of all arcs to words, words to labels and back again."""
    named = _named(lattice(spark, d))
    by_id = F.sort_array(F.transform("arcs", lambda a: F.struct(a["arc_id"].alias("arc_id"), a["ilabel"].alias("label"))))
    texts = structure.decode_symbols(named.rows.select("lattice_id", F.transform(by_id, lambda a: a["label"]).alias("labels")), named.symbols)
    return structure.decode_symbols(structure.encode_symbols(texts, named.symbols), named.symbols)


@query(
    "t9_output_symbols_by_depth",
    LATTICE
    + """, uneven AS (SELECT lattice_id, min(len(ids)) <> max(len(ids)) OR max(len(ids)) > 1 AS bad FROM paths GROUP BY 1)
SELECT lattice_id, CAST(a.src AS INT) AS position, count(DISTINCT olabel) AS n, sum(DISTINCT olabel)::DOUBLE AS total FROM arcs a JOIN uneven USING (lattice_id) WHERE NOT bad GROUP BY 1, 2
UNION ALL SELECT lattice_id, -1, 0, 0.0 FROM uneven WHERE bad""",
)
def t9(spark, d):
    """Paths of order lattices are equally long only where no arc skips a position."""
    found = structure.output_symbols_by_depth(lattice(spark, d))
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda t, x: t + x)
    return found.select("lattice_id", "position", F.size("labels").cast("long").alias("n"), total.cast("double").alias("total"))


@query("t8_output_symbols", LATTICE + "SELECT lattice_id, CAST(ilabel - 1 AS INT) AS position, count(DISTINCT olabel) AS n, sum(DISTINCT olabel) AS total FROM arcs GROUP BY 1, 2")
def t8(spark, d):
    found = structure.output_symbols(lattice(spark, d))
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda t, x: t + x)
    return found.select("lattice_id", "position", F.size("labels").cast("long").alias("n"), total.cast("double").alias("total"))


@query("t10_sequence_length", LATTICE + "SELECT lattice_id, CAST(CASE WHEN min(len(ids)) = max(len(ids)) AND max(len(ids)) < 2 THEN min(len(ids)) ELSE -1 END AS INT) AS length FROM paths GROUP BY 1")
def t10(spark, d):
    return paths.sequence_length(lattice(spark, d))


@query("o3_add_start_end", LATTICE + f"SELECT lattice_id, n AS paths, {r('-ln(m)')} AS mass, CAST(state + 3 AS INT) AS states FROM mass JOIN fin USING (lattice_id)")
def o3(spark, d):
    return rounded(paths.summary(structure.add_start_end(lattice(spark, d), 98, 99)).drop("n_arcs"), "mass")


def _plain_arcs(lattices) -> DataFrame:
    return rounded(lattices.arcs.select("lattice_id", "src", "dst", "ilabel", "olabel", "weight"), "weight")


_INTS = "CAST({} AS INT) AS {}"
_ENDS = "lattice_id, " + _INTS.format("{src}", "src") + ", " + _INTS.format("{dst}", "dst")
_LABELS = _INTS.format("ilabel", "ilabel") + f", olabel, {r('weight')} AS weight"


@query(
    "o3_add_start_end_arcs",
    LATTICE
    + f"SELECT {_ENDS.format(src='src + 1', dst='dst + 1')}, {_LABELS} FROM arcs UNION ALL SELECT lattice_id, 0, 1, 98, 98, 0.0 FROM fin"
    + f" UNION ALL SELECT {_ENDS.format(src='state + 1', dst='state + 2')}, 99, 99, 0.0 FROM fin",
)
def o3_arcs(spark, d):
    return _plain_arcs(structure.add_start_end(lattice(spark, d), 98, 99))


@query(
    "t2_reverse_arcs",
    LATTICE
    + f"SELECT {_ENDS.format(src='state + 1 - dst', dst='state + 1 - src')}, {_LABELS} FROM arcs JOIN fin USING (lattice_id) UNION ALL SELECT lattice_id, 0, 1, 0, 0, 0.0 FROM fin",
)
def t2_arcs(spark, d):
    return _plain_arcs(structure.reverse(lattice(spark, d)))


@query(
    "t9_output_symbols_by_depth_even",
    SAUSAGE + "SELECT lattice_id, CAST(src AS INT) AS position, count(DISTINCT olabel) AS n, sum(DISTINCT olabel)::DOUBLE AS total FROM arcs GROUP BY 1, 2",
)
def t9_even(spark, d):
    """Of lattices whose paths are equally long."""
    found = structure.output_symbols_by_depth(sausage(spark, d))
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda t, x: t + x)
    return found.select("lattice_id", "position", F.size("labels").cast("long").alias("n"), total.cast("double").alias("total"))


@query("t10_sequence_length_even", SAUSAGE + "SELECT lattice_id, CAST(state AS INT) AS length FROM fin")
def t10_even(spark, d):
    return paths.sequence_length(sausage(spark, d))


@query("f3_constraints", LATTICE + f""", want AS (SELECT lattice_id, max(olabel) AS m FROM arcs WHERE src = 0 GROUP BY 1)
SELECT p.lattice_id, count(*) AS paths, {r('-ln(sum(exp(-w)))')} AS mass FROM paths p JOIN want USING (lattice_id)
WHERE NOT EXISTS (SELECT 1 FROM arcs a WHERE a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) AND a.ilabel = 1 AND a.olabel <> want.m)
AND NOT EXISTS (SELECT 1 FROM arcs a WHERE a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) AND a.ilabel = 2 AND a.olabel IN (7, 8, 9)) GROUP BY 1""")
def f3(spark, d):
    base = lattice(spark, d)
    first = base.arcs.filter("src = 0").groupBy("lattice_id").agg(F.max("olabel").alias("match"))
    none = F.array().cast("array<int>")
    wanted = first.select("lattice_id", F.lit(0).alias("position"), "match", none.alias("exclude")).union(
        first.select("lattice_id", F.lit(1), F.lit(None).cast("int"), F.array(F.lit(7), F.lit(8), F.lit(9)))
    )
    kept = filters.rm_arc(filters.with_constraints(base, wanted), filters.constrained())
    return rounded(paths.summary(kept).select("lattice_id", "paths", "mass"), "mass")


@query("w11_power_scale", LATTICE + f"SELECT lattice_id, {r('-ln(sum(exp(-0.5 * w)))')} AS mass FROM paths GROUP BY 1")
def w11(spark, d):
    return rounded(distance.mass(normalise.scale_weights(lattice(spark, d), 0.5)), "mass")


@query("u1_tokenize", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ ,.]+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL")
def u1(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    return docs.select("doc_id", F.size(tokenize(F.col("text"), " ,.")).cast("long").alias("n"))


#: DuckDB's levenshtein counts bytes, so letters beyond ASCII are first given control characters that no text has
_D11 = """WITH turns AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL),
letters AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS beyond, count(*) AS n FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM turns) WHERE c > '~'),
spare AS (SELECT string_agg(chr(CAST(k AS INT)), '' ORDER BY k) AS marks FROM (SELECT unnest(list_concat(range(1, 9), range(14, 32))) AS k)),
s AS (SELECT conv_id, turn, text AS whole, translate(text, beyond, marks) AS text FROM turns, letters, spare),
t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, whole) AS next FROM s)
SELECT conv_id, turn, levenshtein(text, next) AS distance FROM t WHERE next IS NOT NULL"""


@query("d11_edit_distance", _D11)
def d11(spark, d):
    """Between the whole texts of a turn and the next one, in characters."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").filter("text is not null")
    turns = turns.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).filter("next is not null")
    return turns.select("conv_id", "turn", F.levenshtein("text", "next").cast("long").alias("distance"))


@query("n4_determinize_weights_normalize", LATTICE + f""", words AS (SELECT p.lattice_id, p.w, string_agg(a.ilabel || ':' || a.olabel, ' ' ORDER BY a.arc_id) AS label
  FROM paths p JOIN arcs a ON a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) GROUP BY p.lattice_id, p.w, p.ids),
one AS (SELECT lattice_id, label, sum(exp(-w)) AS e FROM words GROUP BY 1, 2)
SELECT lattice_id, count(*) AS paths, {r('0.0')} AS mass, {r('max(e) / sum(e)')} AS best FROM one GROUP BY 1""")
def n4(spark, d):
    made = automata.determinize_weights_and_normalize(lattice(spark, d))
    best = paths.shortest_path(made, include_final=True).select("lattice_id", F.exp("logprob").alias("best"))
    return rounded(paths.summary(made).select("lattice_id", "paths", "mass").join(best, "lattice_id"), "mass", "best")


@query("n6_determinize_normalize", LATTICE + """, words AS (SELECT DISTINCT p.lattice_id, string_agg(a.ilabel || ':' || a.olabel, ' ' ORDER BY a.arc_id) AS label
  FROM paths p JOIN arcs a ON a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) GROUP BY p.lattice_id, p.ids)
SELECT lattice_id, count(*) AS paths, true AS ok FROM words GROUP BY 1""")
def n6(spark, d):
    made = automata.determinize_and_normalize(lattice(spark, d))
    return paths.summary(made).select("lattice_id", "paths").join(normalise.is_probabilistic(_open(made), 1e-6), "lattice_id")


@query(
    "n6_arc_weights",
    LATTICE
    + f"""SELECT lattice_id, CAST(ilabel AS INT) AS ilabel, olabel, {r('-ln(sum(through) / sum(sum(through)) OVER (PARTITION BY lattice_id))')} AS weight
FROM post WHERE src = 0 GROUP BY lattice_id, ilabel, olabel""",
)
def n6_weights(spark, d):
    """The arcs that leave the start, of which each stands for one that skips a position and one that does not."""
    made = automata.determinize_and_normalize(lattice(spark, d))
    first = F.filter("arcs", lambda a: a["src"] == F.col("start"))
    return rounded(made.rows.select("lattice_id", F.inline(first)).select("lattice_id", "ilabel", "olabel", "weight"), "weight")


def _third(spark, d) -> composition.Automaton:
    """At most one label that 3 divides, at a tenth of it; after it an end, or an epsilon and an end."""
    labels = lattice(spark, d).arcs.select("olabel").distinct().withColumnRenamed("olabel", "ilabel")
    third = F.col("ilabel") % 3 == 0
    to = F.when(third, F.array(F.struct(F.lit(0), F.lit(1)))).otherwise(F.array(F.struct(F.lit(0), F.lit(0)), F.struct(F.lit(1), F.lit(1))))
    spoken = labels.select(F.inline(to.cast("array<struct<src:int,dst:int>>")), "ilabel", F.col("ilabel").alias("olabel"), F.when(third, F.col("ilabel") / 10).otherwise(0.0).alias("weight"))
    silent = labels.limit(1).select(F.lit(1).alias("src"), F.lit(2).alias("dst"), F.lit(0).alias("ilabel"), F.lit(0).alias("olabel"), F.lit(0.25).alias("weight"))
    states = labels.limit(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("final"), F.lit(s == 0).alias("is_start")) for s, f in ((0, 0.0), (1, 0.5), (2, 0.0))])))
    return composition.Automaton(spoken.unionByName(silent), states)


@query(
    "t6_compose",
    EPSILONS
    + f""", thirds AS (SELECT p.lattice_id, p.ids, p.w, count(*) FILTER (WHERE a.olabel <> 0 AND a.olabel % 3 = 0) AS n,
       coalesce(sum(a.olabel) FILTER (WHERE a.olabel <> 0 AND a.olabel % 3 = 0), 0) / 10.0 AS extra
  FROM paths p JOIN arcs a ON a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) GROUP BY ALL)
SELECT lattice_id, sum(CASE WHEN n = 0 THEN 1 ELSE 2 END)::DOUBLE AS n_paths,
       {r('-ln(sum(exp(-w - extra) * CASE WHEN n = 0 THEN 1 ELSE exp(-0.5) + exp(-0.25) END))')} AS mass
FROM thirds WHERE n <= 1 GROUP BY 1""",
)
def t6(spark, d):
    """Lattices with epsilons, composed with an automaton that has one as well."""
    made = paths.summary(composition.compose(epsilons(spark, d), _third(spark, d)))
    return rounded(made.select("lattice_id", F.col("paths").alias("n_paths"), "mass"), "mass")


def _open(lattices):
    """Only states with arcs: final weights are not part of what sums to 1."""
    from dataclasses import replace

    rows = lattices.rows.withColumn(
        "finals", F.transform("finals", lambda f, s: F.when(F.exists("arcs", lambda a: a["src"] == s), F.lit(float("inf"))).otherwise(F.lit(0.0)))
    )
    return replace(lattices, rows=rows)


@query("e_edit_distance", LATTICE + """, label AS (SELECT s.lattice_id, s.ids, coalesce(string_agg(chr(64 + a.olabel), '' ORDER BY a.arc_id), '') AS text
  FROM steps s LEFT JOIN arcs a ON a.lattice_id = s.lattice_id AND list_contains(s.ids, a.arc_id) GROUP BY s.lattice_id, s.ids),
want AS (SELECT lattice_id, chr(64 + min(olabel)) || chr(64 + 7) || chr(64 + 3) AS prefix FROM arcs WHERE src = 0 GROUP BY 1)
SELECT lattice_id, CAST(min(levenshtein(text, prefix)) AS DOUBLE) AS cost FROM label JOIN want USING (lattice_id) GROUP BY 1""")
def e(spark, d):
    """The least number of edits between a prefix and the beginnings of paths."""
    base = lattice(spark, d)
    first = F.array_min(F.transform(F.filter("arcs", lambda a: a["src"] == 0), lambda a: a["olabel"]))
    prefixes = base.rows.select("lattice_id", F.array(first, F.lit(7), F.lit(3)).alias("prefix"))
    return edit_distance.edit_distance_features(base, prefixes).groupBy("lattice_id").agg(F.min("cost").alias("cost"))


def _references(base) -> DataFrame:
    """At each position the largest label that the lattice has there."""
    top = base.arcs.groupBy("lattice_id", "ilabel").agg(F.max("olabel").alias("m"))
    return top.groupBy("lattice_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ilabel", "m"))), lambda s: s["m"]).alias("ref"))


_WRONG = SLOTS + """, top AS (SELECT lattice_id, ilabel, max(olabel) AS ref, max(p) AS best FROM norm GROUP BY 1, 2),
tie AS (SELECT n.lattice_id, n.ilabel, max(t.ref) AS ref, min(n.olabel) AS hyp FROM norm n JOIN top t USING (lattice_id, ilabel) WHERE n.p >= t.best - 1e-9 GROUP BY 1, 2),
wrong AS (SELECT *, hyp <> ref AS w FROM tie),
"""


@query("a_labelling_left_to_right", _WRONG + """until AS (SELECT max(struct_pack(s := lattice_id, l := ilabel)) AS last FROM wrong WHERE w)
SELECT lattice_id, count(*) AS asked, count(*) FILTER (WHERE w) AS corrected FROM wrong, until WHERE struct_pack(s := lattice_id, l := ilabel) <= last GROUP BY 1""")
def a_left(spark, d):
    """All samples are asked, one after the other, until none of them has an error."""
    base = sausage(spark, d)
    asked = labelling.simulate(base, _references(base), "sequential-hamming")
    return asked.groupBy("lattice_id").agg(F.count("*").alias("asked"), F.count_if("corrected").alias("corrected"))


@query("a_labelling_by_sample", _WRONG.rstrip().rstrip(",") + """
SELECT lattice_id, max(ilabel) FILTER (WHERE w) AS asked, count(*) FILTER (WHERE w) AS corrected FROM wrong GROUP BY 1 HAVING count(*) FILTER (WHERE w) > 0""")
def a_by_sample(spark, d):
    """Each sample is asked until it has no error itself."""
    base = sausage(spark, d)
    asked = labelling.simulate(base, _references(base), "sequential-hamming", by_sample=True)
    return asked.groupBy("lattice_id").agg(F.count("*").alias("asked"), F.count_if("corrected").alias("corrected"))


@query("a3_progress", _WRONG + f"""sizes AS (SELECT count(*) AS labels, count(DISTINCT lattice_id) AS samples, count(*) FILTER (WHERE w) AS errors, count(DISTINCT lattice_id) FILTER (WHERE w) AS bad FROM wrong),
until AS (SELECT max(struct_pack(s := lattice_id, l := ilabel)) AS last FROM wrong WHERE w),
asked AS (SELECT lattice_id, CAST(ilabel AS INT) AS position, w, row_number() OVER o AS step, sum(w::INT) OVER o AS corrected,
  w AND ilabel = max(ilabel) FILTER (WHERE w) OVER (PARTITION BY lattice_id) AS ends
  FROM wrong, until WHERE struct_pack(s := lattice_id, l := ilabel) <= last WINDOW o AS (ORDER BY lattice_id, ilabel)),
done AS (SELECT *, sum(ends::INT) OVER (ORDER BY step) AS mended FROM asked)
SELECT step, lattice_id, position, {r('step / labels')} AS asked_share, {r('corrected / labels')} AS corrected_share, {r('(errors - corrected) / labels')} AS label_error, {r('(bad - mended) / samples')} AS sample_error FROM done, sizes
UNION ALL SELECT 0, -1, 0, 0.0, 0.0, {r('errors / labels')}, {r('bad / samples')} FROM sizes""")
def a3(spark, d):
    """What is printed after every question."""
    base = sausage(spark, d)
    refs = _references(base)
    found = labelling.progress(labelling.simulate(base, refs, "sequential-hamming"), refs)
    shares = ("asked_share", "corrected_share", "label_error", "sample_error")
    start = {"lattice_id": F.coalesce("lattice_id", F.lit(-1)), "position": F.coalesce("position", F.lit(0))}
    return rounded(found.select("step", "lattice_id", "position", *shares).withColumns(start), *shares)


@query("a3_error_histogram", _WRONG + """per AS (SELECT lattice_id, count(*) FILTER (WHERE w) AS errors FROM wrong GROUP BY 1)
SELECT CAST(errors AS INT) AS errors, count(*) AS samples FROM per GROUP BY 1""")
def a3_histogram(spark, d):
    base = sausage(spark, d)
    refs = _references(base)
    return labelling.error_histogram(labelling.simulate(base, refs, "sequential-hamming"), refs)


@query("a14_prepared", LATTICE + f""", half AS (SELECT lattice_id, ids, w * 0.5 AS w FROM paths),
through AS (SELECT lattice_id, unnest(ids) AS arc_id, w FROM half), arc_cost AS (SELECT lattice_id, arc_id, -ln(sum(exp(-w))) AS c FROM through GROUP BY 1, 2),
lim AS (SELECT lattice_id, min(c) + 1.0 AS t FROM arc_cost GROUP BY 1), bad AS (SELECT lattice_id, arc_id FROM arc_cost JOIN lim USING (lattice_id) WHERE c > t),
ok AS (SELECT p.* FROM paths p WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.lattice_id = p.lattice_id AND list_contains(p.ids, b.arc_id))),
ends AS (SELECT lattice_id, count(*) AS n_left FROM ok GROUP BY 1),
text AS (SELECT lattice_id, count(*) AS n_ref, sum(m) AS ref_total FROM (SELECT lattice_id, ilabel, max(olabel) AS m FROM arcs GROUP BY 1, 2) GROUP BY 1)
SELECT lattice_id, CAST(n AS DOUBLE) AS paths, CAST(coalesce(n_left, 0) AS DOUBLE) AS "left", n_ref, CAST(ref_total AS DOUBLE) AS ref_total FROM mass JOIN text USING (lattice_id) LEFT JOIN ends USING (lattice_id)""")
def a14(spark, d):
    """Lattices and reference texts as a simulation takes them: scaled, pruned, encoded."""
    base = _named(lattice(spark, d))
    refs = _references(lattice(spark, d)).select("lattice_id", F.col("ref").alias("labels"))
    texts = structure.decode_symbols(refs, base.symbols)
    _, encoded, counts = labelling.prepared(base, texts, scale=0.5, threshold=1.0, normalized=True)
    total = F.aggregate("ref", F.lit(0.0), lambda t, x: t + x)
    return counts.join(encoded, "lattice_id").select("lattice_id", "paths", "left", F.size("ref").cast("long").alias("n_ref"), total.alias("ref_total"))


@query("n5_posteriors_over_automaton", SAUSAGE + f"SELECT {_ARC}, {r('weight - ln(1.25)')} AS weight FROM arcs")
def n5(spark, d):
    """The posteriors of each lattice on an automaton of its own labels, here without weights."""
    base = sausage(spark, d)
    return _arcs(automata.posteriors_over(base, normalise.remove_weights(base)))


@query("e6_set_prefix", LATTICE + """, label AS (SELECT s.lattice_id, s.ids, coalesce(string_agg(chr(64 + a.olabel), '' ORDER BY a.arc_id), '') AS text
  FROM steps s LEFT JOIN arcs a ON a.lattice_id = s.lattice_id AND list_contains(s.ids, a.arc_id) GROUP BY s.lattice_id, s.ids),
want AS (SELECT lattice_id, chr(64 + min(olabel)) || chr(64 + 9) || chr(64 + max(olabel)) AS prefix FROM arcs WHERE src = 0 GROUP BY 1)
SELECT lattice_id, CAST(min(levenshtein(text, prefix)) AS DOUBLE) AS cost FROM label JOIN want USING (lattice_id) GROUP BY 1""")
def e6(spark, d):
    """A prefix of two words, of which the second is replaced and a third is added: only the rows past the first are computed."""
    base = lattice(spark, d)
    own = F.transform(F.filter("arcs", lambda a: a["src"] == 0), lambda a: a["olabel"])
    typed = base.rows.select("lattice_id", F.array(F.array_min(own), F.lit(7)).alias("prefix"))
    edited = base.rows.select("lattice_id", F.array(F.array_min(own), F.lit(9), F.array_max(own)).alias("prefix"))
    found = edit_distance.trellis_features(edit_distance.set_prefix(edit_distance.trellis(base, typed), edited))
    return found.groupBy("lattice_id").agg(F.min("cost").alias("cost"))


@query("a_labelling_active")
def a_active(spark, d):
    base = sausage(spark, d)
    return rounded(labelling.simulate(base, _references(base), "active-label-mutual-information-global"), "score", "order_1", "order_2")


_ODD_FIRST = LATTICE + """, ok AS (SELECT p.* FROM paths p WHERE NOT EXISTS (SELECT 1 FROM arcs a
  WHERE a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) AND a.ilabel = 1 AND a.olabel % 2 = 1))
"""


def _not_odd_first(a):
    return (a["ilabel"] != 1) | (a["olabel"] % 2 != 1)


@query("f4_mask_dead", _ODD_FIRST + f"SELECT lattice_id, count(*) AS paths, {r('-ln(sum(exp(-w)))')} AS mass FROM ok GROUP BY 1")
def f4(spark, d):
    return rounded(paths.summary(filters.mask_dead(lattice(spark, d), _not_odd_first)).select("lattice_id", "paths", "mass"), "mass")


@query("f5_mask_zero", _ODD_FIRST + f"SELECT lattice_id, {r('-ln(sum(exp(-w)))')} AS mass FROM ok GROUP BY 1")
def f5(spark, d):
    masked = filters.mask_zero(lattice(spark, d), _not_odd_first)
    return rounded(paths.summary(masked).select("lattice_id", "mass").filter("mass < double('infinity')"), "mass")


@query("f10_connect", _ODD_FIRST + """, on_path AS (SELECT DISTINCT o.lattice_id, a.src FROM ok o JOIN arcs a ON a.lattice_id = o.lattice_id AND list_contains(o.ids, a.arc_id))
SELECT lattice_id, CAST(count(*) + 1 AS INT) AS states FROM on_path GROUP BY 1""")
def f10(spark, d):
    return paths.summary(filters.rm_arc(lattice(spark, d), _not_odd_first)).select("lattice_id", "states")


@query("w1_log_arithmetic", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('ln(l_quantity + l_extendedprice)')} AS added, {r('ln(l_extendedprice + 1 - l_quantity)')} AS taken,
  {r('l_discount * ln(10)')} AS based, {r('l_quantity')} AS p FROM lineitem WHERE l_extendedprice + 1 > l_quantity""")
def w1(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_extendedprice + 1 > l_quantity")
    q, price = F.log("l_quantity"), F.log("l_extendedprice")
    made = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        semiring.add_log(q, price).alias("added"),
        semiring.sub_log(F.log(F.col("l_extendedprice") + 1), q).alias("taken"),
        semiring.change_base(F.col("l_discount"), 10).alias("based"),
        semiring.probability(-q).alias("p"),
    )
    return rounded(made, "added", "taken", "based", "p")


@query("w5_vector_weights", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('l_quantity + l_tax')} AS first, {r('l_extendedprice - l_discount')} AS second,
  CASE WHEN l_quantity < l_tax + 25 THEN l_linenumber ELSE 0 END AS cheaper, {r('2 * l_quantity - l_extendedprice')} AS updated FROM lineitem""")
def w5(spark, d):
    """Log-linear weights: times, divide, plus and a new combination."""
    a = semiring.vector(F.col("l_quantity"), F.array("l_quantity", "l_extendedprice"))
    b = semiring.vector(F.col("l_tax"), F.array("l_tax", "l_discount"))
    one = semiring.vector_plus(
        semiring.vector(F.col("l_quantity"), F.array(F.col("l_linenumber").cast("double"))),
        semiring.vector(F.col("l_tax") + 25, F.array(F.lit(0.0))),
    )
    made = spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.get(semiring.vector_times(a, b)["features"], F.lit(0)).alias("first"),
        F.get(semiring.vector_divide(a, b)["features"], F.lit(1)).alias("second"),
        F.get(one["features"], F.lit(0)).cast("int").alias("cheaper"),
        semiring.vector_update(a, F.array(F.lit(2.0), F.lit(-1.0)))["weight"].alias("updated"),
    )
    return rounded(made, "first", "second", "updated")


@query("s12_feature_weights", LATTICE + f""", scored AS (SELECT p.lattice_id, p.ids, 0.7 * p.w + 0.1 * sum(a.ilabel) AS w
  FROM paths p JOIN arcs a ON a.lattice_id = p.lattice_id AND list_contains(p.ids, a.arc_id) GROUP BY p.lattice_id, p.ids, p.w)
SELECT lattice_id, {r('-ln(sum(exp(-w)))')} AS mass FROM scored GROUP BY 1""")
def s12(spark, d):
    """Features (cost, position) weighed anew."""
    base = lattice(spark, d).map_arcs(lambda a: with_fields(a, features=F.array(a["weight"], a["ilabel"].cast("double"))))
    return rounded(distance.mass(text_lattices.set_feature_weights(base, [0.7, 0.1])), "mass")


@query("n7_after_normalize", LATTICE + "SELECT lattice_id, true AS ok FROM mass")
def n7_after(spark, d):
    return normalise.is_probabilistic(normalise.normalize(lattice(spark, d)))


@query("t3_topsort", LATTICE + "SELECT lattice_id, count(*) AS arcs, true AS ordered FROM arcs GROUP BY 1")
def t3(spark, d):
    """States named at odds with their order are numbered so that arcs lead onward."""
    arcs = lattice(spark, d).arcs.select("lattice_id", (1000 - F.col("src") * 7 % 11).alias("src"), (1000 - F.col("dst") * 7 % 11).alias("dst"))
    nodes = arcs.select("lattice_id", F.col("src").alias("node")).union(arcs.select("lattice_id", "dst")).distinct()
    made = structure.topsort(arcs, nodes)
    at = lambda side: made.select("lattice_id", F.col("node").cast("long").alias(side), F.col("state").alias(f"n_{side}"))
    both = arcs.join(at("src"), ["lattice_id", "src"]).join(at("dst"), ["lattice_id", "dst"])
    return both.groupBy("lattice_id").agg(F.count("*").alias("arcs"), F.bool_and(F.col("n_src") < F.col("n_dst")).alias("ordered"))


@query("o6_edit_features")
def o6(spark, d):
    """Feature vectors of the words that may follow a prefix, one row per word."""
    base = lattice(spark, d)
    first = F.array_min(F.transform(F.filter("arcs", lambda a: a["src"] == 0), lambda a: a["olabel"]))
    return edit_distance.edit_distance_features(base, base.rows.select("lattice_id", F.array(first).alias("prefix")))
