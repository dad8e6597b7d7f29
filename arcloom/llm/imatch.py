"""I-Match document fingerprints, in DataFrame functions only.

A lexicon keeps the terms within a band of inverse document frequency.  A
fingerprint hashes, for each of 64 randomised subsets of the lexicon, the
sorted distinct terms of the text that belong to it.  Each subset draws each term
by itself, so subsets overlap and a term may be in several or in none.  Two fingerprints are as
like as the share of subsets with equal hashes among those that hold a term
of either text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm.common import cut, shuffle_partitions

#: A term is in the band when it is in this share of the documents.  The lower
#: bound also bounds the lexicon: it holds at most (mean number of distinct
#: terms of a document) / LEAST terms, however many documents there are.
LEAST, MOST = 0.01, 0.15
SLOTS = 1 << 13
SUBSETS = 64
#: a subset draws a term with a chance of one in 2 ** DRAWS
DRAWS = 6
#: a lexicon of so many terms is a constant of the plan (4 MB); a larger one is joined
MOST_INLINE = 200_000


def terms(text: Column) -> Column:
    """Sorted hashes of the distinct terms (runs of letters and digits, lower case)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


@dataclass(frozen=True)
class Lexicon:
    """The terms in the band: a table with the column ``term``, and, if there are few enough,
    two constant arrays: the terms ordered by slot, and where each slot starts."""

    band: DataFrame
    members: Column | None = None
    starts: Column | None = None


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> Lexicon:
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    band = cut(counts.filter((F.col("count") >= least * total) & (F.col("count") <= most * total)).select("term"))
    if band.count() > MOST_INLINE:
        return Lexicon(band)
    found = sorted((r.slot, r.term) for r in band.select("term", F.pmod("term", F.lit(SLOTS)).alias("slot")).collect())
    sizes = [0] * (SLOTS + 1)
    for slot, _ in found:
        sizes[slot + 1] += 1
    return Lexicon(band, _constant([t for _, t in found], "bigint"), _constant(accumulate(sizes), "int"))


def _constant(values: Iterable[int], kind: str) -> Column:
    # one literal that the optimizer folds into an array
    return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast(f"array<{kind}>")


def _within(found: Column, known: Lexicon) -> Column:
    """Those of the sorted terms that are in a lexicon of constants."""

    def holds(t: Column) -> Column:
        slot = F.pmod(t, F.lit(SLOTS)).cast("int")
        first, stop = F.get(known.starts, slot), F.get(known.starts, slot + 1)
        return F.array_contains(F.slice(known.members, first + 1, stop - first), t)

    return F.filter(found, holds)


def hashes(every: Column, inside: Column) -> Column:
    """SUBSETS hashes, null where none of the terms ``inside`` the lexicon is in the subset; and
    one of all terms for a text that has no term in any of them, else null."""

    def drawn(t: Column) -> Column:
        bits = F.xxhash64(t, F.lit(1))
        for i in range(2, DRAWS + 1):
            bits = bits.bitwiseAND(F.xxhash64(t, F.lit(i)))
        return F.struct(t.alias("term"), bits.alias("bits"))

    def one(members: Column, s: Column) -> Column:
        own = F.filter(members, lambda m: F.getbit(m["bits"], s) == 1)
        return _let(own, lambda o: F.when(F.size(o) > 0, _hash(F.transform(o, lambda m: m["term"]))))

    def whole(found: Column) -> Column:
        return F.concat(found, F.array(F.when(~F.exists(found, lambda h: h.isNotNull()), _hash(every))))

    subsets = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    return _let(F.transform(inside, drawn), lambda members: _let(F.transform(subsets, lambda s: one(members, s)), whole))


def with_prints(rows: DataFrame, text: str, name: str, known: Lexicon) -> DataFrame:
    """``rows`` with the hashes of the column ``text`` added as ``name``."""
    if known.members is not None:
        return rows.withColumn(name, _let(terms(F.col(text)), lambda every: hashes(every, _within(every, known))))
    numbered = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    inside = numbered.select("__row", F.explode(terms(F.col(text))).alias("term")).join(known.band, "term")
    inside = inside.groupBy("__row").agg(F.sort_array(F.collect_list("term")).alias("__inside"))
    own = F.coalesce("__inside", F.array().cast("array<bigint>"))
    made = numbered.join(inside, "__row", "left")
    return made.withColumn(name, _let(terms(F.col(text)), lambda every: hashes(every, own))).drop("__row", "__inside")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _hash(own: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(own))), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes among the subsets that either text has a term of; of texts without one,
    whether all their terms are equal."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: F.coalesce(s, F.lit(False))))
    some = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda s: s.isNotNull()))
    return same / some


def with_next(rows: DataFrame, *names: str) -> DataFrame:
    """Add ``next_<name>``: the named columns of the row with the next smaller
    doc_id, of the last row those of the first.

    The rows are dealt into buckets between quantiles of doc_id; the first row
    of a bucket also goes, as a guest, to the bucket before, whose last row
    needs it.  No window spans more than one bucket.
    """
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    part = rows.select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    )
    bounds = sorted((r.lo, r.hi) for r in part.select("lo", "hi").collect() if r.lo is not None)
    lows, highs = [lo for lo, _ in bounds] or [0], [hi for _, hi in bounds] or [0]
    wide = int(len(lows) ** 0.5) + 1

    def at_most(values: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= F.col("doc_id")))

    coarse = at_most(F.lit(lows[::wide]))
    fine = at_most(F.slice(F.lit(lows), F.greatest(coarse - 1, F.lit(0)) * wide + 1, F.lit(wide)))
    own = F.greatest(coarse - 1, F.lit(0)) * wide + F.greatest(fine, F.lit(1)) - 1
    guest = F.when(F.col("doc_id") == highs[-1], F.lit(0)).otherwise(own + 1)
    is_high = F.col("doc_id").isin(highs)
    # the largest doc_id is the guest of the bucket with the smallest, and no other bucket's
    seats = F.when(is_high, F.array(F.struct(own.alias("bucket"), F.lit(False).alias("guest")), F.struct(guest.alias("bucket"), F.lit(True).alias("guest"))))
    seats = seats.otherwise(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("guest"))))
    dealt = rows.withColumn("__seat", F.explode(seats))
    order = Window.partitionBy("__seat.bucket").orderBy("__seat.guest", F.desc("doc_id"), *names)
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in names})
    return dealt.filter("not __seat.guest").drop("__seat")


def imatch(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """doc_id and fingerprint (the hashes joined by spaces, ``-`` for none) per document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_prints(rows, "text", "print", lexicon(rows, least, most)).select("doc_id", shown(F.col("print")).alias("fingerprint"))


def shown(found: Column) -> Column:
    return F.array_join(found, " ", "-")


def edited_likeness(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Fingerprints of the texts and of edited ones, and how like they are.

    The last third of an edited text comes from the start of the document with
    the next smaller doc_id (after the smallest: the largest).  A null text
    counts as empty; a text without lexicon terms is known by all of its terms; a long
    text is one row, whatever its length; rows with equal doc_id follow each other by text; a table
    of one row has itself for a neighbour; an empty one gives an empty one;
    columns other than doc_id and text are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(rows, least, most)
    own = with_next(with_prints(rows, "text", "print", known), "text", "print")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    own = own.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    own = with_prints(own, "edited", "edited_print", known)
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("print")).alias("fingerprint"),
        shown(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
