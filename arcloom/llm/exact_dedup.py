"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own characters say so, into chunks of a few
hundred characters.  The chunks are moved once, to verify that no two
different ones share an identifier; after that a document is its recipe, the
ordered list of its chunks' identifiers, and equal recipes mean equal texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import cut

SPACES = " \t\n\x0b\x0c\r"
#: at least 256 characters up to a mark, or 1024 where no mark comes
CHUNK = r"(?s).{256,1023}?[.,;:!?]|.{1,1024}"
#: By the birthday bound about n**2 / 2**65 identifiers of n chunks clash: two
#: thousand of the 3e11 chunks of 100 TB.
MOST_CLASHES = 100_000


def normalised(text: Column) -> Column:
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def clashing(norm: DataFrame) -> DataFrame:
    """id: identifiers that different chunks of column ``norm`` share."""
    distinct = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(F.xxhash64("chunk").alias("id"), "chunk").distinct()
    return cut(distinct.groupBy("id").count().filter("count > 1").select("id"))


def _with_unsure(rows: DataFrame) -> DataFrame:
    """``rows`` with ``unsure``, the chunks of each text whose identifiers others share, which then belong to the recipe."""
    clashes = clashing(rows)
    few = [r.id for r in clashes.limit(MOST_CLASHES + 1).collect()]
    if len(few) <= MOST_CLASHES:
        own = F.filter(chunks(F.col("norm")), lambda c: F.xxhash64(c).isin(few)) if few else F.array().cast("array<string>")
        return rows.withColumn("unsure", own)
    # too many for a literal of the plan: joined, and gathered by text
    parts = rows.select("text_sha256", "norm").distinct().select("text_sha256", F.posexplode(chunks(F.col("norm"))).alias("at", "chunk"))
    parts = parts.withColumn("id", F.xxhash64("chunk")).join(clashes, "id", "left_semi")
    unsure = parts.groupBy("text_sha256").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "chunk"))), lambda p: p["chunk"]).alias("unsure"))
    return rows.join(unsure, "text_sha256", "left").withColumn("unsure", F.coalesce("unsure", F.array().cast("array<string>")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space (space, tab,
    line feed, vertical tab, form feed, carriage return); null counts as empty.
    Of equal texts the row with the most code points stays, of those the one
    with the smallest doc_id; rows that agree in doc_id too are kept alike.
    An empty table gives an empty one; columns other than doc_id and text are
    ignored.
    """
    rows = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm"))
    rows = _with_unsure(rows.withColumn("text_sha256", F.sha2("norm", 256)))
    recipe = F.transform(chunks(F.col("norm")), lambda c: F.xxhash64(c)).alias("recipe")
    recipes = cut(rows.select("doc_id", "n", recipe, "unsure", "text_sha256"))
    groups = cut(
        recipes.groupBy("recipe", "unsure").agg(
            F.min(F.struct((-F.col("n")).alias("n"), "doc_id")).alias("best"), F.count("*").alias("group_size")
        )
    ).select("recipe", "unsure", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_n"))
    return recipes.join(groups, ["recipe", "unsure"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
