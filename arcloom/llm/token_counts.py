"""Token counts of documents under a SentencePiece model.

A two-tier lookup on the map side: a compact table of the lengths of frequent
pre-tokens is broadcast, and what it lacks is encoded once per worker and
kept in a bounded cache.  No pre-token is ever shuffled.

A pre-token is a run of spaces with the characters up to the next space.  No
piece of the model holds a space after another character (checked when the
model is loaded), so no merge crosses a pre-token's border and the counts add
up to that of the whole text.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import small
from arcloom.llm.pretokens import LONGEST, Cache

PRE_TOKEN = re.compile("▁*[^▁]+|▁+")
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


@cache
def _processor(model: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    border = re.compile("[^▁]▁")
    if any(border.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("a piece of this model spans pre-tokens")
    return sp


@cache
def _rare(model: str, bound: int) -> Cache:
    """Per worker: counts of pre-tokens that the frequent table lacks.  The
    model puts a pre-token's first space before a text by itself, but not
    before an empty one, and a text of spaces only follows a line break here."""
    sp = _processor(model)

    newline = len(sp.encode("\n"))

    def count(word: str) -> int:
        return len(sp.encode("\n▁" + word)) - newline if word[-1:] in ("", "▁") else len(sp.encode(word))

    return Cache(count, bound)


def _words(text: str) -> list[str]:
    """Pre-tokens without the space that starts each."""
    if not text:
        return []
    if "▁" not in text and "  " not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [w[1:] for w in PRE_TOKEN.findall("▁" + text.replace(" ", "▁"))]


def frequent_lengths(docs: DataFrame, model: str, sample: int, size: int) -> dict[str, int]:
    """Token counts of the ``size`` commonest pre-tokens of about ``sample``
    documents.  It only saves work: any table gives the same token counts."""
    n = docs.count()
    if not n:
        return {}
    some = docs.sample(min(1.0, sample / n), seed=7).select("text").filter("text is not null")

    def words(batches):
        for b in batches:
            found = [w for t in b.column(0).to_pylist() for w in _words(t)]
            yield pa.RecordBatch.from_pydict({"w": found})

    top = (
        some.mapInArrow(words, "w string").filter(F.char_length("w") <= LONGEST).groupBy("w").count().filter("count > 1")
        .orderBy(F.desc("count"), "w").limit(size)
    )
    rare = _rare(model, 1)
    return {r.w: rare.make(r.w) for r in top.select("w").collect()}


def count_tokens(
    docs: DataFrame, model: str, limit: int = 4096, sample: int = 2000, table_size: int = 20_000, cache_size: int = 1_000_000
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``docs`` needs doc_id and text; other columns are not read.  A null text
    counts as empty (0 bytes, 0 tokens); repeated rows give repeated results;
    an empty table gives an empty one.  The broadcast table holds ``table_size``
    entries at most, a worker's cache ``cache_size``, none of more than LONGEST characters.
    """
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(frequent_lengths(docs, model, sample, table_size))

    def count(batches):
        common, rare = table.value, _rare(model, cache_size)
        get = common.get
        for b in small(batches):
            ids, texts = b.column(0), b.column(1).to_pylist()
            sizes, tokens = [], []
            for t in texts:
                total = 0
                for w in _words(t or ""):
                    n = get(w)
                    total += rare[w] if n is None else n
                sizes.append(len(t.encode()) if t else 0)
                tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
