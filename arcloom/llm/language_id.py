"""Language identification with a bit-sliced Bloom filter of n-grams.

Slot s of the filter holds one bit per language, so that the slices of all
languages are read at once: the AND of the slots of an n-gram's hashes is the
bitmask of the languages that contain the n-gram.  Per language the set bits
over a text's n-grams are counted, the share that the slice's fill makes by
chance is taken off, and the largest share decides.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm.common import small, trimmed

GRAM = 4
HASHES = 2
UNKNOWN = "und"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the first of each text.  Every
    letter gives the n-gram that starts one character before it; other
    characters count as spaces."""
    gap = " " * GRAM
    chars = np.frombuffer((gap + gap.join((t or "").lower() for t in texts) + gap).encode("utf-32-le"), np.uint32)
    # lower-casing may change the number of characters
    sizes = np.array([len((t or "").lower()) for t in texts]) + GRAM
    starts = GRAM + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    letter = _letters()[chars]
    chars = np.where(letter, chars, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    h = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        h += (chars[at - 1 + k] + np.uint64(k + 1)) * _ODD[k]
        h ^= h >> np.uint64(29)
        h *= _ODD[0]
    return h ^ (h >> np.uint64(32)), np.searchsorted(at, starts)


def _slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((grams >> np.uint64(24 * k)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


def _slices(texts: list, max_chars: int):
    """Index ranges of texts with about max_chars characters together."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and total + n > max_chars:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def train(
    labelled: DataFrame, sample_docs: int = 1000, min_count: int = 3, ratio: float = 20.0, bits: int = 21
) -> tuple[list[str], np.ndarray]:
    """The languages and the filter of documents (text, lang).

    Learns from a sample of about ``sample_docs`` documents of each
    language at most, drawn by a hash of the row, so that it is the same however the rows are dealt.  A
    language contains an n-gram that it shows ``min_count`` times, and not
    ``ratio`` times more rarely than another.  The result has a row of 2**bits slots
    for every 64 languages.
    """
    drawn = F.xxhash64(*[c for c in ("doc_id", "text") if c in labelled.columns], F.lit(11))
    chance = F.pmod(drawn, F.lit(1 << 30)) / (1 << 30)
    rows = labelled.select("lang", "text", chance.alias("chance")).filter("lang is not null and text is not null")
    count = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(count)
    table = np.zeros((max(1, -(-len(langs) // 64)), 1 << bits), np.uint64 if len(langs) > 8 else np.uint8)
    if not langs:
        return langs, table
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / count[k]))])
    index = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    some = rows.filter(F.col("chance") < F.element_at(share, F.col("lang"))).select(F.element_at(index, F.col("lang")).alias("l"), "text")

    def grams(batches):
        for b in batches:
            ls, texts = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
            for l in np.unique(ls):
                own = [texts[i] for i in np.flatnonzero(ls == l)]
                g, n = np.unique(_grams(own)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(g), l), pa.int32()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["l", "g", "n"]
                )

    counts = some.mapInArrow(grams, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    total = counts.groupBy("l").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(total), "l").withColumn("rate", F.col("n") / F.col("total"))
    kept = rate.withColumn("most", F.max("rate").over(Window.partitionBy("g"))).filter(F.col("rate") * ratio >= F.col("most"))
    word = F.floor(F.col("l") / 64).cast("int").alias("word")
    masks = kept.groupBy("g", word).agg(F.bit_or(F.expr("shiftleft(1L, l % 64)")).alias("mask"))
    slot = F.array(*[F.shiftrightunsigned("g", 24 * k).bitwiseAND((1 << bits) - 1) for k in range(HASHES)])
    slots = masks.select(F.explode(slot).alias("slot"), "word", "mask").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    got = slots.toPandas()
    table[got["word"].to_numpy(np.int64), got["slot"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).astype(np.uint64).astype(table.dtype)
    return langs, table


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *added: str) -> DataFrame:
    """``docs`` with lang_pred and score (or the two names ``added``): the language whose corrected share of
    the text's n-grams is largest (the first by name of equals), and that share.
    A text that is null or has no letter is ``und`` with score 0; without a language learned so is every text;
    long texts are read whole; a column of an added name is replaced."""
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    bits = table.shape[1].bit_length() - 1
    lang_name, score_name = added or ("lang_pred", "score")
    docs = docs.drop(lang_name, score_name)
    names = [*docs.columns, lang_name, score_name]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{lang_name}` string", f"`{score_name}` double"])
    chance = [float(((table[l // 64] >> table.dtype.type(l % 64)) & table.dtype.type(1)).mean()) ** HASHES for l in range(len(langs))]

    def run(batches):
        table = shared.value
        one = table.dtype.type(1)
        for b in small(batches):
            texts = b.column(names.index("text")).to_pylist()
            preds, scores = [], []
            for lo, hi in _slices(texts, 1_000_000):
                grams, first = _grams(texts[lo:hi])
                n = np.diff(np.append(first, len(grams)))
                some = n > 0
                mask = None
                for s in _slots(grams, bits):
                    mask = table[:, s] if mask is None else mask & table[:, s]
                shares = np.zeros((max(1, len(langs)), hi - lo))
                for l in range(len(langs)):
                    if some.any():
                        hits = np.add.reduceat((mask[l // 64] >> table.dtype.type(l % 64)) & one, first[some], dtype=np.int64)
                        shares[l, some] = (hits / n[some] - chance[l]) / (1 - chance[l])
                best = shares.argmax(0)
                preds += [langs[k] if s and langs else UNKNOWN for k, s in zip(best, some, strict=True)]
                scores.append(np.clip(shares.max(0), 0, 1))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=names
            )
        trimmed()

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    """False for a null doc_id; true for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **training) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    Learns from documents that are not held out.  Repeated rows give repeated
    results, an empty table an empty one; columns other than doc_id, text and
    lang are ignored.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(rows.filter("not held_out"), **training)
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
