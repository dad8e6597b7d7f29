"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths are integers up to the capacity, so an instance is its histogram: at
most ``capacity`` numbers however many documents there are.  The plan is made
on that histogram (whole classes of equal bins at once) and the documents are
dealt to it by their rank within their length, which is found from counts per
(bucket, length) without a global sort.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm.common import cut, shuffle_partitions, small
from arcloom.llm.pretokens import Cache, byte_letters, plain, words_after_spaces

GROUPS = 256
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: fixed value: the split pattern of byte-level pre-tokenizers
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@cache
def _encoder(tokenizer: str, bound: int):
    """text -> little-endian 32-bit ids, special strings as the library's default."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer)
    letters = str.maketrans(byte_letters())
    special = [t.content for t in tk.get_added_tokens_decoder().values()]

    packed = [i.to_bytes(4, "little") for i in range(tk.get_vocab_size())]

    def ids(word: str) -> bytes:
        return b"".join([packed[t.id] for t in tk.model.tokenize(word.encode().decode("latin-1").translate(letters))])

    single = Cache(ids, bound // 2)
    spaced = Cache(lambda word: b"".join(map(single.__getitem__, BYTE_LEVEL.findall(" " + word))), bound)

    def pieces(text: str) -> bytes:
        return b"".join(map(single.__getitem__, BYTE_LEVEL.findall(text)))

    def encode(text: str) -> bytes:
        if not plain(text) or any(s in text for s in special):
            return np.array(tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = words_after_spaces(text)
        if words is None:
            return pieces(text)
        return (pieces(words[0]) if words[0] else b"") + b"".join(map(spaced.__getitem__, words[1:]))

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, cache_size: int = 500_000) -> DataFrame:
    """Tokenise and cut: only documents over ``capacity`` are cut, and all their
    pieces but the first are full."""
    end_id = np.array([end], "<u4").tobytes()

    def cut_up(batches):
        encode = _encoder(tokenizer, cache_size)
        for b in small(batches):
            out = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end_id
                start, stop, piece = 0, (len(ids) // 4 - 1) % capacity + 1, 0
                while start < len(ids) // 4:
                    row = (doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", "text").mapInArrow(cut_up, SCHEMA)


Run = tuple[int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> list[Run]:
    """Runs (length, first rank, number, first bin, offset): the documents of a
    length with ranks from ``first rank`` go one each to the bins from ``first bin``.

    The grouping scheme at several numbers of groups and bounds between large and small, up
    to a group for each length; its limit without large lengths is plain best fit by
    decreasing length, so no plan has more bins than that.  The first that
    reaches the bound from below, or else the one with fewest bins, is taken.
    """
    if not counts:
        return []
    least = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    best, fewest = [], None
    for number, large_over in ((groups, 0.4), (1.0, 1.0), (4 * groups, 0.35), (capacity * capacity, 0.35), (capacity * capacity, 0.5), (groups, 0.5)):
        runs = scheme(counts, capacity, int(number), large_over)
        bins = max(first + n for _, _, n, first, _ in runs)
        if fewest is None or bins < fewest:
            best, fewest = runs, bins
        if bins == least:
            break
    return best


def scheme(counts: dict[int, int], capacity: int, groups: int, large_over: float) -> list[Run]:
    """One plan.

    1. Lengths over ``large_over`` of the capacity are dealt, longest first, into
       ``groups`` groups of equal cardinality and rounded up to their group's
       longest.
    2. Configurations of these few sizes: again and again the fullest one that
       holds the largest size left, used as often as its sizes allow.  Over a third
       of the capacity a configuration is one size or a pair, and to pair the largest with
       the largest that fits leaves no pair unmade, so the rounded instance is solved at its best.
    3. Actual documents take the slots, longest first within their group.
    4. The rest go, longest first, each to the fullest bin that it fits;
       equal bins are handled together as runs.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    taken = dict.fromkeys(counts, 0)
    bins = 0
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def leave(space: int, first: int, number: int) -> None:
        if space and number:
            if space not in room:
                insort(rooms, space)
                room[space] = []
            room[space].append((first, number))

    large = sorted((s for s in counts if s > capacity * large_over), reverse=True)
    per_group = max(1, -(-sum(counts[s] for s in large) // groups))
    grouped: list[list[list[int]]] = []  # group -> [length, left], longest first
    size, filled = [], per_group
    if groups >= capacity:  # nothing is rounded up: a group for each length, not for each document
        grouped, size = [[[s, counts[s]]] for s in large], list(large)
    for s in large if groups < capacity else ():
        left = counts[s]
        while left:
            if filled == per_group:
                grouped.append([])
                size.append(s)
                filled = 0
            n = min(left, per_group - filled)
            grouped[-1].append([s, n])
            filled, left = filled + n, left - n
    left = [sum(n for _, n in g) for g in grouped]
    while any(left):
        top = next(i for i, n in enumerate(left) if n)
        shape = _fullest(top, size, left, capacity)
        times = min(left[i] // k for i, k in shape.items())
        slots = [i for i, k in sorted(shape.items()) for _ in range(k)]
        done = 0
        while done < times:
            # as many equal bins as the next documents of every slot allow
            n, need = times - done, {i: slots.count(i) for i in slots}
            heads = []
            for i in dict.fromkeys(slots):
                s, have = grouped[i][0]
                if have >= need[i]:
                    n = min(n, have // need[i])
                    heads += [(i, s)] * need[i]
                else:
                    n = 1
                    heads += [(i, s) for s, h in grouped[i] for _ in range(h)][: need[i]]
            if n == 1:  # a slot's documents may differ in length
                heads = [(i, s) for i in dict.fromkeys(slots) for s in _first(grouped[i], need[i])]
            offset = 0
            for i, s in heads:
                runs.append((s, taken[s], n, bins, offset))
                taken[s] += n
                offset += s
                _take(grouped[i], s, n)
                left[i] -= n
            leave(capacity - offset, bins, n)
            bins, done = bins + n, done + n
    for s in sorted((s for s in counts if s <= capacity * large_over), reverse=True):
        rest = counts[s]
        while rest:
            at = bisect_left(rooms, s)
            if at == len(rooms):  # open as many bins as these documents fill
                each = capacity // s
                n = max(1, rest // each)
                leave(capacity, bins, n)
                bins += n
                continue
            space = rooms[at]
            first, number = room[space].pop()
            if not room[space]:
                del room[space]
                rooms.pop(at)
            n = min(rest, number)
            leave(space, first + n, number - n)
            runs.append((s, taken[s], n, first, capacity - space))
            taken[s] += n
            rest -= n
            leave(space - s, first, n)
    return runs


def _first(group: list[list[int]], n: int) -> list[int]:
    out: list[int] = []
    for s, have in group:
        out += [s] * min(have, n - len(out))
        if len(out) == n:
            break
    return out


def _take(group: list[list[int]], s: int, n: int) -> None:
    for entry in group:
        if entry[0] == s:
            entry[1] -= n
    group[:] = [e for e in group if e[1]]


def _fullest(top: int, size: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """The configuration with the largest total that holds size ``top``; few more
    sizes fit, as each is large."""
    best, best_total = {top: 1}, size[top]

    def extend(shape: dict[int, int], total: int, start: int) -> None:
        nonlocal best, best_total
        if total > best_total:
            best, best_total = dict(shape), total
        for i in range(start, len(size)):
            if total + size[i] <= capacity and left[i] > shape.get(i, 0):
                shape[i] = shape.get(i, 0) + 1
                extend(shape, total + size[i], i)
                shape[i] -= 1
                if not shape[i]:
                    del shape[i]

    extend({top: 1}, size[top], top)
    return best


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...).

    Ranks within a length come from ranks within (bucket, length) plus the
    counts of the buckets before, so no length is gathered in one task.
    """
    spark = pieces.sparkSession
    buckets = 4 * shuffle_partitions(spark)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    dealt = pieces.withColumn("__bucket", bucket)
    counts = cut(dealt.groupBy("length", "__bucket").count())
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = plan(histogram, capacity)
    table = spark.createDataFrame(
        runs or [(0, 0, 0, 0, 0)], "length long, __lo long, __n long, __bin long, offset long"
    )
    # runs of one length follow each other by rank, so a length's runs make one sorted list
    table = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("__lo", "__bin", "offset"))).alias("__runs"))
    own = Window.partitionBy("__bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(own) - 1).join(first, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__first")).drop("__first", "__bucket")
    return place(ranked, table)


def place(ranked: DataFrame, table: DataFrame) -> DataFrame:
    """Look up each rank's run.  The table has a row per length at most."""

    return (
        ranked.join(F.broadcast(table), "length")
        .withColumn("__run", F.element_at(F.filter("__runs", lambda r: r["__lo"] <= F.col("__rank")), -1))
        .withColumn("sequence_id", F.col("__run.__bin") + F.col("__rank") - F.col("__run.__lo"))
        .withColumn("offset", F.col("__run.offset"))
        .drop("__run", "__runs", "__rank")
    )


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty (the end token alone); repeated rows are packed
    each for itself; an empty table gives an empty one; other columns are ignored.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity, end))
    return pack(pieces, capacity).select(*[c.split()[0] for c in SCHEMA.split(", ")], "sequence_id", "offset")
