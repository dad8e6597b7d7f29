"""Prefix trie of conversations, found by peeling turns off from the deepest level.

A frontier row stands for a node whose subtree is done.  At depth d the
conversations that end there meet the surviving nodes of depth d+1 without
their last turn, and one aggregation makes the nodes of depth d with all that
is known of their subtrees.  Copies of a conversation are one row before the
first turn goes, so a frontier is never larger than the level's nodes.

Shallow levels are one aggregation each, combined before the shuffle.  The long
tail of deep levels is peeled in bands: rows that agree down to a band's floor go
to one task, which peels the whole band; groups with more turns than MOST_TURNS
are peeled level by level instead.

Turns are known by two 64-bit hashes, prefixes by the exclusive or of the
hashes of their turns with their places: 128 bits a node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import shuffle_partitions, written

#: every conversation takes up to five first turns of the conversation that opens its hundred
HUNDRED, MOST_SHARED = 100, 6
#: levels up to this depth are an aggregation each; bands above it end at four times their floor
SHALLOW, WIDEN = 8, 4
#: a band's group with more turns than this is not given to one task
MOST_TURNS = 20_000
#: ids of this range of conversations are joined before they are hashed
ID_RANGE = 65_536

STATE = "conv long, n long, kids long, leaves long, saved long, ends string, a array<long>, b array<long>, size array<int>"
NODE = "conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ka long, kb long, pa long, pb long"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def shared(conv_id: Column) -> Column:
    """How many turns a conversation takes over: crc32 of its decimal id, modulo 6."""
    return (F.crc32(conv_id.cast("string")) % MOST_SHARED).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): hashes and lengths of each rebuilt conversation's turns, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct(
        "turn",
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("x"),
        F.xxhash64(F.lit(2), role, text).alias("y"),
        F.char_length(text).alias("size"),
    )
    own = written(
        conversations.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("own"))
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).withColumn("h", shared(F.col("conv_id")))
    )
    opening = own.filter("conv_id = base").select("base", F.slice("own", 1, MOST_SHARED - 1).alias("opening"))
    none = F.slice("own", 1, 0)
    turns = F.concat(F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return own.join(opening, "base", "left").select("conv_id", turns.alias("turns"))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, a, b, size): by depth, the two hashes of the prefix and the length of its last text."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            ends = lists.offsets.to_numpy()
            start, lens = ends[0], np.diff(ends)
            flat = lists.flatten()
            out = [ids]
            offsets = pa.array(ends - start, pa.int32())
            for k in range(2):
                values = flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64)
                upto = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(values)]) if len(values) else np.zeros(1, np.uint64)
                mine = upto[1:] ^ np.repeat(upto[(ends - start)[:-1]], lens)
                out.append(pa.ListArray.from_arrays(offsets, pa.array(mine.view(np.int64))))
            out.append(pa.ListArray.from_arrays(offsets, flat.field(2)))
            yield pa.RecordBatch.from_arrays(out, names=["conv_id", "a", "b", "size"])

    placed = F.transform(
        "turns",
        lambda t, i: F.struct(F.xxhash64(i, t["x"], t["y"]).alias("a"), F.xxhash64(t["y"], i, t["x"]).alias("b"), t["size"].alias("size")),
    )
    return turns.select("conv_id", placed.alias("t")).mapInArrow(run, "conv_id long, a array<long>, b array<long>, size array<int>")


def _key(depth: Column) -> list[Column]:
    """Hashes of the prefix of this depth; the root's are 0."""
    return [F.when(depth > 0, F.get(name, depth - 1)).otherwise(F.lit(0)).alias(f"k{name}") for name in "ab"]


def ended(found: DataFrame) -> DataFrame:
    """One frontier row for each distinct conversation, with its depth, ends hashed."""
    depth = F.size("a")
    keys = ["depth", "ka", "kb"]
    path = F.struct("a", "b", "size")
    parts = written(
        found.withColumn("depth", depth).select("*", *_key(F.col("depth")), F.floor(F.col("conv_id") / ID_RANGE).alias("part"))
        .groupBy(*keys, "part")
        .agg(
            F.min("conv_id").alias("conv"),
            F.count("*").alias("n"),
            F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"),
            F.min_by(path, "conv_id").alias("path"),
        )
    )
    whole = parts.groupBy(*keys).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.count("*").alias("parts"), F.min("ids").alias("ids"), F.min_by("path", "conv").alias("path")
    )
    zero = F.lit(0).cast("long")
    state = lambda ends: ["depth", "conv", "n", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), ends.alias("ends"), "path.*"]
    whole = written(whole)
    one = whole.filter("parts = 1").select(*state(F.sha2("ids", 256)))
    many = whole.filter("parts > 1")
    if many.isEmpty():
        return one

    def run(batches):
        now, state = None, None
        done = []
        for batch in batches:
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(done, "depth int, ka long, kb long, ends string")
            done = []
        if now is not None:
            yield _batch([(*now, state.hexdigest())], "depth int, ka long, kb long, ends string")

    ordered = (
        parts.join(many.select(*keys), keys, "left_semi").select(*keys, "part", "ids")
        .repartition(shuffle_partitions(parts.sparkSession), *keys).sortWithinPartitions(*keys, "part").select(*keys, "ids")
    )
    hashes = ordered.mapInArrow(run, "depth int, ka long, kb long, ends string")
    return one.unionByName(many.join(hashes, keys).select(*state(F.col("ends"))))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth, as state, from conversations that end there and survivors cut to it."""
    grouped = rows.groupBy(*_key(F.lit(depth))).agg(
        F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")],
        F.max("ends").alias("ends"),
        F.min_by(F.struct("a", "b", "size"), "conv").alias("path"),
    )
    last = F.get("path.size", F.lit(depth - 1)) if depth else F.lit(0)
    return grouped.select(
        "conv",
        "n",
        "kids",
        F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * last).alias("saved"),
        "ends",
        "path.*",
    )


def _stripped(level: DataFrame, depth: int) -> DataFrame:
    """Nodes of a depth as they meet at the depth above: one child each, without their last turn."""
    cut = [F.slice(c, 1, depth - 1).alias(c) for c in ("a", "b", "size")]
    return level.select("conv", "n", F.lit(1).cast("long").alias("kids"), "leaves", "saved", F.lit(None).cast("string").alias("ends"), *cut)


def _nodes(level: DataFrame, depth: int) -> DataFrame:
    own, above = _key(F.lit(depth)), _key(F.lit(max(depth - 1, 0)))
    if depth == 0:
        above = [F.lit(None).cast("long")] * 2
    return level.select(
        F.col("conv").alias("conv_id"),
        F.lit(depth).alias("depth"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        *[c.cast("long").alias(n) for c, n in zip([*own, *above], ("ka", "kb", "pa", "pb"), strict=True)],
    )


def _peel(rows: list[tuple], floor: int) -> tuple[list[tuple], tuple]:
    """Nodes deeper than ``floor`` of rows that agree down to it, and the one row that is left."""
    by_depth: dict[int, list[tuple]] = {}
    for row in rows:
        by_depth.setdefault(len(row[6]), []).append(row)
    nodes, level = [], {}
    for depth in range(max(by_depth), floor - 1, -1):
        for row in by_depth.get(depth, ()):
            _meet(level, row, depth)
        if depth == floor:
            break
        above: dict[tuple, list] = {}
        for (ka, kb), (conv, n, kids, leaves, saved, ends, a, b, size) in level.items():
            leaves = leaves if kids else 1
            saved += (n - 1) * size[depth - 1]
            pa_, pb = (a[depth - 2], b[depth - 2]) if depth > 1 else (0, 0)
            nodes.append((conv, depth, n, kids, leaves, saved, ends or NO_ENDS, ka, kb, pa_, pb))
            _meet(above, (conv, n, 1, leaves, saved, None, a, b, size), depth - 1)
        level = above
    (conv, n, kids, leaves, saved, ends, a, b, size), = level.values()
    return nodes, (conv, n, kids, leaves, saved, ends, a[:floor], b[:floor], size[:floor])


def _meet(level: dict, row: tuple, depth: int) -> None:
    key = (row[6][depth - 1], row[7][depth - 1]) if depth else (0, 0)
    held = level.get(key)
    if held is None:
        level[key] = list(row)
        return
    if row[0] < held[0]:
        held[0], held[6:] = row[0], row[6:]
    for k in range(1, 5):
        held[k] += row[k]
    held[5] = held[5] or row[5]


def _band(rows: DataFrame, floor: int) -> tuple[DataFrame, DataFrame]:
    """Nodes deeper than ``floor``, and the survivors cut to it, of groups that each fit one task."""

    def run(batches):
        now, held = None, []

        def done():
            nodes, left = _peel(held, floor)
            return [(*n, *[None] * 9) for n in nodes] + [(*[None] * 11, *left)]

        for batch in batches:
            out = []
            for ka, kb, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (ka, kb) != now:
                    if held:
                        out += done()
                    now, held = (ka, kb), []
                held.append(tuple(row))
            yield _batch(out, f"{NODE}, {STATE}")
        if held:
            yield _batch(done(), f"{NODE}, {STATE}")

    spark = rows.sparkSession
    names = [x.split()[0] for x in STATE.split(", ")]
    dealt = rows.repartition(shuffle_partitions(spark), "ka", "kb").sortWithinPartitions("ka", "kb").select("ka", "kb", *names)
    found = written(dealt.mapInArrow(run, f"{NODE}, {STATE}"))
    return found.filter("conv_id IS NOT NULL").select(*[x.split()[0] for x in NODE.split(", ")]), found.filter("conv_id IS NULL").select(*names)


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (its smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are taken by ``turn`` (null first), ties by role and then by the text's hash.  Null and empty role or
    text are the same; rows without a conv_id are left out; repeated rows are repeated turns; a text may be of
    any length; an empty table has no node, not even a root.  Other columns are ignored, whatever their names.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    ends = written(ended(paths(rebuilt(conversations))))
    deepest = ends.agg(F.max("depth")).first()[0]
    if deepest is None:
        return _with_parents(ends.select(*[F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in NODE.split(", "))]).limit(0))
    floors = [SHALLOW]
    while floors[-1] * WIDEN < deepest:
        floors.append(floors[-1] * WIDEN)
    done: list[DataFrame] = []
    names = [x.split()[0] for x in STATE.split(", ")]
    frontier, top = None, deepest
    for floor in [f for f in reversed(floors) if f < deepest]:
        rows = ends.filter((F.col("depth") > floor) & (F.col("depth") <= top)).select(*names)
        rows = rows if frontier is None else rows.unionByName(frontier)
        rows = rows.select("*", *_key(F.lit(floor)))
        turns = rows.groupBy("ka", "kb").agg(F.sum(F.size("a") - floor).alias("turns"))
        hot = written(turns.filter(F.col("turns") > MOST_TURNS).select("ka", "kb"))
        levels = None
        if not hot.isEmpty():
            levels = rows.join(hot, ["ka", "kb"], "left_semi").select(*names)
            rows = rows.join(hot, ["ka", "kb"], "left_anti")
        nodes, frontier = _band(rows, floor)
        done.append(nodes)
        if levels is not None:
            nodes, left = _levels(levels, top, floor)
            done += nodes
            frontier = frontier.unionByName(left)
        top = floor
    rows = ends.filter(F.col("depth") <= top).select(*names)
    nodes, _ = _levels(rows if frontier is None else rows.unionByName(frontier), top, -1)
    found = done + nodes
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return _with_parents(every)


def _levels(rows: DataFrame, top: int, floor: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Peel one turn at a time from depth ``top`` to below ``floor``: nodes by level, and the survivors cut to it."""
    rows = written(rows)
    done, left = [], None
    for depth in range(top, floor, -1):
        now = rows.filter(F.size("a") == depth)
        level = written(_level(now if left is None else now.unionByName(left), depth))
        done.append(_nodes(level, depth))
        left = _stripped(level, depth) if depth else None
    return done, left


def _with_parents(nodes: DataFrame) -> DataFrame:
    """A hot parent's children are many rows against one: adaptive execution splits them."""
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, ["depth", "pa", "pb"], "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


#: CRC-32 of an ASCII string, bit by bit
CRC = """xor(list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT),
 lambda a, x: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(a, x)), 4294967295::BIGINT), 4294967295)"""

ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.conv_id, c.base, c.h, count(t.p) AS took FROM c LEFT JOIN t ON t.conv_id = c.base AND t.p <= c.h GROUP BY ALL),
r AS (SELECT k.conv_id, t.p AS d, t.role, t.text FROM k JOIN t ON t.conv_id = k.base AND t.p <= k.h
      UNION ALL
      SELECT k.conv_id, t.p - k.h + k.took, t.role, t.text FROM k JOIN t ON t.conv_id = k.conv_id WHERE t.p > k.h),
w AS (SELECT conv_id, 0 AS d, 0 AS size, '' AS path FROM c
      UNION ALL
      SELECT conv_id, d, length(text), string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY d) FROM r),
m AS (SELECT conv_id, d, size, sha256(path) AS key, lag(sha256(path)) OVER (PARTITION BY conv_id ORDER BY d) AS parent,
             d = max(d) OVER (PARTITION BY conv_id) AS ends FROM w),
node AS (SELECT d, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
         FROM m GROUP BY d, key),
kids AS (SELECT d - 1 AS d, parent AS key, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids ON node.d = kids.d AND node.key = kids.key),
sub AS (SELECT m.d, m.key, sum((f.kids = 0)::BIGINT) AS leaves, sum((f.n - 1) * f.size) AS saved
        FROM full_node f JOIN m ON m.conv_id = f.conv_id AND m.d <= f.d GROUP BY m.d, m.key)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN sub s ON s.d = f.d AND s.key = f.key LEFT JOIN node p ON p.d = f.d - 1 AND p.key = f.parent
"""
