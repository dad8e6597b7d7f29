"""SimHash fingerprints and near-duplicates by sharded BK-trees.

Fingerprints within ``radius`` bits agree in all but ``radius`` of any more
blocks that they are cut into, so they meet in a shard keyed by the blocks
they agree in.  Each shard holds BK-trees, whose children are keyed by their
integer Hamming distance to the parent; a search follows only the edges
within the radius.  A shard beyond ``TREE`` fingerprints is split by parts of the bits that
its key leaves open, and what is still larger into several
trees, each of which is sent to every cell in which other fingerprints of
its shard search it.  What the trees find is kept as a spanning forest per
cell, so that a group of copies gives as many links as it has members.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import components, cut, small, trimmed, written

SEED = 42
BITS = 64
#: most fingerprints of one tree
TREE = 1000
#: up to so many shards with several trees, these are broadcast; more are joined by a shuffle
FEW_FULL = 10_000


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        if new:
            node = 0
            while True:
                d = (self.values[node] ^ value).bit_count()
                child = self.children[node].get(d)
                if child is None:
                    self.children[node][d] = new
                    return
                node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            if len(children[node]) <= 2 * radius:
                stack += [c for e, c in children[node].items() if -radius <= e - d <= radius]
            else:
                stack += [children[node][e] for e in range(d - radius, d + radius + 1) if e in children[node]]
        return found


class Forest:
    """Disjoint sets of 0..n-1, each known by its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def signatures(hashes: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each array of 64-bit hashes: bit by bit, whether more than
    half of them have it set."""
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return signatures_of(every, np.array([len(h) for h in hashes], np.int64))


def signatures_of(every: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As ``signatures``, of arrays that follow each other in ``every``."""
    ones = np.zeros((len(counts), BITS), np.int64)
    starts = np.cumsum(counts) - counts
    # the longest ones by themselves: side by side they would stand alone
    few = counts <= np.sort(counts)[-min(len(counts), ALONE)] if len(counts) else counts == 0
    if few.any():
        ones[few] = _sliced_counts(every, starts[few], counts[few])
    for i in np.flatnonzero(~few):
        for lo in range(starts[i], starts[i] + counts[i], 1 << 16):
            part = every[lo : min(lo + (1 << 16), starts[i] + counts[i])]
            ones[i] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def digests_as_hashes(digests: list[bytes]) -> np.ndarray:
    """XXH64 digests (big-endian) as numbers."""
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)


#: so many of the longest arrays are not counted side by side with the others
ALONE = 32


def _sliced_counts(every: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each array's hashes set each bit.  Word p of an array's counter
    holds bit p of its 64 counts, so that one step adds a hash to all of them."""
    order = np.argsort(-counts, kind="stable")
    starts, sizes = starts[order], counts[order]
    most = int(sizes[0]) if len(sizes) else 0
    slices = np.zeros((max(1, most.bit_length()), len(sizes)), np.uint64)
    left = len(sizes) - np.searchsorted(sizes[::-1], np.arange(most), side="right")  # arrays with more than k hashes
    for k in range(most):
        m = int(left[k])
        carry = every[starts[:m] + k]
        for p in range((k + 1).bit_length()):
            word = slices[p, :m]
            both = word & carry
            word ^= carry
            carry = both
    out = np.zeros((len(sizes), BITS), np.int64)
    for p in range(len(slices)):
        out[order] += np.unpackbits(slices[p].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64) << p
    return out


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return digests_as_hashes([digest(joined, SEED)])
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    return digests_as_hashes([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and the SimHash of the text's word shingles as a signed long (fp);
    lower case for A-Z, words between white space, a text of fewer words is one
    shingle, one without words has 0."""

    def run(batches):
        for b in small(batches, 128):
            ids, texts = b.column(0), b.column(1).to_pylist()
            fps = signatures([shingle_hashes(t, size) for t in texts])
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        trimmed()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@cache
def blocks_for(n: int, radius: int) -> int:
    """How many blocks make the least work for n fingerprints: more blocks give
    more copies of each, but longer keys and so smaller shards."""

    def work(b: int) -> float:
        return comb(b, radius) * (40 * n + n * n / 2 ** (BITS * (b - radius) / b))

    return min(range(radius + 1, radius + 6), key=work)


def masks(blocks: int, radius: int) -> list[int]:
    """For each choice of ``radius`` blocks: the bits of the others, signed."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    every = [sum(whole) ^ sum(whole[i] for i in out) for out in combinations(range(blocks), radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in every]


def in_cells(rows: DataFrame, ident: str, *key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (ident, *more, *key, a, b): a key of more than TREE rows is split into trees, and
    each of its rows meets every tree of it, in cells of about 2 * TREE rows."""
    full = cut(rows.groupBy(*key).count().filter(F.col("count") > TREE))
    if full.count() <= FEW_FULL:
        full = F.broadcast(full)
    trees = F.coalesce(F.ceil(F.col("count") / TREE), F.lit(1)).cast("int")
    tree: Column = F.pmod(F.xxhash64(ident, key[0], *more), F.col("trees")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("trees") - 1), lambda t: (t != F.col("tree")) | (F.col("trees") == 1))
    return (
        rows.join(full, list(key), "left").withColumn("trees", trees).withColumn("tree", tree)
        .withColumn("other", F.explode(others))
        .select(ident, *more, *key, F.least("tree", "other").alias("a"), F.greatest("tree", "other").alias("b"))
    )


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def finer(mask: int, radius: int) -> list[int]:
    """The mask with one of radius + 1 parts of its other bits each: fingerprints that agree under it and differ in
    ``radius`` bits or fewer agree under one of these as well."""
    other = [b for b in range(BITS) if not mask >> b & 1]
    edges = [len(other) * i // (radius + 1) for i in range(radius + 2)]
    return [_signed((mask & ((1 << BITS) - 1)) | sum(1 << b for b in other[lo:hi])) for lo, hi in zip(edges, edges[1:], strict=False)]


def _split_by_content(sharded: DataFrame, every: list[int], radius: int) -> DataFrame:
    """Rows (fp, ..., shard, key), those of a key of more than TREE fingerprints under finer masks instead: radius + 1
    rows for each, of keys that a part of the other bits tells apart."""
    full = cut(sharded.groupBy("shard", "key").count().filter(F.col("count") > TREE).select("shard", "key", F.lit(True).alias("full")))
    n = full.count()
    if not n:
        return sharded
    more = [c for c in sharded.columns if c not in ("shard", "key")]
    parts = F.array(*[F.array(*[F.lit(m) for m in finer(mask, radius)]) for mask in every])
    one = lambda shard, key: F.struct(shard.cast("int").alias("shard"), key.alias("key"))
    wide = radius + 2
    split = F.transform(F.get(parts, F.col("shard")), lambda m, j: one(F.col("shard") * wide + j + 1, F.col("fp").bitwiseAND(m)))
    rows = sharded.join(F.broadcast(full) if n <= FEW_FULL else full, ["shard", "key"], "left")
    return rows.select(*more, F.inline(F.when(F.col("full"), split).otherwise(F.array(one(F.col("shard") * wide, F.col("key"))))))


def cells(fps: DataFrame, radius: int, n: int, *more: str) -> DataFrame:
    """Rows (fp, shard, key, a, b) and the columns ``more``: fp with its cells.  All
    fingerprints within the radius share a cell, of about 2 * TREE rows."""
    every = masks(blocks_for(n, radius), radius)
    sharded = fps.select("fp", *more, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in every])).alias("shard", "key"))
    return in_cells(_split_by_content(sharded, every, radius), "fp", "shard", "key", more=more)


def grouped(batches, key_columns: int):
    """Runs of rows with equal key (the last columns), over batches that come sorted by it."""
    return (group for _, group in grouped_with_key(batches, key_columns))


def grouped_with_key(batches, key_columns: int):
    """As ``grouped``, each run with its key."""
    held, held_key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) else c.to_pylist() for c in b.columns]
        keys = columns[-key_columns:]
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            key = tuple(k[lo] for k in keys)
            part = [c[lo:hi] for c in columns[:-key_columns]]
            if key == held_key:
                held.append(part)
            else:
                if held:
                    yield held_key, held
                held, held_key = [part], key
    if held:
        yield held_key, held


def near_links(fps: DataFrame, radius: int, n: int) -> DataFrame:
    """Links (u, v) of distinct fingerprints (column fp, n of them) whose
    connected components are those of all pairs within the radius."""

    def run(batches):
        us, vs = [], []
        for group in grouped(batches, 4):
            values = np.concatenate([p[0] for p in group])
            if len(values) > 1:
                for x, root in forest(values, radius):
                    us.append(x)
                    vs.append(root)
            if len(us) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    key = ["shard", "key", "a", "b"]
    return cells(fps, radius, n).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long")


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(value, smallest value linked to it) for the values that have a link."""
    values = np.unique(values)
    tree, sets = BKTree(), Forest(len(values))
    for i, value in enumerate(values.tolist()):
        unsigned = value & ((1 << BITS) - 1)
        for j in tree.within(unsigned, radius):
            sets.join(i, j)
        tree.add(unsigned)
    listed = values.tolist()
    return [(listed[i], listed[r]) for i in range(len(listed)) if (r := sets.root(i)) != i]


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in ``radius`` bits or less are linked;
    component_id is the smallest doc_id that links lead to.  A null text has no
    words and so fingerprint 0, linked like any other; repeated rows give
    repeated results; an empty table gives an empty one; columns other than
    doc_id and text are ignored.
    """
    own = cut(fingerprints(docs, size))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = near_links(nodes.select("fp"), radius, nodes.count())
    roots = components(links)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(named.join(least, "root").select("fp", "component_id"))
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by set similarity.  BK-trees over the SimHash of each text's
# shingle set propose the closest pairs, which are verified on the sets.  Two
# texts that share four fifths of their shingles differ in some ten bits of 64,
# too many for blocks of bits, so what the trees leave apart meets in bands of
# MinHash values as well, and every pair there is verified.

#: bits in which fingerprints of near copies that the trees propose may differ
NEAR_BITS = 4
#: bands of ROWS MinHash values each: texts with a similarity of 0.8 share a band
#: with probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997, with 0.9 but for 3e-5
BANDS, ROWS = 8, 3
_SPREAD = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(BANDS * ROWS)], np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS numbers of a shingle set, equal with the chance that ROWS MinHash values are."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    least = np.array([((h := hashes * m) ^ (h >> np.uint64(32))).min() for m in _SPREAD]).reshape(BANDS, ROWS)
    out = least[:, 0]
    for i in range(1, ROWS):
        out = (out ^ (out >> np.uint64(29))) * _SPREAD[i] + least[:, i]
    return out.view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, same (a 128-bit digest of the shingle set), size of the set, its SimHash (fp), and bands."""

    def run(batches):
        for b in small(batches, 128):
            ids, texts = b.column(0), b.column(1).to_pylist()
            sets = [np.unique(shingle_hashes(t, size)) for t in texts]
            same = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(signatures(sets).view(np.int64)), pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "same", "size", "fp", "bands"],
            )
        trimmed()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, same binary, size long, fp long, bands array<long>")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return both / max(1, len(a) + len(b) - both)


def shared_cells(rows: DataFrame, ident: str, *more: str) -> DataFrame:
    """Rows (ident, *more, shard, key, a, b): the rows with (shard, key) that others share, in
    cells of about 2 * TREE rows, as ``cells`` deals those that blocks make."""
    counts = rows.groupBy("shard", "key").count().filter("count > 1")
    trees = F.ceil(F.col("count") / TREE).cast("int")
    tree = F.pmod(F.xxhash64(ident, "shard"), F.col("trees")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("trees") - 1), lambda t: (t != F.col("tree")) | (F.col("trees") == 1))
    return (
        rows.join(counts, ["shard", "key"]).withColumn("trees", trees).withColumn("tree", tree)
        .withColumn("other", F.explode(others))
        .select(ident, *more, "shard", "key", F.least("tree", "other").alias("a"), F.greatest("tree", "other").alias("b"))
    )


def _band_cells(rows: DataFrame, *more: str) -> DataFrame:
    """Cells of the shards that bands make."""
    return shared_cells(rows.select("doc_id", *more, F.posexplode("bands").alias("shard", "key")), "doc_id", *more)


def near_pairs(single: DataFrame, radius: int = NEAR_BITS) -> DataFrame:
    """Pairs (doc_id, other) of documents (doc_id, fp), no doc_id twice, that lead to all whose fingerprints are within
    the radius, by BK-trees: one of each fingerprint with one of those linked to it, the others with that one."""
    nodes = cut(single.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = near_links(nodes.select("fp"), radius, nodes.count()).distinct()
    of_u, of_v = (nodes.select(F.col("fp").alias(e), F.col("first").alias(d)) for e, d in (("u", "doc_id"), ("v", "other")))
    near = links.join(of_u, "u").join(of_v, "v").select("doc_id", "other")
    same = single.join(nodes, "fp").select("doc_id", F.col("first").alias("other")).filter("doc_id <> other")
    return near.unionByName(same)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (u, v): the pairs (doc_id, other) whose sets (doc_id, set) have a similarity of ``least`` or more.
    The set of a document in many pairs goes to several tasks."""

    def run(batches):
        for b in small(batches, 128):
            us, vs, xs, ys = (b.column(i) for i in range(4))
            near = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([us, vs], names=["u", "v"]).filter(pa.array(near, pa.bool_()))
        trimmed()

    parts = pairs.groupBy("other").agg(F.ceil(F.count("*") / TREE).cast("int").alias("parts"))
    dealt = pairs.join(parts, "other").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    ends = parts.join(sets.select(F.col("doc_id").alias("other"), F.col("set").alias("their")), "other")
    ends = ends.select("other", "their", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = dealt.join(sets.select("doc_id", "set"), "doc_id").join(ends, ["other", "part"])
    return met.select("doc_id", "other", "set", "their").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id of the documents that have a copy or near copy.

    Links join texts with equal shingle sets, and texts whose sets have a
    Jaccard similarity of ``least`` or more, as verified on the whole sets;
    pairs meet in BK-trees of fingerprints, others in the shards that bands make.
    component_id is the smallest doc_id that links lead to.  Rows with a null
    doc_id take no part; a null text has no shingles.
    """
    own = cut(sketches(docs.filter("doc_id is not null"), size))
    groups = cut(own.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    of_one = own.join(groups.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    single = cut(of_one.select("doc_id", "size", "fp", "bands"))
    pairs = cut(near_pairs(single.select("doc_id", "fp")))
    key = ["shard", "key", "a", "b"]

    def meet(batches):
        for group in grouped(batches, 4):
            ids, sizes = np.concatenate([p[0] for p in group]), np.concatenate([p[1] for p in group])
            order = np.argsort(sizes, kind="stable")
            sizes = sizes[order]
            near = np.zeros(len(ids), bool)
            # the closest in size decide
            near[1:] = sizes[:-1] >= least * sizes[1:]
            near[:-1] |= near[1:]
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[order[near]])], names=["doc_id"])

    def dealt(rows):
        return rows.repartition(*key).sortWithinPartitions(*key)

    candidates = dealt(_band_cells(single.drop("fp"), "size")).mapInArrow(meet, "doc_id long")
    candidates = cut(candidates.union(pairs.select("doc_id")).union(pairs.select("other")).distinct())

    def sets(batches):
        for b in small(batches, 128):
            ids, keys, texts = (b.column(i) for i in range(3))
            data = [np.unique(shingle_hashes(t, size)).tobytes() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(data, pa.binary())], names=["doc_id", "bands", "set"])
        trimmed()

    texts = docs.select("doc_id", "text").join(candidates, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    full = single.join(texts, "doc_id").select("doc_id", "bands", "text")
    full = written(full.mapInArrow(sets, "doc_id long, bands array<long>, set binary"))
    rows = full.select("doc_id", F.posexplode("bands").alias("shard", "key"))
    met = cut(rows.join(rows.groupBy("shard", "key").count().filter("count > 1").drop("count"), ["shard", "key"]))

    def link(batches):
        for group in grouped(batches, 4):
            ids = np.concatenate([p[0] for p in group])
            data = [np.frombuffer(x, np.uint64) for p in group for x in p[1]]
            keys = np.array([k for p in group for k in p[2]])
            known = np.concatenate([p[3] for p in group])
            shard = int(group[0][4][0])
            order = np.argsort(ids, kind="stable")
            data, keys, known = [data[at] for at in order], keys[order], known[order]
            sizes, forest = np.array([len(x) for x in data]), Forest(len(order))
            for i in range(1, len(order)):
                before = sizes[:i]
                fits = (before >= least * sizes[i]) & (sizes[i] >= least * before) & (known[:i] != known[i])
                if shard >= 0:
                    fits &= ~(keys[:i, :shard] == keys[i, :shard]).any(1)  # those are for an earlier shard
                for j in np.flatnonzero(fits).tolist():
                    if forest.root(i) != forest.root(j) and similarity(data[i], data[j]) >= least:
                        forest.join(i, j)
            found = [(ids[order[i]], ids[order[r]]) for i in range(len(order)) if (r := forest.root(i)) != i]
            if found:
                us, vs = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        trimmed()

    def linked(rows):
        """Links among the documents of each cell (doc_id, root, s, shard, key, a, b)."""
        sent = rows.join(full, "doc_id").select("doc_id", "set", "bands", "root", "s", *key)
        return dealt(sent).mapInArrow(link, "u long, v long")

    proposed = cut(verified(pairs, full, least))
    close = cut(components(proposed).withColumnRenamed("node", "doc_id"))
    # near copies share most bands, so each document is first sent to two cells, to one part of a large one, where it meets
    # those that the trees have not linked with it; after that only bands whose documents are of several groups are read, whole, and pairs of different groups compared
    place = F.struct("shard", "key")
    ends = met.groupBy("doc_id").agg(F.array_distinct(F.array(F.min(place), F.max(place))).alias("e")).select("doc_id", F.explode("e").alias("e")).select("doc_id", "e.*")
    counts = ends.groupBy("shard", "key").agg(F.ceil(F.count("*") / TREE).cast("int").alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")
    ends = ends.join(close, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    first = ends.join(counts, ["shard", "key"], "left").select("doc_id", "root", F.lit(-1).alias("s"), "shard", "key", part.alias("a"), part.alias("b"))
    some = cut(components(linked(first).union(proposed)))
    rooted = met.join(some.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    open_keys = rooted.groupBy("shard", "key").agg((F.min("root") != F.max("root")).alias("open")).filter("open").drop("open")
    rest = cut(rooted.join(open_keys, ["shard", "key"], "left_semi").select("doc_id", "root", "shard", "key"))
    more = linked(in_cells(rest, "doc_id", "shard", "key", more=("root",)).withColumn("s", F.col("shard")))
    roots = components(more.union(some.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    named = groups.join(roots, groups["first"] == roots["node"], "left").select("same", "n", F.coalesce("root", "first").alias("component_id"))
    named = cut(named.filter("n > 1").union(named.join(roots.select("root"), F.col("component_id") == F.col("root"), "left_semi")).distinct())
    return own.join(named, "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without the copies and near copies of a document with a smaller
    doc_id.  Of rows that repeat a doc_id all stay if one does."""
    gone = cut(near_copies(docs, size, least).filter("doc_id <> component_id").select("doc_id"))
    return docs.alias("d").join(gone.alias("x"), F.col("d.doc_id") == F.col("x.doc_id"), "left_anti").select("d.*")
