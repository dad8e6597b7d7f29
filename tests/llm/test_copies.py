"""Exact and near copies, repeated lines and passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import awkward, table

from arcloom.llm import common, exact_dedup, line_dedup, simhash, suffix_dedup
from arcloom.llm.common import components


class Sets(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)


@pytest.mark.parametrize("few", [common.FEW_EDGES, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    sets = Sets()
    for u, v in edges:
        sets.join(u, v)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: sets.root(x) for x in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def simhash_by_hand(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rows = [r for r in awkward() if r[0] is not None] + [(100 + i, "w%d x y z" % i) for i in range(60)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    fps = {d: simhash_by_hand(t) for d, t in rows}
    sets = Sets()
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                sets.join(a, b)
    assert got == {d: (f"{f:016x}", sets.root(d)) for d, f in fps.items()}
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.near_duplicates(table(spark, [(None, "a"), (None, None)])).count() == 2


def test_bk_tree_and_split_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 7)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(25)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, len(fps))
    got = {r.node: r.root for r in components(links).collect()}
    sets = Sets()
    for a in signed:
        for b in signed:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                sets.join(a, b)
    assert got == {f: sets.root(f) for f in signed if any(sets.root(f) == sets.root(g) for g in signed if g != f)}
    tree = simhash.BKTree()
    for f in fps:
        tree.add(f)
    some = next(iter(fps))
    assert {tree.values[i] for i in tree.within(some, 9)} == {f for f in fps if (f ^ some).bit_count() <= 9}


def test_near_copies(spark):
    rng = random.Random(4)
    rows = awkward()
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    for i in range(12):
        words = list(base)
        for _ in range(i):
            words[rng.randrange(200)] = f"new{rng.randrange(1000)}"
        rows.append((200 + i, " ".join(words)))
    rows = [r for r in rows if r[0] is not None]
    sets, shingles = Sets(), {d: frozenset(simhash.shingle_hashes(t, 5).tolist()) for d, t in rows}
    for a, x in shingles.items():
        for b, y in shingles.items():
            if x == y or (len(x & y) >= 0.8 * len(x | y)):
                sets.join(a, b)
    docs = table(spark, [*rows, (None, "left alone")])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert {d: got.get(d, d) for d in shingles} == {d: sets.root(d) for d in shingles}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _ in rows if sets.root(d) == d)
    assert simhash.keep_one(table(spark, [])).count() == 0


def test_near_copies_meet_in_trees(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    rows = [(i, " ".join([*base[:300], f"new{i}", *base[301:]])) for i in range(8)] + [(20 + i, f"alone {i} " * 9) for i in range(3)]
    rows += [(30, "one two three four five"), (31, "six seven eight nine ten")]
    # no band proposes a document
    monkeypatch.setattr(simhash, "_band_cells", lambda single, *more: simhash.shared_cells(single.selectExpr("doc_id", *more, "0 as shard", "doc_id as key"), "doc_id", *more))
    single = simhash.sketches(table(spark, rows), 5)
    pairs = simhash.near_pairs(single.select("doc_id", "fp"))
    assert {d for r in pairs.collect() for d in r} >= set(range(8))
    assert pairs.filter("doc_id >= 20 and other < 20").count() == 0
    met = []
    monkeypatch.setattr(simhash, "near_links", lambda *a, _own=simhash.near_links: met.append(a) or _own(*a))
    kept = simhash.keep_one(table(spark, rows))
    assert met and sorted(r.doc_id for r in kept.collect()) == [0, 20, 21, 22, 30, 31]


def test_exact_copies(spark):
    rows = awkward() + [(40, "o n e"), (41, "x" * 5000 + ". y"), (42, "x" * 5000 + ".y")]
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(table(spark, rows)).collect())
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), -1 if d is None else d))
    want = []
    for d, t in rows:
        best = min(groups[norm(t)])
        want.append((d or -1, best[1], len(groups[norm(t)]), (-len(t or ""), -1 if d is None else d) == best, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert got == sorted(want)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_exact_copies_when_identifiers_clash(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MOST_CLASHES", most)
    real = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(exact_dedup.F.lit(1)))
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(table(spark, [(1, "ab"), (2, "cd"), (3, "a b"), (4, "cd")])).collect()}
    assert got == {1: 3, 2: 2, 3: 3, 4: 2}


def covered(rows):
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    out = {}
    for d, t in rows:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                m[i : i + 50] = True
        out[d] = m
    return out


def test_repeated_passages(spark):
    rows = [r for r in awkward() if r[0] is not None]
    texts = [(d, (t or "").encode()) for d, t in rows]
    masks = covered(texts)
    want = []
    for d, t in texts:
        m = masks[d]
        edge = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        want.append((d, len(t), int(m.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()))
    docs = table(spark, [*rows, (None, "x" * 100)])
    got = sorted(tuple(r) for r in suffix_dedup.removal_digests(docs).collect() if r.doc_id is not None)
    assert got == sorted(want)
    made = suffix_dedup.remove_repeats(docs)
    assert made.columns == docs.columns
    by_id = {r.doc_id: r.text for r in made.collect()}
    assert by_id[5] == "" and by_id[14] == " tail" and by_id[None] == "x" * 100 and by_id[1] is None
    assert suffix_dedup.removal_digests(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_passages_at_random(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"ab", b"abcdefgh ", b"a"])
    base = bytes(rng.choice(letters) for _ in range(rng.randrange(400)))
    rows = []
    for d in range(rng.randrange(1, 9)):
        t = b""
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(base) + 1)
            t += base[i : rng.randrange(i, len(base) + 1)] + bytes(rng.choice(letters) for _ in range(rng.randrange(40)))
        rows.append((rng.randrange(50) * 10 + d, t))
    want, got = covered(rows), {d: np.zeros(len(t), bool) for d, t in rows}
    for bucket in range(2):
        parts = [suffix_dedup.local_records([d for d, _ in rows[k::3]], [t for _, t in rows[k::3]], bucket, 2) for k in range(3)]
        for spans in [s for _, s in parts] + [suffix_dedup.repeats(np.concatenate([r for r, _ in parts]))]:
            for x in spans:
                got[x["doc"]][x["lo"] : x["hi"]] = True
    assert all((want[d] == got[d]).all() for d, _ in rows)


def test_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BITS", 9)
    rng = random.Random(9)
    a = bytes(rng.choice(b"abcdefgh") for _ in range(3000))
    rows = [(1, a), (2, a[700:1900] + b"zz" + a[10:130])]
    want, got = covered(rows), {d: np.zeros(len(t), bool) for d, t in rows}
    records, spans = suffix_dedup.local_records([1, 2], [t for _, t in rows], 0, 1)
    for x in np.concatenate([spans, suffix_dedup.repeats(records)]):
        got[x["doc"]][x["lo"] : x["hi"]] = True
    assert all((want[d] == got[d]).all() for d in want)


def test_distance():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert line_dedup.distance(a, b) == row[-1]


def test_lines(spark):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 4] + [(4, awkward()[3][1])]
    occurrences = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            norm = line_dedup.normalised(line)
            if norm:
                occurrences.setdefault(norm, []).append((d, i))
    lines = sorted(occurrences)
    sets = Sets()
    for a in lines:
        for b in lines:
            if line_dedup.similar(a, b, line_dedup.SIMILARITY):
                sets.join(a, b)
    keep = {}
    for line in lines:
        root = sets.root(line)
        keep[root] = min(keep.get(root, (10**9, 0)), min(occurrences[line]))
    docs = table(spark, [*rows, (None, "left alone")])
    got = {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()}
    for d, t in rows:
        own = t.split("\n") if t else []
        left = [x for i, x in enumerate(own) if not (n := line_dedup.normalised(x)) or keep[sets.root(n)] == (d, i)]
        assert got[d] == (t if t is None or len(left) == len(own) else "\n".join(left)), d
    counts = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_digests(docs).collect()}
    assert counts[10] == (3, 1) and counts[1] == (0, 0)
    assert line_dedup.remove_lines(table(spark, [])).count() == 0


def _covered_by(spans):
    """doc -> bytes that spans of suffix_dedup cover."""
    out = {}
    for s in spans:
        out.setdefault(int(s["doc"]), set()).update(range(int(s["lo"]), int(s["hi"])))
    return out


def _one_anchor_in_many_contexts(n):
    """Texts around one string of twenty bytes whose hash is least of all, found by trial; a third of them repeat."""
    rng = random.Random(23)
    letters = b"abcdefghijklmnopqrstuvwxyz "
    noise = lambda k: bytes(rng.choice(letters) for _ in range(k))
    best = None
    for _ in range(40):
        text = np.frombuffer(noise(2000), np.uint8)
        found = suffix_dedup.anchors(text, np.array([2000]), 0, 1)
        row = found[np.argmin(found["key"])]
        if best is None or row["key"] < best[0]:
            best = row["key"], bytes(row["row"][suffix_dedup.REACH : suffix_dedup.REACH + suffix_dedup.GRAM])
    texts = [noise(40) + best[1] + noise(40) for _ in range(n - n // 3)]
    texts += [noise(rng.randrange(9)) + rng.choice(texts)[rng.randrange(25) :] + noise(5) for _ in range(n // 3)]
    return texts


def test_records_of_an_anchor_told_apart_by_content():
    """Dealt by the bytes beside the anchor, or window by window, the same bytes are repeats; keys become small."""
    texts = _one_anchor_in_many_contexts(900)
    records, spans = suffix_dedup.local_records(list(range(len(texts))), texts, 0, 1)
    want = _covered_by(suffix_dedup.repeats(records))
    assert sum(map(len, want.values())) > 1000
    sides = suffix_dedup.by_sides(records)
    assert np.unique(records["key"], return_counts=True)[1].max() > 500 > 50 > np.unique(sides["key"], return_counts=True)[1].max()
    for finer in (sides, suffix_dedup.by_window(sides)):
        found = np.concatenate([suffix_dedup.repeats(finer[finer["key"] % 5 == k]) for k in range(5)])  # keys by themselves
        assert _covered_by(found) == want


@pytest.mark.parametrize("held", [300, 20])
def test_repeats_of_a_hot_anchor(spark, monkeypatch, held):
    """One anchor in far more contexts than a task may hold: records go on by content, twice where that must be."""
    monkeypatch.setattr(suffix_dedup, "HELD_RECORDS", held)
    texts = _one_anchor_in_many_contexts(1500)
    rows = [(d, t.decode()) for d, t in enumerate(texts)]
    masks = covered([(d, t) for d, t in enumerate(texts)])
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removal_digests(table(spark, rows).repartition(6)).collect()}
    assert got == {d: int(m.sum()) for d, m in masks.items()} and sum(got.values()) > 1000


def test_segments_of_short_lines_are_complete():
    rng = random.Random(6)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 46))) for _ in range(500)]
    for line in lines[:250]:
        near = list(line)
        for _ in range(rng.randrange(1, 9)):
            at = rng.randrange(len(near) + 1)
            near[at : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        lines.append("".join(near))
    lines = sorted({x for x in lines if x})
    keys = [line_dedup.segment_keys(x) for x in lines]
    found = 0
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if min(len(a), len(b)) < line_dedup.SHORT and line_dedup.similar(a, b, 0.8):
                found += 1
                assert keys[i] & keys[j], (a, b)
    assert found > 50


def test_distance_up_to_a_limit():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(20))) for _ in range(2))
        whole, limit = line_dedup.distance(a, b), rng.randrange(12)
        got = line_dedup.distance(a, b, limit)
        assert got == whole or min(got, whole) > limit


def test_lines_with_one_word_altered(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8)))
    base, near = [], []
    for size in (6, 8, 12, 20, 50):
        for _ in range(60):
            words = [word() for _ in range(size)]
            at = rng.randrange(size)
            other = [*words[:at], word(), *words[at + 1 :]]
            if line_dedup.similar(" ".join(words), " ".join(other), 0.8):
                base.append(" ".join(words))
                near.append(" ".join(other))
    docs = table(spark, [(1, "\n".join(base)), (2, "\n".join(near)), (3, "alone in this table")])
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_digests(docs).collect()}
    assert got[1] == (len(base), 0) and got[3] == (1, 0)
    assert got[2][1] >= 0.97 * len(near)


def test_near_copies_that_repeat_a_phrase(spark):
    rng = random.Random(10)
    rows, want = [], {}
    for i in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + words[:5] * 60))]
        a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows[-2:])
        assert len(a & b) >= 0.8 * len(a | b)
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    assert {r.doc_id: r.component_id for r in simhash.near_copies(table(spark, rows)).collect()} == want


def test_recall_of_line_keys_against_all_pairs():
    """Of all pairs of the small table's lines with an edit similarity of 0.8, the share that has a key in common."""
    pq = pytest.importorskip("pyarrow.parquet")
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = sorted({n for t in texts for x in (t or "").split("\n") if (n := line_dedup.normalised(x))}, key=len)
    sizes = np.array([len(x) for x in lines])
    counts = line_dedup.pair_counts(lines)
    keys = [set((k >> line_dedup.SIZE_BITS).tolist()) for k in line_dedup.sized_keys(lines, 0.8)]
    pairs = met = 0
    for i in range(len(lines)):
        stop = np.searchsorted(sizes, sizes[i] / 0.8 + 1e-9, side="right")
        apart = np.abs(counts[i + 1 : stop] - counts[i]).sum(1)
        for j in (i + 1 + np.flatnonzero(apart <= 0.8 * sizes[i + 1 : stop] + 1e-9)).tolist():
            if line_dedup.similar(lines[i], lines[j], 0.8):
                pairs += 1
                met += bool(keys[i] & keys[j])
    assert pairs > 30 and met >= 0.9 * pairs, (pairs, met)


def _recall(pairs):
    similar = [(a, b) for a, b in pairs if line_dedup.similar(a, b, 0.8)]
    keys = [[set((k >> line_dedup.SIZE_BITS).tolist()) for k in line_dedup.sized_keys(list(p), 0.8)] for p in similar]
    return len(similar), sum(bool(a & b) for a, b in keys) / len(similar)


def test_recall_of_lines_that_differ_in_numbers_dates_and_scattered_characters():
    rng = random.Random(17)
    n = rng.randrange
    month = lambda: rng.choice("january february march april may june july august september october november december".split())
    templates = [
        lambda: f"2024-{n(1, 13):02}-{n(1, 29):02} {n(24):02}:{n(60):02}:{n(60):02} info server request {n(10**6)} served from the cache in {n(1000)} ms for the user {n(10**4)}",
        lambda: f"page {n(1, 400)} of {n(1, 400)} - last updated on {n(1, 29)} {month()} {n(1990, 2025)} at {n(24)}:{n(60):02} - printed copy number {n(1000)}",
        lambda: f"the price of this product is {n(1000)}.{n(100):02} euro including {n(30)} percent tax and shipping of {n(20)}.{n(100):02} euro",
    ]
    for make in templates:
        met, share = _recall([(make(), make()) for _ in range(400)])
        assert met > 20 and share >= 0.95, share
    syllables = "the and tion ing re ha er ou en st sh wh ble ly or at in on ed es".split()
    for size, edits in ((50, 2), (90, 3), (150, 4), (300, 8)):
        pairs = []
        for _ in range(200):
            a = " ".join("".join(rng.choice(syllables) for _ in range(n(1, 4))) for _ in range(size))[:size].strip()
            b = list(a)
            for _ in range(edits):
                b[n(len(b))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            pairs.append((a, "".join(b)))
        assert _recall(pairs)[1] >= 0.85, (size, edits)


@pytest.mark.parametrize("tree", [1000, 4])
def test_lines_of_hot_keys_in_parts(spark, monkeypatch, tree):
    """Many lines under the same keys, of several groups: all that is similar is in one group, whatever the parts."""
    monkeypatch.setattr(line_dedup, "TREE", tree)
    monkeypatch.setattr(simhash, "TREE", tree)
    lines = [f"this notice was printed on the {i} day of the year number {i * 7919} for all the readers of it" for i in range(40)]
    lines += [f"{w} other line that stands for nothing more than the word that it starts with" for w in ("some", "same", "sane")]
    docs = table(spark, [(i, line) for i, line in enumerate(lines)])
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_digests(docs).collect()}
    assert [i for i, n in got.items() if not n] == [0, 40]


def _short_lines():
    rng = random.Random(23)
    lines = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(2, 50))) for _ in range(150)]
    for line in lines[:150]:
        near = list(line)
        for _ in range(rng.randrange(1, 10)):
            at = rng.randrange(len(near) + 1)
            near[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        lines.append("".join(near))
    return sorted({n for x in lines if (n := line_dedup.normalised(x))})


@pytest.mark.parametrize("across", [False, True])
def test_short_lines_are_compared_with_all(across):
    lines = _short_lines()
    ids, sides = [line_dedup.digest(x) for x in lines], [k % 2 if across else 0 for k in range(len(lines))]
    want, got = Sets(), Sets()
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            told = min(len(a), len(b)) < line_dedup.SHORT or len(a) == len(b)
            if told and (not across or sides[i] != sides[j]) and line_dedup.similar(a, b, 0.8):
                want.join(ids[i], ids[j])
    for i, j in line_dedup.similar_short(ids, lines, sides, 0.8):
        got.join(i, j)
    assert [got.root(i) for i in ids] == [want.root(i) for i in ids]
    assert len({want.root(i) for i in ids}) < len(ids) - 50


def test_short_lines_in_blocks_and_by_segments(spark, monkeypatch):
    """The same groups, whatever the blocks, with segments instead, and with parts of keys that are sent on as they are read."""
    lines = _short_lines()
    more = [f"{x} and what makes a longer line of it {n} with words of its own" for n, x in enumerate(lines[::7])]
    docs = table(spark, [(i, "\n".join(part)) for i, part in enumerate((lines[::2], lines[1::2], more, more[::3]))])
    # a short line asks nothing of the keys that lines meet by, which all short lines share with many that are unlike
    made = line_dedup.line_table(docs, 0.8)
    assert made.filter("length(short) < 40").selectExpr("sum(size(keys_0) + size(keys_1) + size(keys_2) + size(keys_3))").first()[0] == 0
    got = []
    for changed in ({"BLOCK": 16}, {"MANY_SHORT": 0, "DEALT": 20}):
        for name, value in changed.items():
            monkeypatch.setattr(line_dedup, name, value)
        got.append(sum(r.n_dropped for r in line_dedup.line_digests(docs).collect()))
    # segments miss pairs of longer lines only
    assert got[0] >= got[1] > 50


def test_distance_that_is_given_up_early():
    rng = random.Random(29)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(60, 260)))
        b = list(a)
        for _ in range(rng.randrange(len(a))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choice(["", "x", "yz"])
        b = "".join(b)
        whole = line_dedup.distance(a, b, near=False)
        for limit in (whole - 1, whole, whole // 2, 0.2 * len(a)):
            got = line_dedup.distance(a, b, limit, near=False)
            assert got == whole if whole <= limit else got > limit


def test_a_discarded_table_leaves_no_files(spark):
    import os

    made = common.written(spark.range(10))
    place = made.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(place)
    common.discard(made)
    assert not os.path.exists(place)


def test_few_edits_and_sets_of_lines(monkeypatch):
    rng = random.Random(12)
    lines = []
    for _ in range(25):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randrange(20, 90)))
        for _ in range(6):
            near = list(base)
            for _ in range(rng.randrange(8)):
                near[rng.randrange(len(near))] = rng.choice("xyz")
            lines.append("".join(near))
    lines = sorted(set(lines))
    ids = [line_dedup.digest(x) for x in lines]
    sets = Sets()
    for i, a in zip(ids, lines, strict=True):
        for j, b in zip(ids, lines, strict=True):
            if line_dedup.similar(a, b, 0.8):
                sets.join(i, j)
    want = {i: sets.root(i) for i in ids if sets.root(i) != i}
    assert dict(line_dedup.similar_sets(ids, lines, 0.8)) == want
    monkeypatch.setattr(line_dedup, "SIDE_BY_SIDE", 1)
    assert dict(line_dedup.similar_sets(ids, lines, 0.8)) == want
    for a, b in zip(lines, lines[1:], strict=False):
        assert line_dedup.edits_at_most(a, b, 1000) >= line_dedup.distance(a, b)


def test_distances_side_by_side():
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 5, 63, 64, 65, 130, 200]))) for _ in range(40)]
    texts += [t[:10] + "x" + t[12:] for t in texts[:20]]
    left = np.array([rng.randrange(60) for _ in range(300)])
    right = np.array([rng.randrange(60) for _ in range(300)])
    assert line_dedup.distances(texts, left, right).tolist() == [line_dedup.distance(texts[i], texts[j]) for i, j in zip(left, right, strict=True)]


def test_passages_in_rows_that_share_a_doc_id(spark):
    """Spans of a row are not applied to another text with the same doc_id."""
    passage = "".join(random.Random(31).choice("abcdefgh ") for _ in range(90))
    rows = [(1, "first " + passage), (5, passage + " of the one"), (5, "quite another text, as long as the passage is, that nobody else has, from end to end of it all"), (5, passage + " of the one")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.removal_digests(table(spark, rows)).collect())
    assert got == sorted([(1, 96, 0), (5, 101, 90), (5, len(rows[2][1]), 0), (5, 101, 90)])


def test_a_bucket_of_one_passage(spark, monkeypatch):
    """Records beyond what a bucket holds are brought down to one of each content."""
    rng = random.Random(32)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(80))) + passage) for i in range(40)]
    want = {d: int(m.sum()) for d, m in covered([(d, t.encode()) for d, t in rows]).items()}
    batches = [suffix_dedup.local_records([d], [t.encode()], 0, 1)[0] for d, t in rows]
    held, spans = batches[0], []
    for b in batches[1:]:
        held, found = suffix_dedup.fewer(np.concatenate([held, b]))
        spans.append(found)
    assert len(held) < sum(map(len, batches)) / 2
    spans = np.concatenate([*spans, suffix_dedup.repeats(held)])
    got = {}
    for d, t in rows:
        m = np.zeros(len(t), bool)
        for x in spans[spans["doc"] == d]:
            m[x["lo"] : x["hi"]] = True
        got[d] = int(m.sum())
    assert got == want
