"""Prefix trie and repair of conversations against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from arcloom.llm import conversation_repair, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, sig string, depth string, n string, conv string, a string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def awkward(seed=0, convs=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "", " \t", None, "and so", "why?", "Ünï 日本 🤗.", "end. \n", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "user", "assistant", "tool", None, "", "alien"]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t * rng.choice([1, 1, 1, 3]), rng.choice(roles), rng.choice(texts)))
    rows += [(100, t, ["user", "assistant"][t % 2], "Same.") for t in range(40)] + [(201, t, ["user", "assistant"][t % 2], "Same.") for t in range(37)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"Copy {t}.") for c in range(300, 330) for t in range(4)]
    rows += [(400, None, "user", "No turn."), (400, None, "user", "No turn."), (400, None, "assistant", "None."), (None, 1, "user", "Nobody."), (None, 2, "assistant", "x")]
    return rows + rows[:3]


def by_conversation(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn, role, text))
    return convs


def trie_by_hand(rows):
    own = {}
    for c, turns in by_conversation(rows).items():
        if c is not None:
            lane = sorted(((t is not None, t or 0), r or "", x or "") for t, r, x in turns)
            own[c] = [(r, x) for _, r, x in lane]
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].add(c)
        ends[tuple(full)].add(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = sum(saved[k] for k in children[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (min(members[p]), len(p), min(members[p[:-1]]) if p else -1, len(members[p]), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p in members
    )


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("shallow, most, ids", [(8, 20_000, 65_536), (2, 3, 7), (1, 20_000, 10)])
def test_trie(spark, monkeypatch, shallow, most, ids):
    """Also with bands and hot groups for short conversations, and ends hashed in parts."""
    monkeypatch.setattr(prefix_trie, "SHALLOW", shallow)
    monkeypatch.setattr(prefix_trie, "MOST_TURNS", most)
    monkeypatch.setattr(prefix_trie, "ID_RANGE", ids)
    rows = [r for r in awkward() if not (r[0] == 201 and shallow == 2)]
    assert trie_rows(prefix_trie.trie(frame(spark, rows))) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    got = prefix_trie.trie(frame(spark, []))
    assert got.count() == 0 and got.columns[:3] == ["conv_id", "depth", "parent_conv_id"]
    only = trie_rows(prefix_trie.trie(frame(spark, [(1, None, None, None)])))
    assert only == trie_by_hand([(1, None, None, None)])


def cheapest(rows):
    """Least (cost, edits) by uniform-cost search over (rows read, initials given); rows: (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, edits, at, given = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", given):
            return cost, edits
        state = (at, given)
        if state in seen or not re.fullmatch("s?(ua)*u?", given):
            continue
        seen.add(state)
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 2, edits + "D", at + 1, given))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, edits + "K", at + 1, given + (initial or "?")))
                for r in "ua":
                    heapq.heappush(heap, (cost + 1 + more, edits + "R", at + 1, given + r))
        if len(given) < 2 * len(rows) + 3:
            for r in "ua":
                heapq.heappush(heap, (cost + 5, edits + "I", at, given + r))


def repaired(rows, edits):
    """rows: (role, text); the roles that edits give follow from the grammar."""
    out, at = [], 0
    for e in edits:
        other = "assistant" if out and out[-1][0][0] == "u" else "user"
        if e == "K":
            out.append(rows[at])
        elif e == "R":
            out.append((other, rows[at][1]))
        elif e == "I":
            out.append((other, ""))
        at += e != "I"
    return "\n".join(f"{r}:{t}" for r, t in out)


def repair_by_hand(rows):
    out = []
    for c, turns in by_conversation(rows).items():
        after = []
        for turn, role, text in turns:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{" " if c is None else c}:{" " if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in after:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in after]
        known = [t for t, _, _ in after if t is not None]
        cost, edits = cheapest(list(zip(initials, faults, strict=True)))
        text = repaired([(r, x) for _, r, x in after], edits)
        out.append((
            -1 if c is None else c, max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)), cost, edits, hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out)


def repair_rows(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_repair(spark):
    rows = [r for r in awkward(3, 150) if r[0] not in (100, 201)]
    got = conversation_repair.repair(frame(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert repair_rows(got) == repair_by_hand(rows)
    assert conversation_repair.repair(frame(spark, [])).count() == 0


def test_repair_of_a_dropped_conversation(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = conversation_repair.repair(frame(spark, [(7, turn, "user", "Gone.")])).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_automaton_shares_suffixes_and_finds_least_audits():
    rng = random.Random(5)
    for _ in range(400):
        letters = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(6)))
        path = [conversation_repair.END]
        for letter in reversed(letters):
            path.append(conversation_repair.node(letter, path[-1]))
        rows = [(x.lower(), "blank" if x == "x" else "truncated" if x.isupper() else "") for x in letters]
        assert (path[-1][0][0], conversation_repair.audit(letters, path)) == cheapest(rows)
    long = "ua" * 5000 + "xUo"
    path = [conversation_repair.END]
    for letter in reversed(long):
        path.append(conversation_repair.node(letter, path[-1]))
    assert conversation_repair.audit(long, path).startswith("K" * 10000)
