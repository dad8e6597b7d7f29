"""Repair of conversations: least edits that make their roles alternate.

A conversation's signature has one letter a row: its role's initial and its
fault.  What the rest of a conversation costs depends on the rest of its
signature and the grammar's state alone, so all signatures are read into one
automaton from their ends: a node is a distinct suffix, with the least cost and
the first edit of the best audit for each of the grammar's four states.
Distinct signatures are sorted by their reversal and dealt in ranges, so that
a task meets each node once and holds those of one path only.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm.common import shuffle_partitions, written
from arcloom.llm.prefix_trie import CRC

#: fixed values: what edits cost
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: the grammar (s?(ua)+)?: by state, what each initial leads to; 0 and 3 are final
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: what a row that is inserted or given another role becomes, by state, and where it leads
GIVEN = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
FINAL = (0, 3)
MUST_GO = "x"
#: signatures of more than one conversation in this many are joined by broadcast: at most as many
FREQUENT = 1000

SPACE = r"\x20\x09-\x0D"
Node = tuple[tuple[int, ...], str]


def _settle(costs: list[int], first: list[str]) -> Node:
    """With rows inserted before what is left, where that is better; each candidate of a state
    starts with another edit, so ties are settled by the first."""
    for _ in GIVEN:
        for s in range(4):
            costs[s], first[s] = min((costs[s], first[s]), (INSERT + costs[NEXT[s]], "I"))
    return tuple(costs), "".join(first)


NEVER = 1 << 60
END = _settle([0 if s in FINAL else NEVER for s in range(4)], ["." if s in FINAL else "Z" for s in range(4)])


def node(letter: str, rest: Node) -> Node:
    """Cost-to-go and first edit by grammar state, of a row before ``rest``."""
    initial, more = letter.lower(), TRUNCATED * letter.isupper()
    costs, first = [], []
    for s in range(4):
        found = [(DELETE + rest[0][s], "D")]
        if letter != MUST_GO:
            found.append((REROLE + more + rest[0][NEXT[s]], "R"))
            if initial in STEP[s]:
                found.append((more + rest[0][STEP[s][initial]], "K"))
        cost, edit = min(found)
        costs.append(cost)
        first.append(edit)
    return _settle(costs, first)


def audit(signature: str, path: list[Node]) -> str:
    """The best edits, read along the automaton: ``path[k]`` is the node of the last k letters."""
    out, state, left = [], 0, len(signature)
    while True:
        edit = path[left][1][state]
        if edit == ".":
            return "".join(out)
        out.append(edit)
        if edit == "K":
            state = STEP[state][signature[len(signature) - left].lower()]
        elif edit != "D":
            state = NEXT[state]
        left -= edit != "I"


def _solve(batches):
    path, before = [END], ""
    for batch in batches:
        signatures = batch.column(0).to_pylist()
        costs, audits = [], []
        for signature in signatures:
            reversal = signature[::-1]
            shared = 0
            for x, y in zip(before, reversal, strict=False):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            for letter in reversal[shared:]:
                path.append(node(letter, path[-1]))
            before = reversal
            costs.append(path[-1][0][0])
            audits.append(audit(signature, path))
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), batch.column(1)], names=["sig", "cost", "audit", "n"])


def solve(signatures: DataFrame) -> DataFrame:
    """(sig, cost, audit, n) of distinct signatures (sig, n)."""
    back = F.reverse("sig")
    dealt = signatures.repartitionByRange(shuffle_partitions(signatures.sparkSession), back).sortWithinPartitions(back)
    return dealt.select("sig", "n").mapInArrow(_solve, "sig string, cost long, audit string, n long")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, those dropped included as ``live`` false: conv_id, turn, role, text, live."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", space)
    return (
        conversations.select(
            "conv_id",
            "turn",
            F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            (kind != 0).alias("live"),
            F.when(kind == 3, 2).otherwise(1).alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .drop("copy", "copies")
    )


def _order() -> list[Column]:
    """The order of a conversation's rows."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text_id")]


def structure(conversations: DataFrame) -> DataFrame:
    """By conversation: conv_id, gaps, blank, duplicate, truncated, illegal, and its signature.

    Texts are known by their SHA-256; only that and two flags of each row are shuffled.
    """
    text = F.col("text")
    rows = damaged(conversations).select(
        "conv_id",
        "turn",
        "role",
        "live",
        F.sha2("text", 256).alias("text_id"),
        (~text.rlike(f"[^{SPACE}]")).alias("blank"),
        (~text.rlike(rf"[.!?][{SPACE}]*\z")).alias("cut"),
    )
    initial = F.substring("role", 1, 1)
    whole = Window.partitionBy("conv_id").orderBy(F.desc("live"), *_order())
    seen = Window.partitionBy("conv_id", "live", "role", "text_id").orderBy("place")
    rows = (
        rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id")
        .withColumn("place", F.row_number().over(whole))
        .withColumn("pair", F.concat(F.lag(initial).over(whole), initial))
        .withColumn("turn_before", F.lag("turn").over(whole))
        .withColumn("again", F.row_number().over(seen) > 1)
        .withColumn(
            "fault", F.when(~F.col("live"), None).when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
        )
    )
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    live = F.col("live")
    turn = F.when(live, F.col("turn"))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    turns = count(turn.isNotNull() & ((F.col("turn_before") != F.col("turn")) | F.col("turn_before").isNull()))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - turns, F.lit(0)).alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(live & F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(live, F.struct("place", letter.alias("letter"))))), lambda x: x["letter"]), "").alias("sig"),
    )


def plans(stats: DataFrame) -> DataFrame:
    """``stats`` with the cost and audit of each conversation's signature.

    Frequent signatures, at most FREQUENT and no longer together than FREQUENT average
    conversations, are broadcast; the rest meet few conversations each and are joined.
    """
    solved = written(solve(written(stats.groupBy("sig").agg(F.count("*").alias("n")))))
    total = solved.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT > total
    hot = solved.filter(often).select("sig", F.col("cost").alias("hot_cost"), F.col("audit").alias("hot_audit"))
    rest = solved.filter(~often).select(F.col("sig").alias("key"), "cost", "audit")
    known = stats.join(F.broadcast(hot), "sig", "left")
    # what is known asks for nothing: its key is not a signature, and differs by conversation
    known = known.withColumn("key", F.when(F.col("hot_cost").isNull(), F.col("sig")).otherwise(F.concat(F.lit("."), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))))
    return known.join(rest, "key", "left").select(
        *[c for c in stats.columns if c != "sig"], F.coalesce("hot_cost", "cost").alias("cost"), F.coalesce("hot_audit", "audit").alias("audit")
    )


def _replay(batches):
    """Rows sorted by conversation, its plan first: the hash of what the edits leave."""
    state = None
    for batch in batches:
        out = []
        for conv, head, role, text, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if head:
                if state is not None:
                    out.append(state.done())
                state = _Repair(conv, edits)
            else:
                state.row(role, text)
        yield _hashes(out)
    if state is not None:
        yield _hashes([state.done()])


def _hashes(rows):
    ids, hashes = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])


class _Repair:
    """One conversation's edits, applied row by row."""

    def __init__(self, conv, edits: str):
        self.conv, self.edits, self.at, self.state = conv, edits, 0, 0
        self.hash, self.some = hashlib.sha256(), False

    def put(self, role: str, text: str, state: int) -> None:
        self.hash.update((("\n" if self.some else "") + role + ":" + text).encode())
        self.some, self.state = True, state

    def inserts(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.put(GIVEN[self.state], "", NEXT[self.state])
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.put(role, text, STEP[self.state][role[0]])
        elif edit == "R":
            self.put(GIVEN[self.state], text, NEXT[self.state])

    def done(self) -> tuple:
        self.inserts()
        return self.conv, self.hash.hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """Damage, faults, cheapest edits and the repaired conversation's hash, one row for each conv_id.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  A null role or text is
    one space; rows with a null conv_id are one conversation more; ties of a turn are ordered by role, then by the
    text's SHA-256; repeated rows are repeated turns and so duplicates; a text may be of any length; a role that
    starts with none of s, u, a can only be given another or go; an empty table gives no row.  Other columns are
    ignored, whatever their names.

    A conversation's rows meet in one task in order, streamed: its hash is sequential.  Its
    signature, a letter a row, and its audit are held.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    found = written(plans(written(structure(conversations))))
    none = F.lit(None).cast("string")
    rows = damaged(conversations).filter("live").select(
        "conv_id", F.lit(False).alias("head"), "turn", "role", F.sha2("text", 256).alias("text_id"), "text", none.alias("audit")
    )
    heads = found.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text_id"), none.alias("text"), "audit")
    ordered = (
        heads.unionByName(rows).repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.desc("head"), *_order())
    )
    hashes = ordered.select("conv_id", "head", "role", "text", "audit").mapInArrow(_replay, "conv_id long, repaired_sha256 string")
    return found.join(hashes.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")


_NEXT = "[2, 2, 3, 2][s + 1] + 1"
#: rows inserted before what ``{0}`` has for each state
_INSERTED = f"list_transform(range(4), lambda s: list_sort([{{0}}[s + 1], {{{{'c': {{0}}[{_NEXT}].c + 5, 'a': 'I' || {{0}}[{_NEXT}].a}}}}])[1])"

#: whole audits are compared here, from each conversation's own last row
ORACLE = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   {CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
   left(role, 1) AS initial FROM hurt),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM ordered),
lines AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM lines GROUP BY conv_id),
best(conv_id, i, v) AS (
  SELECT conv_id, n + 1, [{{'c': 0, 'a': ''}}, {{'c': 10, 'a': 'II'}}, {{'c': 5, 'a': 'I'}}, {{'c': 0, 'a': ''}}] FROM lines WHERE i = 1
  UNION ALL
  SELECT conv_id, i, {_INSERTED.format("v3")} FROM (SELECT conv_id, i, {_INSERTED.format("v2")} AS v3 FROM (SELECT conv_id, i, {_INSERTED.format("v1")} AS v2 FROM (
    SELECT r.conv_id, r.i, list_transform(range(4), lambda s: list_sort(list_filter([
      {{'c': b.v[s + 1].c + 2, 'a': 'D' || b.v[s + 1].a}},
      CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {{'c': b.v[{_NEXT}].c + 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'a': 'R' || b.v[{_NEXT}].a}} END,
      CASE WHEN fault NOT IN ('blank', 'duplicate') AND ((s = 0 AND initial IN ('s', 'u')) OR (s IN (1, 3) AND initial = 'u') OR (s = 2 AND initial = 'a'))
        THEN {{'c': b.v[CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END,
              'a': 'K' || b.v[CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a}} END], lambda x: x IS NOT NULL))[1]) AS v1
    FROM best b JOIN lines r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)))),
plan AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM best WHERE i = 1),
replay(conv_id, audit, k, i, last, done) AS (
  SELECT conv_id, audit, 0, 0::BIGINT, '', NULL::VARCHAR FROM plan
  UNION ALL
  SELECT conv_id, audit, k, i, CASE e WHEN 'D' THEN last WHEN 'K' THEN initial ELSE left(given, 1) END,
    CASE e WHEN 'D' THEN done WHEN 'I' THEN concat_ws(chr(10), done, given || ':') WHEN 'K' THEN concat_ws(chr(10), done, role || ':' || text) ELSE concat_ws(chr(10), done, given || ':' || text) END
  FROM (SELECT p.*, r.role, r.text, r.initial FROM (
      SELECT conv_id, audit, k + 1 AS k, audit[k + 1] AS e, i + CASE audit[k + 1] WHEN 'I' THEN 0 ELSE 1 END AS i, last, done, CASE last WHEN 'u' THEN 'assistant' ELSE 'user' END AS given
      FROM replay WHERE k < length(audit)) p
    LEFT JOIN lines r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i AND p.e <> 'I')),
ended AS (SELECT conv_id, sha256(coalesce(done, '')) AS repaired_sha256 FROM replay WHERE k = length(audit))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
