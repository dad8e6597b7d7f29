"""Weighted automata from the two forms in which toolkits keep them: lines of text and binary files.

The text form has a line for each arc (source, destination, labels, cost) and for each final
state (state, cost), the first line's source being the start; the binary form is that of
vector automata over the log or tropical semiring, little-endian.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.lattice import ARCS, KEYS, Lattices
from arcloom.plans.batches import sent

# fixed values of the binary form
MAGIC, SYMBOLS_MAGIC, VERSION = 2125659606, 2125658996, 2
HAS_INPUT_SYMBOLS, HAS_OUTPUT_SYMBOLS, ALIGNED = 1, 2, 4
#: arc type -> how its weights are written
WEIGHTS = {"standard": "f", "log": "f", "log64": "d"}
#: properties that a writer claims: expanded and mutable
PROPERTIES = 3

ROWS = f"lattice_id long, start int, finals array<double>, arcs {ARCS}, error string"


def ordered(start: int, finals: list[float], arcs: list[tuple[int, int, int, int, float]]) -> dict | None:
    """A row of a collection, states numbered so that arcs lead to larger numbers; None if there is a cycle.
    Arcs are (src, dst, ilabel, olabel, weight); their ids are their places."""
    waits, after = [0] * len(finals), [[] for _ in finals]
    for s, t, *_ in arcs:
        waits[t] += 1
        after[s].append(t)
    ready, number = [s for s in range(len(finals) - 1, -1, -1) if not waits[s]], {}
    while ready:
        s = ready.pop()
        number[s] = len(number)
        for t in sorted(after[s], reverse=True):
            waits[t] -= 1
            if not waits[t]:
                ready.append(t)
    if len(number) < len(finals):
        return None
    if all(s < t for s, t, *_ in arcs):
        number = {s: s for s in number}  # as they are
    placed = [math.inf] * len(finals)
    for s, f in enumerate(finals):
        placed[number[s]] = f
    made = [
        {"dst": number[t], "src": number[s], "arc_id": i, "ilabel": x, "olabel": y, "weight": w, "features": None} for i, (s, t, x, y, w) in enumerate(arcs)
    ]
    made.sort(key=lambda a: (a["dst"], a["src"], a["arc_id"]))
    return {"start": number[start] if finals else None, "finals": placed, "arcs": made}


def decode(data: bytes) -> tuple[int, list[float], list[tuple[int, int, int, int, float]]]:
    """start, final costs by state and arcs of a binary file."""
    at = 0

    def read(kind: str):
        nonlocal at
        (value,) = struct.unpack_from("<" + kind, data, at)
        at += struct.calcsize("<" + kind)
        return value

    def text() -> str:
        nonlocal at
        n = read("i")
        if n < 0 or at + n > len(data):
            raise ValueError("a string beyond the end of the file")
        value = data[at : at + n].decode(errors="replace")
        at += n
        return value

    if read("i") != MAGIC:
        raise ValueError("not a binary automaton")
    kind, arc_type = text(), text()
    if kind != "vector" or arc_type not in WEIGHTS:
        raise ValueError(f"an automaton of type {kind} with {arc_type} arcs")
    version, flags, _ = read("i"), read("i"), read("Q")
    if version != VERSION or flags & ALIGNED:
        raise ValueError("a version that is not read")
    start, states, _ = read("q"), read("q"), read("q")
    for bit in (HAS_INPUT_SYMBOLS, HAS_OUTPUT_SYMBOLS):
        if flags & bit:
            if read("i") != SYMBOLS_MAGIC:
                raise ValueError("not a symbol table")
            text()
            _, size = read("q"), read("q")
            for _ in range(size):
                text()
                read("q")
    weight = WEIGHTS[arc_type]
    one = struct.Struct(f"<ii{weight}i")
    finals, arcs = [], []
    while len(finals) < states if states >= 0 else at < len(data):
        finals.append(read(weight))
        n = read("q")
        for x, y, w, t in one.iter_unpack(data[at : at + n * one.size]):
            arcs.append((len(finals) - 1, t, x, y, w))
        at += n * one.size
        if at > len(data):
            raise ValueError("arcs beyond the end of the file")
    if any(not 0 <= t < len(finals) for _, t, *_ in arcs) or (finals and not 0 <= start < len(finals)):
        raise ValueError("a state that is not there")
    return start, finals, arcs


def encode(row: dict, arc_type: str = "log") -> bytes:
    """The binary file of a collection's row."""
    weight = WEIGHTS[arc_type]
    by_state: list[list[dict]] = [[] for _ in row["finals"]]
    for a in sorted(row["arcs"], key=lambda a: a["arc_id"]):
        by_state[a["src"]].append(a)
    names = b"".join(struct.pack("<i", len(x)) + x for x in (b"vector", arc_type.encode()))
    start = -1 if row["start"] is None else row["start"]
    out = [struct.pack("<i", MAGIC), names, struct.pack("<iiQqqq", VERSION, 0, PROPERTIES, start, len(by_state), len(row["arcs"]))]
    for final, arcs in zip(row["finals"], by_state, strict=True):
        out.append(struct.pack(f"<{weight}q", final, len(arcs)))
        out += [struct.pack(f"<ii{weight}i", a["ilabel"], a["olabel"], a["weight"], a["dst"]) for a in arcs]
    return b"".join(out)


def to_binary(lattices: Lattices, arc_type: str = "log") -> DataFrame:
    """lattice_id, data: a binary file for each lattice; costs of single precision but for ``log64``."""
    if arc_type not in WEIGHTS:
        raise ValueError(f"arc types are {', '.join(WEIGHTS)}")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(r, arc_type) for r in b.to_pylist()], pa.binary())], names=["lattice_id", "data"])

    return sent(lattices.rows.select(*KEYS)).mapInArrow(run, "lattice_id long, data binary")


def _collection(ids: DataFrame, read) -> Lattices:
    """Lattices of rows (lattice_id, what ``read`` takes); ``meta`` names those that cannot be read."""
    from arcloom.operators.automata import ARROW_ARC
    from arcloom.session import cut

    kinds = {"start": pa.int32(), "finals": pa.list_(pa.float64()), "arcs": pa.list_(ARROW_ARC), "error": pa.string()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"start": [], "finals": [], "arcs": [], "error": []}
            for data in b.column(1).to_pylist():
                row, error = None, None
                try:
                    row = ordered(*read(data))
                    error = None if row else "a cycle"
                except (ValueError, struct.error) as e:
                    error = str(e)
                for k in ("start", "finals", "arcs"):
                    out[k].append(row and row[k])
                out["error"].append(error)
            yield pa.RecordBatch.from_pydict({"lattice_id": b.column(0)} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    rows = cut(ids.mapInArrow(run, ROWS))
    errors = rows.filter("error IS NOT NULL").select("lattice_id", "error")
    return Lattices(rows.filter("error IS NULL").drop("error"), None, errors)


def parse_binary(files: DataFrame) -> Lattices:
    """Of binary files (lattice_id, data); symbol tables in them are passed over."""
    return _collection(files.select("lattice_id", "data"), decode)


def read_binary(spark: SparkSession, path: str) -> Lattices:
    """Of all files of a path, a lattice each, known by the hash of its name."""
    files = spark.read.format("binaryFile").load(path)
    return parse_binary(files.select(F.xxhash64("path").alias("lattice_id"), F.col("content").alias("data")))


def parse_lines(texts: DataFrame) -> Lattices:
    """Of texts (lattice_id, text) in the form of lines; a missing label repeats the input label, a missing
    cost is 0; blank lines are passed over."""

    def read(text: str):
        arcs, finals, most, start = [], {}, -1, None
        for line in (text or "").split("\n"):
            fields = line.split()
            if not fields:
                continue
            if len(fields) <= 2:
                state, cost = int(fields[0]), float(fields[1]) if len(fields) == 2 else 0.0
                finals[state] = cost
                most, start = max(most, state), state if start is None else start
                continue
            s, t, x = (int(f) for f in fields[:3])
            y = int(fields[3]) if len(fields) > 3 else x
            arcs.append((s, t, x, y, float(fields[4]) if len(fields) > 4 else 0.0))
            most, start = max(most, s, t), s if start is None else start
        if min([0, *finals, *(x for a in arcs for x in a[:2])]) < 0:
            raise ValueError("a negative state")
        return start or 0, [finals.get(s, math.inf) for s in range(most + 1)], arcs

    return _collection(texts.select("lattice_id", "text"), read)


def line_frames(lines: DataFrame, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Arcs and states of lines (lattice_id, line) in any order, for automata of any size: no text is held whole, so the
    start is to be named.  States keep their numbers."""
    field = F.split(F.trim("line"), r"\s+")
    parts = lines.filter(F.trim("line") != "").select("lattice_id", field.alias("f"))
    arcs = parts.filter(F.size("f") > 2).select(
        "lattice_id",
        F.get("f", F.lit(0)).cast("int").alias("src"),
        F.get("f", F.lit(1)).cast("int").alias("dst"),
        F.get("f", F.lit(2)).cast("int").alias("ilabel"),
        F.coalesce(F.get("f", F.lit(3)), F.get("f", F.lit(2))).cast("int").alias("olabel"),
        F.coalesce(F.get("f", F.lit(4)).cast("double"), F.lit(0.0)).alias("weight"),
    )
    ends = parts.filter(F.size("f") <= 2).select("lattice_id", F.get("f", F.lit(0)).cast("int").alias("state"), F.coalesce(F.get("f", F.lit(1)).cast("double"), F.lit(0.0)).alias("final"))
    inner = arcs.select("lattice_id", F.explode(F.array("src", "dst")).alias("state")).distinct().withColumn("final", F.lit(math.inf))
    states = ends.unionByName(inner).groupBy("lattice_id", "state").agg(F.min("final").alias("final"))
    return arcs, states.withColumn("is_start", F.col("state") == start)
