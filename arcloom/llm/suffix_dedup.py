"""Removal of byte strings that also start in an earlier document.

Every 50-byte string of every document is compared, but no suffix is moved by
itself.  A window of 50 bytes is named by its anchor, the 20-byte string in it
whose hash is least, so equal windows have equal anchors at the same place,
and neighbouring windows mostly share theirs: a record holds an anchor with
the bytes of all the windows that it names.  Records meet in the bucket of
their anchor, and buckets are sorted one at a time.  In a bucket the windows
are ordered by a difference-cover sample: the suffixes at the sampled places
are sorted first, and the order of windows that agree in their first bytes is
read from the ranks of the sampled places a few bytes further on, the same
number of bytes for both.  The smallest doc_id of each class of equal windows
decides what is removed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import cut, release, shuffle_partitions, small, trimmed

WINDOW = 50
GRAM = 20
REACH = WINDOW - GRAM  # an anchor starts at most so many bytes after its window
ROW = REACH + WINDOW  # an anchor's record: the bytes from REACH before it
#: most bytes that are hashed together; a longer text is taken in overlapping parts
CHUNK_BITS = 21
#: a perfect difference cover: any two residues have a common distance to it
PERIOD, COVER = 7, (0, 1, 3)
#: bytes of text that a task holds records of
FLUSH = 16_000_000
#: spans that a task gathers before it deals them out by document
HELD_SPANS = 2_000_000
#: records of a suffix bucket beyond which equal contents are brought down to one
HELD_RECORDS = 300_000
#: bytes of text for a suffix bucket, for a group of documents, and for a task
BUCKET_BYTES, GROUP_BYTES, TASK_BYTES = 4_000_000, 16_000_000, 64_000_000

_P = 0x9E3779B185EBCA87
_M = np.uint64(0xC2B2AE3D27D4EB4F)
_WORDS = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1)) % (1 << 64) for i in range(ROW // 8)], np.uint64)

#: ``tag`` tells rows with one doc_id and different texts apart
RECORD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("first", "u1"), ("n", "u1"), ("row", "u1", (ROW,))])
SPAN = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("lo", "<u4"), ("hi", "<u4")])
RECORDS, SPANS, TEXT = 0, 1, 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def anchors(text: np.ndarray, ends: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Records of the windows that lie within the parts of ``text`` that end at
    ``ends``; ``start`` counts from the start of ``text``, ``doc`` is not set."""
    n = len(text)
    if n < WINDOW:
        return np.zeros(0, RECORD)
    h = text.astype(np.uint64)
    by_size = {1: h}
    for size in (1, 2, 4, 8):
        h = h[:-size] * _power(size) + h[size:]
        by_size[2 * size] = h
    h = by_size[16][:-4] * _power(4) + by_size[4][16:]
    del by_size
    h ^= h >> np.uint64(32)
    h *= _M
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << CHUNK_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    for size in (1, 2, 4, 8):
        least = np.minimum(least[:-size], least[size:])
    least = np.minimum(least[: -(REACH - 15)], least[REACH - 15 :])
    anchor = (least & low).astype(np.int64)
    inside = np.ones(n + 1, bool)
    for end in ends.tolist():
        inside[max(0, end - WINDOW + 1) : end] = False
    inside = inside[: len(anchor)]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    after = np.append(change, True)
    after[:-1] |= ~inside
    stops = np.flatnonzero(after)
    stop = stops[np.searchsorted(stops, first, side="right")]
    at = anchor[first]
    keys = h[at]
    if buckets > 1:
        own = keys % np.uint64(buckets) == np.uint64(bucket)
        first, stop, at, keys = first[own], stop[own], at[own], keys[own]
    out = np.zeros(len(first), RECORD)
    padded = np.concatenate([np.zeros(REACH, np.uint8), text, np.zeros(ROW, np.uint8)])
    out["row"] = np.lib.stride_tricks.sliding_window_view(padded, ROW)[at]
    out["key"], out["start"] = keys, first
    out["first"] = REACH - (at - first)
    out["n"] = stop - first
    column = np.arange(ROW, dtype=np.uint8)
    out["row"] *= (column >= out["first"][:, None]) & (column < (out["first"] + out["n"] + WINDOW - 1)[:, None])
    return out


def _row_hash(records: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(records["row"]).view("<u8")
    h = np.zeros(len(records), np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * _WORDS[i]
        h ^= h >> np.uint64(31)
    return h ^ (records["first"].astype(np.uint64) << np.uint64(8)) ^ records["n"].astype(np.uint64)


def by_content(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The records ordered by key, content and doc; whether each starts a key;
    whether each starts a content."""
    content = _row_hash(records)
    order = np.lexsort((records["doc"], content, records["key"]))
    records, content = records[order], content[order]
    new_key = np.ones(len(records), bool)
    new_key[1:] = records["key"][1:] != records["key"][:-1]
    new = new_key.copy()
    new[1:] |= content[1:] != content[:-1]
    same = np.flatnonzero(~new)
    differ = (records["row"][same] != records["row"][same - 1]).any(1) | (records["first"][same] != records["first"][same - 1])
    if (differ | (records["n"][same] != records["n"][same - 1])).any():  # hashes clash: order by the bytes themselves
        exact = _exact(records)
        order = np.lexsort((records["doc"], exact, records["key"]))
        records, exact = records[order], exact[order]
        new = np.ones(len(records), bool)
        new[1:] = (records["key"][1:] != records["key"][:-1]) | (exact[1:] != exact[:-1])
    return records, new_key, new


def _exact(records: np.ndarray) -> np.ndarray:
    whole = np.concatenate([records["first"][:, None], records["n"][:, None], records["row"]], axis=1)
    return np.unique(whole, axis=0, return_inverse=True)[1].ravel()


def window_classes(rows: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """For the windows at (row, column) of ``rows``: three class numbers each, so
    that two windows that start in the same column are equal exactly if they
    have a class number in common.

    One number for each distance (below PERIOD) from the window to a sampled
    place: windows have it in common if they agree in their first eight bytes
    and in the rank of what starts that distance further on.
    """
    text = np.concatenate([rows.ravel(), np.zeros(2 * WINDOW + PERIOD, np.uint8)])
    at = row * ROW + column
    sampled = np.zeros(len(text), bool)
    near = (at[:, None] + np.arange(PERIOD)).ravel()
    sampled[near[np.isin(near % PERIOD, COVER)]] = True
    sample = np.flatnonzero(sampled)
    words = np.zeros((len(sample), 56), np.uint8)
    words[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(text, WINDOW)[sample]
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    differ = words[1:] ^ words[:-1]
    early = (differ[:, :5] != 0).any(1)
    place = np.full(len(text), -1, np.int64)
    prefix = np.lib.stride_tricks.sliding_window_view(text, 8)[at].copy().view(">u8").ravel().astype(np.uint64)
    prefix = np.unique(prefix, return_inverse=True)[1]
    out = np.empty((len(at), len(COVER)), np.int64)
    filled = np.zeros(len(at), np.int64)
    for distance in range(PERIOD):
        # ranks by the WINDOW - distance bytes that the window has from there
        rest = WINDOW - distance - 40
        high = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * min(rest, 8))) - 1))
        new = early | ((differ[:, 5] & high) != 0)
        if rest > 8:
            new |= (differ[:, 6] & np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * (rest - 8))) - 1))) != 0
        place[sample[order]] = np.concatenate([[0], np.cumsum(new)]) if len(sample) else []
        own = np.flatnonzero(np.isin((at + distance) % PERIOD, COVER))
        rank = place[at[own] + distance]
        out[own, filled[own]] = (prefix[own] * PERIOD + distance) * (len(sample) + 1) + rank
        filled[own] += 1
    return out


def _least_by(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each position the least value among those with an equal key."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    least = np.minimum.reduceat(values[order], first)
    out = np.empty_like(values)
    out[order] = np.repeat(least, np.diff(np.append(first, len(keys))))
    return out


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within owner) for counts[i] items of each i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def repeats(records: np.ndarray) -> np.ndarray:
    """Spans of the windows that also start in a document with a smaller doc_id,
    of all records of some keys."""
    if not len(records):
        return np.zeros(0, SPAN)
    records, new_key, new = by_content(records)
    key = np.cumsum(new_key) - 1
    # keys of a single document have no repeats
    first = np.flatnonzero(new_key)
    mixed = np.maximum.reduceat(records["doc"], first) > np.minimum.reduceat(records["doc"], first)
    keep = mixed[key]
    records, key, new = records[keep], key[keep], new[keep]
    if not len(records):
        return np.zeros(0, SPAN)
    content = np.cumsum(new) - 1
    head = np.flatnonzero(new)  # doc-ordered, so the head has its content's least doc
    least_doc = records["doc"][head]
    contents_of_key = np.bincount(np.unique(key, return_inverse=True)[1][head])
    single = contents_of_key[np.unique(key, return_inverse=True)[1]] == 1
    whole = single & (records["doc"] > least_doc[content])
    out = [_spans(records[whole], records["start"][whole], records["n"][whole])]
    several = np.flatnonzero(~single[head])
    if len(several):
        heads = records[head[several]]
        owner, number = _spread(heads["n"].astype(np.int64))
        column = heads["first"].astype(np.int64)[owner] + number
        classes = window_classes(heads["row"], owner, column)
        group = np.unique(key[head[several]], return_inverse=True)[1][owner] * ROW + column
        group = np.unique(group, return_inverse=True)[1]
        docs = least_doc[several][owner]
        least = np.full(len(owner), np.iinfo(np.int64).max)
        classes = np.unique(classes.ravel(), return_inverse=True)[1].reshape(classes.shape)
        scale = classes.max() + 1
        merged = _least_by((group[:, None] * scale + classes).ravel(), np.repeat(docs, len(COVER)))
        least = np.minimum(least, merged.reshape(-1, len(COVER)).min(1))
        # back to every record of these contents
        offset = np.full(len(head), -1, np.int64)
        offset[several] = np.cumsum(heads["n"].astype(np.int64)) - heads["n"]
        rows = np.flatnonzero(~single)
        for part in np.array_split(rows, max(1, len(rows) // 200_000)):
            owner, number = _spread(records["n"][part].astype(np.int64))
            hit = least[offset[content[part]][owner] + number] < records["doc"][part][owner]
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            same = np.append(owner[1:] == owner[:-1], False)
            lo = np.flatnonzero(hit & ((edge[:-1] == 1) | (number == 0)))
            hi = np.flatnonzero(hit & ((edge[1:] == -1) | ~same))
            out.append(_spans(records[part][owner[lo]], records["start"][part][owner[lo]] + number[lo], number[hi] - number[lo] + 1))
    return np.concatenate(out)


def _spans(of: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Spans in the documents of the records ``of``."""
    out = np.zeros(len(of), SPAN)
    out["doc"], out["tag"], out["lo"] = of["doc"], of["tag"], start
    out["hi"] = start.astype(np.int64) + windows + WINDOW - 1
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that spans cover."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64))
    new = np.append(True, lo[1:] > hi[:-1])
    return lo[new], hi[np.append(new[1:], True)]


def _part(values: np.ndarray, parts: int) -> np.ndarray:
    h = values.astype(np.uint64) * _M
    return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def _packed(kind: int, values: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The values as compressed rows, one for each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    values, part = values[order], part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for lo, hi in zip(first, [*first[1:], len(part)], strict=True):
        yield kind, int(part[lo]), squeeze(b"".join(values[n][lo:hi].tobytes() for n in values.dtype.names))


def _unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        values, at = np.zeros(len(raw) // kind.itemsize, kind), 0
        for name in kind.names:  # field by field, as packed
            field = np.frombuffer(raw, kind[name].base, count=values[name].size, offset=at)
            values[name] = field.reshape(values[name].shape)
            at += field.nbytes
        out.append(values)
    return np.concatenate(out) if out else np.zeros(0, kind)


def _parts(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in chunks; a long text in parts that overlap so that
    every window is in one of them."""
    most, chunk, size = (1 << CHUNK_BITS) - 1, [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), most - WINDOW + 1):
            piece = t[at : at + most]
            if chunk and size + len(piece) > most:
                yield chunk
                chunk, size = [], 0
            chunk.append((i, at, piece))
            size += len(piece)
    if chunk:
        yield chunk


def local_records(docs: list[int], texts: list[bytes], bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The records of a batch of documents that other batches must see, and the
    spans that the batch itself shows: of equal contents only the document
    with the least doc_id goes on, so that no passage travels more than once."""
    found = []
    ids, tags = np.array(docs, np.int64), np.array([zlib.crc32(t) for t in texts], np.uint32)
    for chunk in _parts(texts):
        ends = np.cumsum([len(p) for _, _, p in chunk])
        starts = np.append(0, ends[:-1])
        records = anchors(np.frombuffer(b"".join(p for _, _, p in chunk), np.uint8), ends, bucket, buckets)
        at = np.searchsorted(ends, records["start"], side="right")
        owner = np.array([i for i, _, _ in chunk])[at]
        records["doc"], records["tag"] = ids[owner], tags[owner]
        records["start"] += (np.array([o for _, o, _ in chunk]) - starts)[at].astype(np.int64).astype(np.uint32)
        found.append(records)
    if not found:
        return np.zeros(0, RECORD), np.zeros(0, SPAN)
    records, _, new = by_content(np.concatenate(found))
    later = records["doc"] > records["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    return records[~later], _spans(records[later], records["start"][later], records["n"][later])


def fewer(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records with equal contents that with the least doc_id, and the spans of the others in later
    documents: what a bucket with one passage over and over is brought down to before more of it is read."""
    records, _, new = by_content(records)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = records["doc"] > records["doc"][head]
    own = new | ((records["doc"] == records["doc"][head]) & ~later)
    return records[own], _spans(records[later], records["start"][later], records["n"][later])


#: windows from this place of a row on hold the bytes after its anchor, those before it the bytes before
MIDDLE = REACH // 2 + 1


def _mixed(key: np.ndarray, rows: np.ndarray, salt: int) -> np.ndarray:
    """A number for each key with bytes beside it."""
    weights = np.array([pow(_P, i + 1 + salt, 1 << 64) | 1 for i in range(rows.shape[1])], np.uint64)
    out = key * np.uint64(pow(_P, salt, 1 << 64) | 1)
    for i in range(rows.shape[1]):
        out += (rows[:, i].astype(np.uint64) + np.uint64(1)) * weights[i]
        out ^= out >> np.uint64(29)
    return out * _M


def by_sides(records: np.ndarray) -> np.ndarray:
    """Records of one anchor in many contexts, told apart by content: the windows that start in the first half of a
    row by the bytes just before its anchor, which all of them hold, the others by those just after it."""
    out = []
    last = records["first"].astype(np.int64) + records["n"]
    for lo, hi, beside in ((0, MIDDLE, slice(MIDDLE - 1, REACH)), (MIDDLE, ROW, slice(REACH + GRAM, MIDDLE + WINDOW))):
        first, end = np.maximum(records["first"], lo), np.minimum(last, hi)
        own = end > first
        part = records[own].copy()
        part["start"] += (first[own] - records["first"][own]).astype(np.uint32)
        part["first"], part["n"] = first[own], (end - first)[own]
        part["key"] = _mixed(part["key"], part["row"][:, beside], 1 + (lo > 0))
        out.append(_bare(part))
    return np.concatenate(out)


def by_window(records: np.ndarray) -> np.ndarray:
    """A record for each window, known by all of its bytes."""
    owner, number = _spread(records["n"].astype(np.int64))
    out = records[owner].copy()
    out["start"] += number.astype(np.uint32)
    out["first"] = records["first"].astype(np.int64)[owner] + number
    out["n"] = 1
    out = _bare(out)
    out["key"] = _mixed(out["key"] ^ out["first"].astype(np.uint64), out["row"], 3)
    return out


def _bare(records: np.ndarray) -> np.ndarray:
    """Without the bytes that none of a record's windows holds, so that equal windows have equal contents."""
    at = np.arange(ROW)
    first = records["first"].astype(np.int64)[:, None]
    inside = (at >= first) & (at < first + records["n"][:, None] + WINDOW - 1)
    records["row"] = np.where(inside, records["row"], 0)
    return records


#: how records go on that are too many for a task, round by round; after the last each content is one record
FINER = (by_sides, by_window)


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _, _ in rows], pa.int32()),
            pa.array([p for _, p, _ in rows], pa.int64()),
            pa.array([b for _, _, b in rows], pa.binary()),
        ],
        names=["kind", "part", "blob"],
    )


BLOB = "kind int, part long, blob binary"


def repeated_spans(docs: DataFrame, passes: int, parts: int, doc_parts: int, tasks: int) -> list[DataFrame]:
    """Rows (kind, part, blob) of spans, part by doc_id: one table for each pass, written before
    the next pass is begun.  A pass takes a share of the anchors, dealt to ``parts`` suffix buckets;
    a task sorts one bucket at a time."""
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")

    def collect(bucket):
        def run(batches):
            ids, held, size = [], [], 0
            for b in small(batches):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids.append(doc)
                    held.append(text.encode())
                    size += len(held[-1])
                    if size >= FLUSH:
                        yield from emit(ids, held)
                        ids, held, size = [], [], 0
            if ids:
                yield from emit(ids, held)
            trimmed()

        def emit(ids, held):
            records, spans = local_records(ids, held, bucket, passes)
            yield _blobs([*_packed(RECORDS, records, _part(records["key"] >> np.uint64(20), parts))])
            yield _blobs([*_packed(SPANS, spans, _part(spans["doc"], doc_parts))])

        return run

    def compare(level):
        finer = FINER[level] if level < len(FINER) else None

        def run(batches):
            part, held, found, n, size, split = None, [], [], 0, 0, False

            def spread():
                spans = np.concatenate(found) if found else np.zeros(0, SPAN)
                return _blobs([*_packed(SPANS, spans, _part(spans["doc"], doc_parts))])

            def on(records):
                records = finer(records)
                return _blobs([*_packed(RECORDS, records, _part(records["key"] >> np.uint64(20), parts))])

            for b in batches:
                for k, p, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if k == SPANS:
                        yield _blobs([(k, p, blob)])
                        continue
                    if p != part:
                        if held and split:
                            yield on(np.concatenate(held))
                        elif held:
                            found.append(repeats(np.concatenate(held)))
                            n += len(found[-1])
                        held, size, split, part = [], 0, False, p
                        if n > HELD_SPANS:
                            yield spread()
                            found, n = [], 0
                    held.append(_unpacked([blob], RECORD))
                    size += len(held[-1])
                    if size > HELD_RECORDS:
                        kept, spans = fewer(np.concatenate(held))
                        found.append(spans)
                        held, n, size = [kept], n + len(spans), len(kept) // 2
                        if finer and (split or len(kept) > HELD_RECORDS):
                            # not one content over and over: this bucket goes on, told apart by more than its anchors
                            yield on(kept)
                            held, size, split = [], 0, True
            if held and split:
                yield on(np.concatenate(held))
            elif held:
                found.append(repeats(np.concatenate(held)))
            yield spread()
            trimmed()

        return run

    def dealt(blobs):
        return blobs.repartition(tasks, "kind", "part").sortWithinPartitions("kind", "part")

    out = []
    for bucket in range(passes):
        sent = texts.mapInArrow(collect(bucket), BLOB)
        for level in range(len(FINER) + 1):
            made = cut(dealt(sent).mapInArrow(compare(level), BLOB))
            out.append(made.filter(F.col("kind") == SPANS))
            sent = made.filter(F.col("kind") == RECORDS)
            release(docs.sparkSession)
            if sent.isEmpty():
                break
        del sent
    return out


def apply_spans(docs: DataFrame, finish, schema: str, passes: int = 2) -> DataFrame:
    """``finish(columns, rows)`` over groups of documents: columns maps names to
    lists, rows gives each document's runs (lo, hi) of removed bytes.

    The numbers of suffix buckets, of groups of documents and of tasks follow from the bytes of
    text, so that none of them grows with the input."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = shuffle_partitions(docs.sparkSession)
    tasks = max(least, size // TASK_BYTES)
    parts = max(least, size // GROUP_BYTES)
    spans = repeated_spans(docs, passes, max(4 * least, size // BUCKET_BYTES), parts, tasks)
    names = docs.columns

    def tag(batches):
        for b in batches:
            at = names.index("doc_id")
            ids = b.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            part = _part(ids, parts)
            row = pa.StructArray.from_arrays(b.columns, names=names)
            yield pa.RecordBatch.from_arrays([pa.array(part), row], names=["part", "row"])

    typed = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    tagged = docs.mapInArrow(tag, f"part long, row struct<{typed}>")
    rows = tagged.select(F.lit(TEXT).alias("kind"), "part", F.lit(None).cast("binary").alias("blob"), "row")
    for s in spans:
        rows = rows.unionByName(s, allowMissingColumns=True)

    def run(batches):
        part, blobs, held = None, [], []
        for b in batches:
            ps = b.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(ps[1:] != ps[:-1]) + 1).tolist(), len(ps)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if part is not None and ps[lo] != part:
                    yield from close(blobs, held)
                    blobs, held = [], []
                part = ps[lo]
                s = b.slice(lo, hi - lo)
                is_text = np.array(s.column(0).to_pylist()) == TEXT
                blobs += [x for x in s.column(2).to_pylist() if x is not None]
                held.append(s.column(3).filter(pa.array(is_text)))
        if part is not None:
            yield from close(blobs, held)
        trimmed()

    def close(blobs, held):
        spans = _unpacked(blobs, SPAN)
        spans = spans[np.argsort(spans["doc"], kind="stable")]
        for rows in held:
            if not len(rows):
                continue
            columns = {n: rows.field(i) for i, n in enumerate(names)}
            runs = []
            for doc, text in zip(columns["doc_id"].to_pylist(), columns["text"], strict=True):
                if doc is None:
                    runs.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    continue
                lo, hi = np.searchsorted(spans["doc"], [doc, doc + 1])
                own = spans[lo:hi]
                if len(own):
                    own = own[own["tag"] == zlib.crc32((text.as_py() or "").encode())]
                runs.append(merged(own["lo"], own["hi"]) if len(own) else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            yield finish(columns, runs)

    return rows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def kept_bytes(text: bytes, runs: tuple[np.ndarray, np.ndarray]) -> bytes:
    out, at = [], 0
    for lo, hi in zip(runs[0].tolist(), runs[1].tolist(), strict=True):
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def removal_digests(docs: DataFrame, passes: int = 2) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a 50-byte string that covers it also starts in a
    document with a smaller doc_id.  A null text counts as empty; rows that repeat a
    doc_id are no smaller one to each other, whatever their texts; a null
    doc_id takes no part, so nothing is removed; a long text is read in parts that overlap; an empty table gives an
    empty one; other columns are ignored, and kept by remove_repeats, whatever their names.
    """

    def finish(columns, runs):
        texts = [(t or "").encode() for t in columns["text"].to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                columns["doc_id"].cast(pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([int((hi - lo).sum()) for lo, hi in runs], pa.int64()),
                pa.array([len(lo) for lo, _ in runs], pa.int64()),
                pa.array([hashlib.sha256(kept_bytes(t, r)).hexdigest() for t, r in zip(texts, runs, strict=True)]),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return apply_spans(docs.select("doc_id", "text"), finish, schema, passes)


def remove_repeats(docs: DataFrame, passes: int = 2) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text; a character that a
    removed run cuts goes with it.  Cases as in removal_digests."""
    names = docs.columns

    def finish(columns, runs):
        texts = columns["text"].to_pylist()
        kept = [None if t is None else kept_bytes(t.encode(), r).decode(errors="ignore") for t, r in zip(texts, runs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.string()) if n == "text" else columns[n] for n in names], names=names
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return apply_spans(docs, finish, schema, passes)
