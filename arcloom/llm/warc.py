"""WARC archives with a two-level capture index.

Records are gzip members of WARC 1.1 files in a folder that all executors
share, written and range-read through ``pyarrow.fs`` so that any file system
it knows will do.  The index is sorted by reversed-host URL key and cut into files of
compressed blocks of entries, each with a sparse directory of the first and last key of
its blocks.  A search deals keys to the files that their ranges name; a task bisects a
file's directory, then the block, and then reads the records' ranges.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from dataclasses import dataclass
from functools import cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import cut, shared_dir, shuffle_partitions

#: payloads below this many bytes are never revisits
LEAST_REVISIT = 100
BLOCK_ENTRIES = 1000
DATE = "2024-01-01T00:00:00Z"
#: fixed values of the WARC standard
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

ENTRY = "key string, page_id long, file string, offset long, length long"
BLOCK = "first string, last string, file string, offset long, length long, n int"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then the path and query.

    A string that is no URL is its own host, its port included where that is no number.
    """
    whole = (url or "").strip().lower()
    try:
        parts = urlsplit(whole if "//" in whole else "//" + whole)
        host, port = parts.hostname or "", None
        tail = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    except ValueError:
        host, port, tail = whole, None, "/"
    else:
        try:
            port = parts.port
        except ValueError:
            host = parts.netloc
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail
    return key.replace("\n", "%0A").replace("\t", "%09")


@cache
def _store(root: str):
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", root)
    return fs.FileSystem.from_uri(root)


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{"" if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> dict:
    """Headers, HTTP headers and payload of one gzip-compressed record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


class Reader:
    """Range reads, with the files last used kept open."""

    def __init__(self, root: str, most: int = 64):
        self.fs, self.path = _store(root)
        self.open: OrderedDict = OrderedDict()
        self.most = most

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.pop(name, None) or self.fs.open_input_file(f"{self.path}/{name}")
        self.open[name] = f
        if len(self.open) > self.most:
            self.open.popitem(last=False)[1].close()
        f.seek(offset)
        return f.read(length)

    def directory(self, name: str) -> tuple[list[str], list[str], list[tuple[int, int]]]:
        """First keys, last keys and places of an index file's blocks."""
        with self.fs.open_input_file(f"{self.path}/{name}.dir") as f:
            raw = zlib.decompress(f.read()).decode()
        rows = [line.split("\t") for line in raw.split("\n")]
        return [r[0] for r in rows], [r[1] for r in rows], [(int(r[2]), int(r[3])) for r in rows]

    def block(self, name: str, offset: int, length: int) -> list[list[str]]:
        return [line.split("\t") for line in zlib.decompress(self.read(name, offset, length)).decode().split("\n")]

    def record(self, entry: list[str]) -> tuple:
        found = parse(self.read(entry[2], int(entry[3]), int(entry[4])))
        headers = found["headers"]
        refers = headers.get("WARC-Refers-To")
        if refers is None:
            size, digest = len(found["payload"]), hashlib.sha256(found["payload"]).hexdigest()
        else:
            size, digest = int(found["http"]["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
        return _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], refers and _page(refers)


@dataclass
class Archive:
    """A written archive: the folder, and the block directory ordered by key."""

    root: str
    directory: DataFrame

    def records(self) -> DataFrame:
        """All records, read block by block of the index."""
        root = self.root

        def run(batches):
            reader = Reader(root)
            for b in batches:
                for name, offset, length in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    rows = [reader.record(entry) for entry in reader.block(name, offset, length)]
                    yield _batch(rows)

        return self.directory.repartition(shuffle_partitions(self.directory.sparkSession)).mapInArrow(run, RECORD)

    def lookup(self, urls: DataFrame) -> DataFrame:
        """The records captured for column ``url`` of ``urls``, each once; a null url asks for
        captures without a target.

        Distinct keys are dealt to the index files whose ranges hold them, found by
        bisection in one pair of keys for each file; the blocks' directories stay with
        the files.  A task takes a file's keys in order, bisects its directory and reads each
        block that may hold one once.  The captures of a key that fills several files are searched
        in each of them, by different tasks.
        """
        root = self.root
        files = sorted((r.first, r.last, r.file) for r in self.directory.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect())
        firsts, lasts, names = ([f[k] for f in files] for k in range(3))

        def keys(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

        def deal(batches):
            for b in batches:
                dealt = [(names[k], key) for key in b.column(0).to_pylist() for k in range(bisect_left(lasts, key), bisect_right(firsts, key))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in dealt], pa.string()) for i in range(2)], names=["file", "key"])

        def search(batches):
            reader, now = Reader(root), None
            for b in batches:
                found = []
                for name, key in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                    if name != now:
                        now, at = name, None
                        starts, stops, places = reader.directory(name)
                    for k in range(bisect_left(stops, key), bisect_right(starts, key)):
                        if k != at:
                            at, entries = k, reader.block(name, *places[k])
                            own = [e[0] for e in entries]
                        found += [reader.record(e) for e in entries[bisect_left(own, key) : bisect_right(own, key)]]
                        if len(found) >= BLOCK_ENTRIES:
                            yield _batch(found)
                            found = []
                yield _batch(found)

        asked = urls.select("url").mapInArrow(keys, "key string").distinct().mapInArrow(deal, "file string, key string")
        return asked.repartition("file").sortWithinPartitions("file", "key").mapInArrow(search, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")]
    )


def write_archive(pages: DataFrame, root: str | None = None) -> Archive:
    """Write ``pages`` (page_id, url, html) as WARC files with their index.

    Of equal payloads of 100 bytes or more the one with the smallest page_id is
    a response, the others are revisits of it (rows that repeat that page_id
    are responses too).  A null html is an empty payload, a null url has no
    target, a null page_id gives a response without a number; a long payload is one record; an
    empty table gives an archive without files; other columns are ignored.
    """
    spark = pages.sparkSession
    root = root or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, path = _store(root)
    fs.create_dir(path, recursive=True)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = cut(
        rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    refers: Column = F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to")
    typed = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers)

    def write(batches):
        fs, path = _store(root)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for b in batches:
            entries = []
            for page, url, html, digest, refers in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = _record(page, url, html.encode(), digest, refers)
                out.write(member)
                entries.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            if entries:
                yield _rows(entries, ENTRY)
        if out is not None:
            out.close()

    entries = cut(typed.mapInArrow(write, ENTRY))

    def index(batches):
        fs, path = _store(root)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        out, at, held = None, 0, []
        directory = []

        def put(lines):
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            block = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode())
            out.write(block)
            directory.append((lines[0][0], lines[-1][0], name, at, len(block), len(lines)))
            at += len(block)

        for b in batches:
            held += zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)
            while len(held) >= BLOCK_ENTRIES:
                put(held[:BLOCK_ENTRIES])
                del held[:BLOCK_ENTRIES]
        if held:
            put(held)
        if out is not None:
            out.close()
            sparse = "\n".join("\t".join(map(str, (first, last, offset, length))) for first, last, _, offset, length, _ in directory)
            with fs.open_output_stream(f"{path}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(sparse.encode()))
            yield _rows(directory, BLOCK)

    ordered = entries.repartitionByRange(shuffle_partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id")
    return Archive(root, cut(ordered.mapInArrow(index, BLOCK)))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields]
    )


ORACLE = """
WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
d AS (SELECT page_id, strlen(p) AS payload_bytes, sha256(p) AS payload_digest FROM t),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
