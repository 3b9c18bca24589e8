"""Web archives (WARC) with a two-level capture index.

Every page is one gzip member, so a record is read by its place in a file without the
rest. A payload that was kept before is a *revisit*: it names the record that has it.

The index sorts captures by key, the address with its host reversed, so that a site's
pages are neighbours. Sorted lines are packed into compressed blocks, and a sparse
directory holds each block's first and last key. A look-up searches the directory by
halves for the blocks that can hold a key, groups keys by block, reads each block once
by its range, searches its lines by halves, and reads the records by theirs.

Files are written by tasks to the shared folder, under names no other attempt uses; a
file counts only if its captures were committed, so a lost task leaves nothing behind
that is read. Range reads and writes go through ``pyarrow.fs``, so the folder may be in
any store that it reaches.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from textprov.llm.arrow import lean
from textprov.session import materialize, run_dir

LEAST = 1000  # bytes of a payload that a revisit may stand for
LINES = 1000  # captures in a block of the index
FILE = 64 << 20  # bytes after which a task begins another file
DIRECTORY = 16 << 20  # bytes of directory that are sent to tasks at once
DATE = "1970-01-01T00:00:00Z"  # of records whose page has no date
LEVEL = 6

CAPTURE = "key string, page_id long, file string, offset long, length long"


def reversed_key(url: str | None) -> str:
    """``com,example,www)/path?query`` of an address; empty for none."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host, port = parts.hostname or "", parts.port
    except ValueError:  # no address at all: sort it by itself
        return url.lower()
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{name}){path}" if name else url.lower()


def _field(value: str) -> str:
    """A header's value: no line breaks."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def record(page, url: str, payload: bytes, digest: str, refers, date: str = DATE) -> bytes:
    """One WARC record; ``refers`` is the page that has the payload, or None."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers is not None else http + payload
    named = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_field(url)}",
        f"WARC-Payload-Digest: sha1:{named}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_id(refers, digest)}",
            f"X-Refers-To-Page-ID: {refers}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of one record; a revisit has no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if size != int(sent["Content-Length"]):
            raise ValueError("the payload is cut short")
    else:
        digest, size = None, int(sent["Content-Length"])
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if digest not in (None, named):
        raise ValueError("the payload does not match its digest")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": named,
        "record_type": kind,
        "refers_to": None if refers is None else int(refers),
        "payload": payload if kind == "response" else None,
    }


def _place(name: str):
    """The store and path of a file's name; ``file:/x`` is how some stores spell ``/x``."""
    return fs.FileSystem.from_uri("/" + name[5:].lstrip("/") if name.startswith("file:") else name)


class _Files:
    """Files that one task writes, each below ``FILE`` bytes or of one record."""

    def __init__(self, folder: str, ending: str):
        self.folder, self.ending, self.out = folder, ending, None

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at + len(data) > FILE and self.at:
            self.close()
            self.name = f"{self.folder}/{uuid.uuid4().hex}.{self.ending}"
            store, path = _place(self.name)
            store.create_dir(path.rpartition("/")[0])
            self.out, self.at = store.open_output_stream(path, compression=None), 0
        place = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, place

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None


class _Reader:
    """Range reads, the last file kept open."""

    name = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            store, path = _place(name)
            self.file, self.name = store.open_input_file(path), name
        return self.file.read_at(length, offset)


def write_archive(
    df: DataFrame,
    page: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST,
    folder: str | None = None,
) -> DataFrame:
    """Write one record for each row; ``key, page_id, file, offset, length`` of each.

    Of rows with equal payloads of ``least`` bytes or more the one with the largest page
    is the response and the others are revisits of it. Digests are compared as narrow,
    pre-aggregated rows; pages then meet the digests that repeat.

    Defined results: a null page text is the empty payload, a null address the empty one;
    a null page is smaller than all others, and without any page number every record is a
    response; rows that repeat the largest page are all responses; other columns are not
    looked at; an empty table gives an empty archive.
    """
    spark = df.sparkSession
    folder = folder or run_dir(spark, "archive")
    pages = lean(df).select(
        F.col(page).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    again = (
        pages.where(F.length("payload") >= least)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("holder"))
        .where("n > 1 and holder is not null")
        .select("_digest", "holder")
    )
    again = materialize(again, "digests")
    other = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    rows = pages.join(again, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "digest", F.when(other, F.col("holder")).alias("refers"), "payload"
    )

    def run(batches):
        files = _Files(folder, "warc.gz")
        try:
            for b in batches:
                out = []
                for i in range(b.num_rows):
                    p, u, d, r = (b.column(c)[i].as_py() for c in range(4))
                    data = record(p, u, b.column(4)[i].as_py(), d, r)
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = pack.compress(data) + pack.flush()
                    name, at = files.add(member)
                    out.append((reversed_key(u), p, name, at, len(member)))
                if out:
                    yield _captures(out)
        finally:
            files.close()

    return materialize(rows.mapInArrow(run, CAPTURE), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
        names=["key", "page_id", "file", "offset", "length"],
    )


def build_index(captures: DataFrame, folder: str | None = None, lines: int = LINES) -> DataFrame:
    """Write the sorted blocks; the directory: ``first, last, file, offset, length, n``.

    Captures are sorted by range over key and place, so a key with very many captures
    fills blocks in several tasks.
    """
    folder = folder or run_dir(captures.sparkSession, "index")
    order = ["key", "file", "offset"]
    ordered = captures.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        files = _Files(folder, "idx")
        held: list[tuple] = []

        def block():
            data = zlib.compress(
                "\n".join(json.dumps(r) for r in held).encode(), LEVEL
            )
            name, at = files.add(data)
            return held[0][0], held[-1][0], name, at, len(data), len(held)

        try:
            for b in batches:
                done = []
                for row in zip(*[c.to_pylist() for c in b.columns]):
                    held.append(row)
                    if len(held) == lines:
                        done.append(block())
                        held.clear()
                if done:
                    yield _blocks(done)
            if held:
                yield _blocks([block()])
        finally:
            files.close()

    return materialize(
        ordered.mapInArrow(
            run, "first string, last string, file string, offset long, length long, n long"
        ),
        "directory",
    )


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    names = ["first", "last", "file", "offset", "length", "n"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def _slices(directory: DataFrame, limit: int):
    """The directory in order, in slices of bounded bytes, one on the driver at a time."""
    held, size = [], 0
    for r in directory.orderBy("first", "last", "file", "offset").toLocalIterator():
        held.append(tuple(r))
        size += len(r["first"]) + len(r["last"]) + len(r["file"]) + 64
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def lookup(
    keys: DataFrame, directory: DataFrame, key: str = "key", limit: int = DIRECTORY
) -> DataFrame:
    """The captures of every key: ``key, page_id, file, offset, length``.

    Keys are looked up once each; keys that the index does not have give no row, nor
    does a null key. The directory goes to tasks in slices of at most ``limit`` bytes.
    """
    wanted = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    spark, out = keys.sparkSession, None
    for part in _slices(directory, limit):
        sent = spark.sparkContext.broadcast(part)

        def blocks(batches, sent=sent):
            part = sent.value
            first, last = [r[0] for r in part], [r[1] for r in part]
            for b in batches:
                found = []
                for k in b.column(0).to_pylist():
                    lo, hi = bisect.bisect_left(last, k), bisect.bisect_right(first, k)
                    found += [(k, *part[i][2:5]) for i in range(lo, hi)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in zip(*found)], names=["key", "file", "offset", "length"]
                    )

        near = wanted.mapInArrow(blocks, "key string, file string, offset long, length long")
        out = near if out is None else out.union(near)
    if out is None:
        return spark.createDataFrame([], CAPTURE)
    ordered = out.repartition("file", "offset").sortWithinPartitions("file", "offset")

    def read(batches):
        reader, at, rows, names = _Reader(), None, [], []
        for b in batches:
            found = []
            for k, file, offset, length in zip(*[c.to_pylist() for c in b.columns]):
                if at != (file, offset):
                    at = file, offset
                    data = zlib.decompress(reader.read(file, offset, length))
                    rows = [json.loads(line) for line in data.split(b"\n")]
                    names = [r[0] for r in rows]
                lo, hi = bisect.bisect_left(names, k), bisect.bisect_right(names, k)
                found += rows[lo:hi]
            if found:
                yield _captures(found)

    return ordered.mapInArrow(read, CAPTURE)


def read_records(captures: DataFrame, payload: bool = False) -> DataFrame:
    """Read records by their ranges: ``page_id, url, payload_bytes, payload_digest,
    record_type, refers_to``, and ``payload`` where asked for and there.

    Payloads are checked against their length and digest; a record that fails raises.
    """
    ordered = lean(captures).repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    ordered = ordered.select("file", "offset", "length")
    schema = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ] + [("payload", pa.binary())] * payload

    def run(batches):
        reader = _Reader()
        for b in batches:
            rows = [
                parse(zlib.decompress(reader.read(file, at, n), 47))
                for file, at, n in zip(*[c.to_pylist() for c in b.columns])
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], kind) for c, kind in schema],
                names=[c for c, _ in schema],
            )

    sql = {"int64": "long", "string": "string", "binary": "binary"}
    return ordered.mapInArrow(run, ", ".join(f"{c} {sql[str(k)]}" for c, k in schema))


def archive_keys(df: DataFrame, url: str = "url") -> DataFrame:
    """``key`` of every row's address, by which the index is searched."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([reversed_key(u) for u in b.column(0).to_pylist()], pa.string())],
                names=["key"],
            )

    return df.select(F.coalesce(F.col(url), F.lit(""))).mapInArrow(run, "key string")
