"""WARC archives: a writer with revisit records, and a splittable reader.

*Writing.* Every record is a gzip member of its own. Of records with equal payloads
of at least ``min_bytes``, that with the smallest page_id is a response and the
others revisit it; they keep the HTTP header, whose Content-Length is that of the
full payload, and name the response. Only digests are shuffled to find them out; the
list of revisits then joins the pages, which shuffles them once where Spark finds that
list too large to broadcast.

*Reading.* Files are cut into byte ranges without regard to records. A range's task
looks for gzip's magic bytes, takes a place as a member's start only if its header
is a valid one and the first bytes that it inflates to begin a WARC record with
well-formed header lines, and owns the records whose members start inside its
range, whatever their end. A member that isn't one is passed over.

Defined cases: a null payload is an empty one. A null page_id makes a response that
nothing refers to. Rows that repeat a page_id with equal payloads are responses
each. Other columns are ignored. An empty table writes no record. A payload may be
as long as a binary value may (2 GB).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._hot import join_by_count
from ._store import dispose, materialize, new_path, trimmed

#: Bytes of one range of a reader's task.
RANGE_BYTES = 32 << 20
#: Ranges of one task, where they are many.
TASK_RANGES = 16
#: Records of one archive file.
FILE_RECORDS = 20_000
#: Uncompressed bytes of one archive file, but for its last record.
FILE_BYTES = 256 << 20
#: Deflate level of the writer.
LEVEL = 1

_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- records -----------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has no payload of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    name = "none" if page_id is None else str(page_id)
    target = " ".join((url or "").split()) or "about:blank"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """``data`` as a gzip member, without a time."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + c.compress(data) + c.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class BadRecord(ValueError):
    """Bytes that aren't a WARC record."""


def header_fields(head: bytes) -> dict[str, str]:
    """The fields of a record's header, by lower-case name."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(_VERSION):
        raise BadRecord("no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise BadRecord("a header line isn't a field")
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        raise BadRecord("a header lacks its type or length")
    return fields


def parse_record(data: bytes) -> dict:
    """Fields, HTTP header and payload of an inflated member."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        raise BadRecord("no end of header")
    fields = header_fields(data[:cut])
    size = int(fields["content-length"])
    block = data[cut + 4 : cut + 4 + size]
    if len(block) < size:
        raise BadRecord("the block is cut off")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"), len(payload))
    return {"fields": fields, "http": http, "payload": payload if gap else block, "length": length}


def _name(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record_row(data: bytes) -> dict:
    """A record as a row: page_id, url, type, whom it refers to, full payload length, digest, payload."""
    r = parse_record(data)
    f = r["fields"]
    size, (label, _, digest) = r["length"], f.get("warc-payload-digest", "").rpartition(":")
    if f["warc-type"] == "response":  # measured on what was read; a revisit has its headers alone
        found = payload_digest(r["payload"])
        if len(r["payload"]) != size or (digest and label.lower() in ("", "sha1") and found != digest):
            raise BadRecord("a response's payload disagrees with its header")
        digest = found
    return {
        "page_id": _name(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "refers_to": _name(f.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest, "payload": r["payload"] if f["warc-type"] != "revisit" else None,
    }


# -- splittable reading ------------------------------------------------------------


def _candidate(buffer: bytes, at: int) -> bool:
    """Whether a member that begins a WARC record may start at a place: decodes its first bytes."""
    if buffer[at + 3] & 0xE0:  # reserved flags
        return False
    try:
        d = zlib.decompressobj(31)
        head = d.decompress(buffer[at : at + 4096], 2048)
    except zlib.error:
        return False
    if not head.startswith(_VERSION[: len(head)]) or len(head) < len(_VERSION):
        return False
    end = head.find(b"\r\n\r\n")
    try:
        header_fields(head[:end] if end >= 0 else head[: head.rfind(b"\r\n")] + b"\r\nwarc-type: x\r\ncontent-length: 0")
    except BadRecord:
        return False
    return True


class _Window:
    """A file's bytes from a place on, read as needed."""

    def __init__(self, file: pa.NativeFile, start: int, size: int, step: int = 1 << 20):
        self.file, self.start, self.size, self.step, self.data = file, start, size, step, b""

    def upto(self, end: int) -> None:
        """Makes the bytes before ``end`` present, where the file has them."""
        have = self.start + len(self.data)
        if end > have:
            self.file.seek(have)
            self.data += self.file.read(max(end - have, self.step))

    def forget(self, before: int) -> None:
        if before - self.start >= self.step:
            self.data = self.data[before - self.start :]
            self.start = before

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """(what the member that starts at a place inflates to, its end), or nothing; pieces are dropped once they are fed."""
        out, d, place = [], zlib.decompressobj(31), at
        piece = self.data[at - self.start :]
        try:
            while True:
                out.append(d.decompress(piece))
                place += len(piece) - len(d.unused_data)
                if d.eof:
                    break
                self.file.seek(place)
                piece = self.file.read(min(self.step, self.size - place))
                if not piece:
                    return None  # the file ends within it
        except zlib.error:
            return None
        if place > self.start + len(self.data):
            self.start, self.data = place, b""
        return b"".join(out), place


def read_range(file: pa.NativeFile, lo: int, hi: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, inflated bytes) of the members that start in lo..hi-1."""
    w, at = _Window(file, lo, size), lo
    while at < min(hi, size):
        w.upto(min(at + 8192, size))
        spot = w.data.find(_MAGIC, at - w.start)
        if spot < 0:
            at = max(at, w.start + len(w.data) - 2)
            if w.start + len(w.data) >= size:
                return
            w.upto(min(at + w.step, size))
            w.forget(at)
            continue
        at = w.start + spot
        if at >= hi:
            return
        w.upto(min(at + 8192, size))
        if len(w.data) - spot < 18 or not _candidate(w.data, spot):
            at += 1
            continue
        found = w.inflate(at)
        if found is None:
            at += 1
            continue
        yield at, found[0]
        at = found[1]
        w.forget(at)


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """(path, lo, hi, size) of every byte range of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    cut = files.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))))
    return cut.select("path", "lo", F.least(F.col("lo") + range_bytes, F.col("size")).alias("hi"), "size")


_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def open_file(path: str) -> pa.NativeFile:
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    return where.open_input_file(inner)


def _uri(path: str) -> str:
    """file:/x as file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _ARROW if with_payload else pa.schema(list(_ARROW)[:-1])
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                with open_file(_uri(r["path"])) as f:
                    for _, data in read_range(f, r["lo"], r["hi"], r["size"]):
                        rows.append(record_row(data))
                        held += len(data)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_warc(spark: SparkSession, path: str, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all .warc.gz files below a folder, one row each."""
    ranges = _ranges(spark, path, range_bytes)
    schema = _RECORD if payload else _RECORD.rpartition(",")[0]
    many = ranges.count()
    each = min(TASK_RANGES, max(1, many // (4 * spark.sparkContext.defaultParallelism)))
    return ranges.repartition(max(1, -(-many // each))).mapInArrow(trimmed(_read(payload)), schema)


# -- writing -----------------------------------------------------------------------


def _html() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "utf-8")


def _sha1() -> Column:
    return F.unhex(F.sha1(_html()))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages whose payload a smaller page_id has too."""
    seen = pages.select("page_id", _sha1().alias("sha1"), F.octet_length(_html()).alias("n")).where("page_id is not null").where(F.col("n") >= min_bytes)
    seen = materialize(seen.select("page_id", "sha1"), "digests")
    first = seen.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("times")).where("times > 1")
    first = materialize(first, "repeated")
    found = join_by_count(seen, first, ["sha1"], "times", seen.count())
    found = materialize(found.where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct(), "revisits")
    dispose(seen, first)
    return found


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(folder)
        where.create_dir(inner, recursive=True)
        c = TaskContext.get()
        k, out, n, held = 0, None, 0, 0
        temp = name = ""
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    name = f"{inner}/part-{c.partitionId():06d}-{k:04d}.warc.gz"
                    temp = f"{inner}/.part-{c.partitionId():06d}-{k:04d}-{c.taskAttemptId()}"
                    out, n, held, k = where.open_output_stream(temp), 0, 0, k + 1
                payload = (html or "").encode()
                data = record_bytes(page_id, url, payload, payload_digest(payload), refers_to)
                out.write(member(data))
                n, held = n + 1, held + len(data)
                if n >= FILE_RECORDS or held >= FILE_BYTES:
                    out.close()
                    where.move(temp, name)  # whole files alone get their name; a second attempt writes the same one
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            where.move(temp, name)
            done.append((name, n))
        if done:
            yield pa.record_batch([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["file", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, revisit_of: DataFrame | None = None) -> int:
    """Writes a record per row of ``pages`` (page_id, url, html) to .warc.gz files; gives their number."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    again = revisits(pages, min_bytes) if revisit_of is None else revisit_of
    marked = pages.withColumn("sha1", _sha1()).join(again, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")
    return marked.mapInArrow(trimmed(_write(_uri(folder))), "file string, records long").agg(F.sum("records")).first()[0] or 0


def archive_digest(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads the records' digests back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    if not write_warc(pages, folder, min_bytes):
        return spark.createDataFrame([], T._parse_datatype_string("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    return read_warc(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
