"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

The reader's tasks take byte ranges of the archives. A task scans its range for gzip magic, takes a place for a member
only if its start decodes to a WARC header, and owns the records whose member starts inside the range, reading past
the range's end where the last of them does. After a member that has been read the next one starts where it ended. What
cannot be read is not passed over in silence: a member that is damaged or cut off, bytes between members that are none,
a record whose lengths do not hold or whose payload does not have its digest give a row each with ``error`` set.

Payloads may themselves hold archives, in which a scan would find members that are none of the file's. The writer so
keeps in its manifest where the first member of each ``MARK_BYTES`` begins, and a task that has such marks decodes from the last one before
its range on. A manifest of foreign archives may lack them: then a range that begins inside a stored, incompressible
payload takes an archive's members in it for its own.

Files are reached through ``pyarrow.fs``. The folder's address is made absolute by Spark's own file systems first, so it may
be relative; s3a and s3n stand for s3. The executors must share it. Every attempt of a task writes files of its own, and the manifest, itself a written table,
names those that count.

Defined cases: a null payload counts as empty; a null url gives a record without target; a null id and an empty one are
told apart; rows that repeat the id of
their payload's response are responses too; a row with a null id revisits its payload's response, or is a response if
no row with that payload has an id; an empty table gives no archive and no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglow.llm.common import parts, shared_path, written

MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 20
#: Bytes of a file for which the manifest has one member's place.
MARK_BYTES = 1 << 20
#: A member whose text begins otherwise is none of ours. So many bytes are looked at first, and more only while the gzip head goes on.
VERSION, PROBE_BYTES = b"WARC/1.", 512
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def address(spark: SparkSession, folder: str) -> str:
    """The folder's absolute address, as the session's default file system has it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    scheme, found, rest = folder.partition(":")
    if not found or scheme == "file":
        return pafs.LocalFileSystem(), os.path.abspath("/" + rest.lstrip("/") if found else folder)
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def _urn(key: object) -> str:
    return "urn:none" if key is None else "urn:page:" + quote(str(key), safe="")


def _record(key: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record; a revisit keeps the HTTP head, and with it the length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{key}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _with_originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds original: of at least ``min_bytes``-long equal payloads the largest id, else null.

    Only payloads that occur twice or more are looked up. Their number is counted by a partial aggregate; Spark
    broadcasts them if they are few and else joins by the digest, splitting the partitions of frequent payloads.
    """
    large = pages.where(F.octet_length("payload") >= min_bytes)
    shared = large.groupBy(F.sha2("payload", 256).alias("shared_digest")).agg(F.max("id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(shared, "shared-payloads")
    key = F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256))
    return pages.withColumn("key", key).join(shared, F.col("key") == F.col("shared_digest"), "left").select("id", "url", "payload", "original")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, file_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Writes a record per row, each a gzip member, and returns the manifest: path, bytes, records, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(folder)
        out, path, size, records, marks, done = None, "", 0, 0, [], []
        for batch in batches:
            for part in parts(batch, "payload"):
                for key, url, payload, original in zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload", "original")), strict=True):
                    if out is None:
                        path = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, size, records, marks = fs.open_output_stream(path, compression=None), 0, 0, []
                    if size >= MARK_BYTES * len(marks):
                        marks.append(size)
                    refers_to = None if original is None or key == original else _urn(original)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(_record(_urn(key), url, payload, refers_to)) + packer.flush()
                    out.write(member)
                    size, records = size + len(member), records + 1
                    if size >= file_bytes:
                        out.close()
                        done.append((path, size, records, marks))
                        out = None
        if out is not None:
            out.close()
            done.append((path, size, records, marks))
        if done:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["path", "bytes", "records", "marks"])

    folder = address(pages.sparkSession, folder)
    fs, base = _opened(folder)
    fs.create_dir(base, recursive=True)
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    return written(_with_originals(slim, min_bytes).mapInArrow(run, "path string, bytes long, records long, marks array<long>"), "manifest")


class _Window:
    """A file seen through a buffer that only moves forward; ``at`` is the place in the file, ``here`` that in the buffer."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.data, self.here = file, at, b"", 0
        file.seek(at)

    def fill(self, n: int) -> int:
        """Sees to it that ``n`` bytes are at hand, if the file has them; returns how many are."""
        while len(self.data) - self.here < n and (more := self.file.read(max(READ_BYTES, n))):
            self.data, self.here = self.data[self.here :] + more, 0
        return len(self.data) - self.here

    def peek(self, start: int, n: int) -> bytes:
        return self.data[self.here + start : self.here + start + n]

    def skip(self, n: int) -> None:
        self.here, self.at = self.here + n, self.at + n


def _is_member(window: _Window) -> bool:
    if window.fill(PROBE_BYTES) < 3 or window.peek(0, 3) != MAGIC:
        return False
    unpack, out, seen, step = zlib.decompressobj(31), b"", 0, PROBE_BYTES
    try:
        while len(out) < len(VERSION) and not unpack.eof and (piece := window.peek(seen, step)):
            out += unpack.decompress(piece, len(VERSION))
            seen, step = seen + len(piece), 2 * step
            window.fill(seen + step)
    except zlib.error:
        return False
    return out.startswith(VERSION)


def _member(window: _Window) -> bytes | None:
    """Decodes the member at the window's place and moves behind it; None, unmoved, if it is damaged."""
    unpack, out, used = zlib.decompressobj(31), [], 0
    try:
        while not unpack.eof:
            window.fill(used + 1)
            piece = window.peek(used, READ_BYTES)
            if not piece:
                return None  # cut off
            out.append(unpack.decompress(piece))
            used += len(piece) - len(unpack.unused_data)
    except zlib.error:
        return None
    window.skip(used)
    return b"".join(out)


def members(file: pa.NativeFile, start: int, end: int, mark: int | None = None) -> Iterator[tuple[int, bytes | None, str | None]]:
    """place, decoded member and error, for the members that start in [start, end) and for what should be one but cannot be read.

    ``mark`` is the place of a member, at or before ``start``, from which members are decoded one after the other.
    """
    window, known = _Window(file, start if mark is None else mark), None if mark is None else True
    while mark is not None and known and window.at < start:
        # what is damaged here is told by the range that owns it
        known = True if _member(window) is not None and _is_member(window) else None
    if window.at < start:
        window = _Window(file, start)
    while window.at < end:
        at = window.at
        if _is_member(window) if known is None else known:
            record = _member(window)
            yield at, record, None if record is not None else "damaged or cut off"
            if record is not None:
                known = _is_member(window)
                if not known and window.fill(1):
                    yield window.at, None, "no member here"  # told by the range of the member before it, wherever it lies
                continue
        elif at == 0:
            yield at, None, "no member here"
        known = None
        if window.fill(PROBE_BYTES) < 2:
            return
        found = window.data.find(MAGIC, window.here + 1) - window.here
        # keep two bytes, in which the magic may begin
        window.skip(found if found > 0 else max(1, len(window.data) - window.here - 2))


def _parsed(record: bytes) -> tuple:
    """type, id, target, refers_to, digest, payload length, error and payload of a decoded member."""
    head, found, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    size = fields.get("Content-Length", "")
    if not found or not size.isdigit() or len(rest) < int(size):
        return None, None, None, None, None, None, "lengths do not hold", None
    block = rest[: int(size)]
    http, _, payload = block.partition(b"\r\n\r\n")
    key, refers_to = (m and unquote(m[1]) for m in (re.fullmatch(r"<urn:page:(.*)>", fields.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To")))
    target, digest, kind = fields.get("WARC-Target-URI"), fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), fields.get("WARC-Type")
    if kind == "revisit":
        length = re.search(rb"\r\nContent-Length: (\d+)", http)
        return kind, key, target, refers_to, digest, int(length[1]) if length else None, None, None
    error = None if base32_sha1(payload) == digest else "payload does not have its digest"
    return kind, key, target, None, digest, len(payload), error, payload


RECORD = "record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, error string"


def read_warc(manifest: DataFrame, folder: str, split_bytes: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``manifest`` (path, bytes, and marks if it has them), read by ranges of ``split_bytes``: what it says,
    the path and place of its member, and error, which is null if all is well."""
    schema = RECORD + ", payload binary" * with_payload + ", path string, place long"
    types = [pa.string()] * 5 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload + [pa.string(), pa.int64()]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    folder = address(manifest.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(folder)
        for batch in batches:
            for path, start, end, mark in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "mark")), strict=True):
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for place, record, error in members(file, start, end, mark):
                        row = _parsed(record) if record is not None else (*[None] * 6, error, None)
                        rows.append((*row[: 7 + with_payload], path, place))
                        held += len(row[-1] or b"") if with_payload else 0
                        if len(rows) >= 5000 or held >= 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    marks = F.col("marks") if "marks" in manifest.columns else F.lit(None).cast("array<long>")
    splits = manifest.where("bytes > 0").select("path", "bytes", marks.alias("marks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    before = F.array_max(F.filter("marks", lambda m: m <= F.col("start")))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"), before.alias("mark"))
    return splits.repartition(max(1, splits.count())).mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back: id, digest columns, type, refers_to.

    A record that cannot be read back fails the query.
    """
    kind = pages.schema[id_col].dataType
    folder = shared_path(pages.sparkSession, "warc")
    records = read_warc(write_warc(pages, folder, id_col, url_col, payload_col, min_bytes), folder)
    whole = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", "path", "place", "error")))
    return records.select(F.col("record_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", whole.alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
