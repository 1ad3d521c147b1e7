"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writer.  One gzip member for each record, one file for each task, written through the
file system of the folder's URI under a name of its own; the list of files comes back
only from tasks that succeed, so what a lost or repeated task left behind is not read.
Of records with equal payloads (at least ``dedup_from`` bytes) the one with the largest
id is a response; the others are revisits that name it and carry the HTTP header with
the payload's length but no payload.

Reader.  Files are cut into byte ranges.  A task scans its range for the gzip magic,
validates a candidate by decoding its first bytes (they must begin a WARC header, and
what follows the member must be the end of the file or another such member), and owns
the records that start inside its range, reading beyond its end where the last one
does.  No index and no whole-file read is needed.

Defined cases: a null payload is empty; empty payloads are equal to each other; a null
URL is left out of the header and read back as null; of repeated rows with the largest
id each is a response; a row without id is always a response; a truncated or corrupt record
raises an error that names its file and place; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.spill import settle, shared_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
#: Reading tasks: one for each byte range up to so many; beyond, a task has several.
MAX_TASKS = 100_000
READ_BYTES = 1 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
FILES = "path string, size long, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def open_folder(uri: str):
    """A pyarrow file system and the folder's path in it; the folder exists afterwards."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system, path


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, level: int = LEVEL) -> bytes:
    """A record as one gzip member.  ``payload`` is empty for a revisit, ``size`` is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~-._' + chr(39))}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    parts = [packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http), packer.compress(payload), packer.compress(b"\r\n\r\n"), packer.flush()]
    return b"".join(parts)


def decode_record(data: bytes, with_payload: bool) -> tuple:
    """A tuple of RECORDS from the bytes of a whole record; a response's digest is checked against its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("the record is shorter than its Content-Length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("the payload does not agree with its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("WARC-Target-URI")
    return number("X-Page"), None if url is None else unquote(url), fields["WARC-Type"], number("X-Refers-To-Page"), size, digest, payload if with_payload and not revisit else None


def _writer(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        name, out, size, records = f"{path.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, n, hexed, refers_to = (batch.column(c)[i].as_py() for c in range(6))
                payload = b"" if refers_to is not None or html is None else html.encode()
                member = encode_record(page_id, url, payload, n, base64.b32encode(bytes.fromhex(hexed)).decode(), refers_to, level)
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "size", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", dedup_from: int = 0, level: int = LEVEL) -> DataFrame:
    """Writes a record for each row and returns the files (name in the folder, size, records)."""
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = rows.select("page", "url", "html", F.octet_length(body).cast("long").alias("n"), F.sha1(body).alias("digest"))
    # Narrow rows find the copies: minima are aggregated before the shuffle, and only groups of two and more go on.
    narrow = rows.select("page", "n", "digest").where(F.col("n") >= dedup_from)
    copies = narrow.groupBy("digest").agg(F.max("page").alias("kept"), F.count("*").alias("m")).where("m > 1 and kept is not null").select("digest", "kept")
    refers = narrow.join(copies, "digest").where("page < kept").select("page", "digest", F.col("kept").alias("refers_to")).distinct()
    marked = rows.join(refers, ["page", "digest"], "left").select("page", "url", "html", "n", "digest", "refers_to")
    return settle(marked.mapInArrow(_writer(folder, level), FILES))


def members(source, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of every record that starts in [start, end) of an open file."""
    buffer, at = b"", start  # buffer begins at file offset ``at``

    def fill(to: int) -> None:
        nonlocal buffer
        while at + len(buffer) < min(to, size):
            source.seek(at + len(buffer))
            more = source.read(min(READ_BYTES, size - at - len(buffer)))
            if not more:
                break
            buffer += more

    def begins(offset: int) -> bool:
        fill(offset + 4096)
        part = buffer[offset - at : offset - at + 4096]
        if not part.startswith(MAGIC):
            return False
        try:
            return zlib.decompressobj(31).decompress(part, 16).startswith(b"WARC/")
        except zlib.error:
            return False

    def whole(offset: int) -> tuple[bytes, int] | None:
        unpack, parts, pos, step = zlib.decompressobj(31), [], offset, 8192
        while not unpack.eof:
            fill(pos + step)
            chunk = buffer[pos - at : pos - at + step]
            step = min(2 * step, READ_BYTES)
            if not chunk:
                return None
            try:
                parts.append(unpack.decompress(chunk))
            except zlib.error:
                return None
            pos += len(chunk)
        return b"".join(parts), pos - len(unpack.unused_data)

    pos, chained = start, False
    while pos < end:
        if not begins(pos):
            if chained:
                raise ValueError(f"no record at byte {pos}")
            fill(end + 2)
            found = buffer.find(MAGIC, pos + 1 - at)
            if found < 0 or at + found >= end:
                return
            pos = at + found
            continue
        got = whole(pos)
        if got is None or (got[1] < size and not begins(got[1])):
            if chained or pos == 0:
                raise ValueError(f"the record at byte {pos} is corrupt or cut off")
            pos += 1
            continue
        yield pos, got[0]
        pos, chained = got[1], True
        if pos - at > 4 * READ_BYTES:
            buffer, at = buffer[pos - at :], pos


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            for name, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                out = []
                with system.open_input_file(f"{path.rstrip('/')}/{name}") as source:
                    try:
                        for offset, data in members(source, size, start, end):
                            try:
                                out.append(decode_record(data, with_payload))
                            except (ValueError, KeyError) as e:
                                raise ValueError(f"record at byte {offset}: {e}") from e
                            if len(out) >= 500:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                                out = []
                    except ValueError as e:
                        raise ValueError(f"{name}: {e}") from e
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return read


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder that something else wrote, with their sizes."""
    from pyarrow import fs

    system, path = open_folder(folder)
    found = [(i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name.endswith((".warc.gz", ".warc"))]
    return spark.createDataFrame(sorted(found), "path string, size long")


def read_archives(files: DataFrame, folder: str, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the files, each byte range read by whichever task it falls to.  The number of tasks follows the ranges: rows of ranges are tiny, so that a partitioning left to their size would put them into one task."""
    split = F.lit(split_bytes).cast("long")
    last = F.floor((F.col("size") - 1) / split)
    n = files.where("size > 0").agg(F.coalesce(F.sum(last + 1), F.lit(0)).cast("long")).first()[0]
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i")).select("path", "size", (F.col("i") * split).alias("start"), F.least((F.col("i") + 1) * split, "size").alias("end"))
    return ranges.repartition(max(1, min(n, MAX_TASKS))).mapInArrow(_reader(folder, with_payload), RECORDS)


def contract(spark, sf_dir: str) -> DataFrame:
    """The digest of op6 for every page."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(files, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
