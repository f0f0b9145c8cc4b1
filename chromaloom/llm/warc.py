"""Operator 3: WARC archives with an index first, read back by coalesced byte ranges.

Writing gives an index row per record: file, offset, length, URL, digest.  Equal
payloads are stored once, as a response; the others are revisits of it.  Reading
starts from the index: the records that are wanted are sorted by file and offset,
neighbouring ranges are read together, and each record is parsed from its bytes.

Each task writes files of its own under a fresh name, and only files that the
index names are read, so a task that is lost or run twice does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_map, shared_path, written

#: Bytes of an archive file after which the next one begins.
FILE_BYTES = 256 << 20
#: Ranges nearer than this are read in one go, of this many bytes at most unless one record is larger.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Neighbouring records of so many bytes go to one task together, and a task gets so many bytes on average.
CHUNK_BYTES, TASK_BYTES = 1 << 20, 16 << 20
#: Smaller payloads are always stored.
MIN_PAYLOAD = 0
_DATE = b"2024-01-01T00:00:00Z"
_INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


def record_bytes(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.0 record as a gzip member of its own; a revisit has the HTTP header only."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        b"WARC/1.0",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%d>" % page_id,
        b"WARC-Target-URI: " + url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A"),
        b"WARC-Date: " + _DATE,
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        body += payload
    else:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head.append(b"Content-Length: %d" % len(body))
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (both by lower-case name) and payload of a record."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")

    def fields(lines: list[bytes]) -> dict[str, str]:
        return {name.decode().lower(): value.strip().decode() for name, _, value in (line.partition(b":") for line in lines)}

    warc = fields(head.split(b"\r\n")[1:])
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http.split(b"\r\n")[1:]), payload


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _digested(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    payload = F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write a record per page below ``folder`` and return the index.

    Of equal payloads of ``min_payload`` bytes or more the page with the
    largest id is the response and the others revisit it; rows that repeat that
    id are responses each.  A null page is an empty payload, a null URL the
    empty one; rows with a null id have no record, since nothing could name it;
    a payload of any length is one record; an empty table gives an empty index;
    other columns are not read.
    """
    rows = _digested(pages, id_column, url_column, html_column).where(F.col("page_id").isNotNull())
    # the digest is computed once, beside the id; the payloads themselves are not shuffled for it
    keys = written(rows.select("page_id", F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("bytes")), "payload-keys")
    groups = keys.where(F.col("bytes") >= min_payload).groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    # unique payloads are responses without being looked up
    keepers = written(groups.where("copies > 1").select("key", "keeper"), "keepers")
    met = rows.withColumn("key", F.sha2("payload", 256)).join(keepers, "key", "left") if not keepers.isEmpty() else rows.withColumn("keeper", F.lit(None).cast("long"))
    met = met.select("page_id", "url", "payload", F.when((F.col("keeper") != F.col("page_id")) & (F.octet_length("payload") >= min_payload), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    record = record_bytes(page_id, url, payload, digest, refers_to)
                    out.write(record)
                    index.append((page_id, url, digest, len(payload), "response" if refers_to is None else "revisit", refers_to, name, at, len(record)))
                    at += len(record)
                columns = list(zip(*index, strict=True)) or [[]] * 9
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                # the rows leave only after their bytes are in the file
                out and out.flush()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return written(arrow_map(met, run, _INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Records of the index rows: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``.

    Rows are dealt by file and stretch of the file, into as many tasks as the
    bytes of the records ask for, not those of the index; of a revisit the
    payload is null and its size and digest are those its header states.  A
    record whose payload differs from its digest is an error.  Records that the
    index names twice come twice; an empty index gives no records; a record of
    any length is read whole.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    tasks = max(-(-total // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, -(-total // CHUNK_BYTES)), 1)
    stretch = F.floor(F.col("offset") / CHUNK_BYTES)
    rows = index.select("file", "offset", "length").repartition(int(tasks), "file", stretch).sortWithinPartitions("file", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Records that are read in one go."""
        file, held = "", []
        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                near = held and name == file and offset - sum(held[-1]) <= GAP_BYTES and offset + length - held[0][0] <= READ_BYTES
                if held and not near:
                    yield file, held
                    held = []
                file = name
                held.append((offset, length))
        if held:
            yield file, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        opened, source = "", None
        for name, held in ranges(batches):
            if name != opened:
                if source is not None:
                    source.close()
                opened, source = name, files.open_input_file(f"{base}/{name}")
            first = held[0][0]
            data = memoryview(source.read_at(sum(held[-1]) - first, first))
            out: list[tuple] = []
            for offset, length in held:
                warc, http, payload = parse_record(data[offset - first : offset - first + length])
                page_id = int(warc["warc-record-id"].removeprefix("<urn:page:").removesuffix(">"))
                digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                refers_to = None
                if warc["warc-type"] == "response":
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                        raise ValueError(f"record {page_id} in {name} at {offset} differs from its digest")
                else:
                    refers_to, payload = int(warc["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")), None
                out.append((page_id, warc["warc-target-uri"], size, digest, warc["warc-type"], refers_to, payload))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if source is not None:
            source.close()

    return arrow_map(rows, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_folder(pages: DataFrame) -> str:
    """A fresh folder for archives in the shared folder."""
    return shared_path(pages.sparkSession, "warc")
