"""WARC archives: a distributed writer and a splittable reader of gzip members."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.llm.storage import shared_folder, stable

#: Bytes of an archive that a reading task scans for members starting in them.
SPLIT_BYTES = 8 << 20
#: Tasks that read archives at most; beyond, a task reads several ranges.
MOST_TASKS = 20_000
#: Bytes read from an archive at once, and bytes of a member inflated at once.
READ_BYTES = 1 << 20
INFLATE_BYTES = 1 << 14
#: Records that a writing task puts in one archive before it begins the next.
ARCHIVE_BYTES = 1 << 30

# Fixed values of the gzip and WARC formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
WARC_VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "path string, bytes long, records long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, path string, offset long"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(page_id, url, html, record_type, refers_to) -> bytes:
    """One record as a gzip member of its own. A revisit has the HTTP header only, which still tells the payload's size."""
    payload = (html or "").encode("utf-8")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if record_type == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = WARC_VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head + block + b"\r\n\r\n") + gz.flush()


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with record_type and refers_to: of rows with equal payloads, that with the largest
    page_id is the response and the others revisit it. A null html is the empty payload; a null page_id is below all
    others; of rows that repeat page_id and payload, one is the response.

    Payloads are compared by SHA-256. The groups are aggregated on the map side, so only a pair per page and task moves;
    the join back is one that Spark splits where a group is large.
    """
    rows = stable(pages.select("page_id", "url", "html")).select("*", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("payload_key", F.unhex(F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)))
    order = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))
    groups = rows.groupBy("payload_key").agg(F.max(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    chosen = rows.select("row", "payload_key").join(groups, "payload_key").where("row <> first.row")
    chosen = chosen.select(F.col("row"), F.col("first.page_id").alias("refers_to"), F.lit("revisit").alias("record_type"))
    return rows.drop("payload_key").join(chosen, "row", "left").select(
        "page_id", "url", "html", F.coalesce("record_type", F.lit("response")).alias("record_type"), "refers_to"
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, html, record_type, refers_to as gzipped WARC files below ``folder``; one row per file.

    A task writes under a name of its own attempt and lists the file only when it is whole, so that what a lost or
    repeated attempt leaves is never read. The list is a table in the same folder.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": name, "bytes": size, "records": count}], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = member(row["page_id"], row["url"], row["html"], row["record_type"], row["refers_to"])
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    listed = f"{folder}/_list"
    records.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(write, WRITTEN).write.parquet(listed)
    return records.sparkSession.read.schema(WRITTEN).parquet(listed)


def parse_member(data: bytes) -> dict | None:
    """The record in an inflated member; None if it is not a WARC record."""
    if not data.startswith(b"WARC/"):
        return None
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    try:
        block = rest[: int(fields["content-length"])]
    except (KeyError, ValueError):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    full = len(payload)
    for line in http.split(b"\r\n"):
        if line.lower().startswith(b"content-length:"):
            full = int(line.split(b":", 1)[1])
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
    if kind == "response":
        full, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "page_id": _page_of(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page_of(fields.get("warc-refers-to")) if kind == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": full,
        "payload": payload if kind == "response" else None,
    }


class _Window:
    """A file read forward: bytes from any offset not before the last one let go."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.base, self.data = file, size, start, b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        while self.base + len(self.data) < end:
            at = self.base + len(self.data)
            self.file.seek(at)
            more = self.file.read(min(READ_BYTES, self.size - at))
            if not more:
                self.size = at
                break
            self.data += more

    def drop(self, upto: int) -> None:
        self.data = self.data[max(0, upto - self.base) :]
        self.base = max(self.base, upto)


def members_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each WARC member that begins in [start, end).

    The range is scanned for the gzip magic. A candidate counts if its header inflates and begins as a WARC record
    does; then the whole member is inflated, past the end of the range where needed, and scanning goes on behind it.
    Any other candidate (the magic inside compressed data) is passed over by one byte.
    """
    window = _Window(file, size, start)
    at = start
    while at < end:
        window.upto(at + len(GZIP_MAGIC))
        found = window.data.find(GZIP_MAGIC, at - window.base)
        if found < 0:
            at = max(at, window.base + len(window.data) - len(GZIP_MAGIC) + 1)
            if window.base + len(window.data) >= window.size:
                return
            window.drop(at)
            continue
        at = window.base + found
        if at >= end:
            return
        window.drop(at)
        inflate, parts, used, valid = zlib.decompressobj(31), [], at, True
        try:
            while not inflate.eof:
                window.upto(used + INFLATE_BYTES)
                piece = window.data[used - window.base : used - window.base + INFLATE_BYTES]
                if not piece:
                    valid = False
                    break
                parts.append(inflate.decompress(piece))
                used += len(piece) - len(inflate.unused_data)
                if sum(map(len, parts[:2])) >= 5 and not b"".join(parts[:2]).startswith(b"WARC/"):
                    valid = False
                    break
        except zlib.error:
            valid = False
        data = b"".join(parts)
        if valid and data.startswith(b"WARC/"):
            yield at, data
            at = used
        else:
            at += 1


def read_archives(spark: SparkSession, folder: str, files: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the listed archives (path, bytes): page_id, url, record_type, refers_to, payload_digest (computed
    from the payload where there is one), payload_bytes (of the full payload), payload (null for a revisit), path, offset.

    Archives are cut into byte ranges without reading them; a range is a row, dealt out to tasks, and owns the records
    that start in it. An empty list gives an empty result. Members that are not WARC records are passed over.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string())]
            + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())]
        )
        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{split['path']}") as file:
                    for offset, data in members_in(file, split["bytes"], split["start"], split["start"] + split_bytes):
                        if record := parse_member(data):
                            rows.append(record | {"path": split["path"], "offset": offset})
                            held += len(data)
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = files.select("path", "bytes", F.explode(starts).alias("start"))
    # the rows are tiny and the work behind them is not: a number of tasks is stated, so that they are not put together
    tasks = min(MOST_TASKS, max(1, splits.count()))
    return splits.repartition(tasks).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, *, folder: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``pages`` written as archives to ``folder`` (by default a new one in the shared folder) and read back."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    files = write_archives(with_revisits(pages), folder)
    return read_archives(spark, folder, files, split_bytes=split_bytes)
