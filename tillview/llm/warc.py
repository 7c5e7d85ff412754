"""WARC archives through a table of chunks.

A payload is rows of (record, chunk number, bytes), so no step needs a whole record: the writer streams the
chunks of a record into its archive, the reader streams them out again and carries the digest of the payload
along, chunk by chunk. Each record is a gzip member of its own. Every task writes one archive to the shared
folder under a name of its attempt; the names that count are those in the manifest, which only lists archives
of tasks that ended well.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.session import shared_dir, stage

CHUNK = 1 << 18
_BUFFER = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, chunk int, page_id long, record_type string, refers_to long, bytes binary, so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def _header(row: dict, digest: str) -> bytes:
    """The record's header; for a response also the start of its block."""
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _record_id(row["page_id"], digest)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if row["url"] and not any(c in row["url"] for c in "\r\n"):
        fields.append(("WARC-Target-URI", row["url"]))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", row["size"])]
    if row["page_id"] is not None:
        fields.append(("X-Record-Key", row["page_id"]))
    revisit = row["record_type"] == "revisit"
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(row["refers_to"], digest)), ("X-Refers-To-Key", row["refers_to"])]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(_HTTP) + (0 if revisit else row["size"]))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + _HTTP


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out = gz = None
        records = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs, path = _open(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                if row["chunk"] == 0:
                    records += 1
                    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                    out.write(gz.compress(_header(row, digest)))
                out.write(gz.compress(row["bytes"]))
                if row["chunk"] == row["chunks"] - 1:
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "file_bytes"])

    return run


def revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) for the records whose payload a record with a larger id has too.

    ``rows``: page_id, sha1, size. Payloads are equal when length and digest are; null ids are left alone.
    """
    narrow = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= min_bytes)).select("page_id", "sha1", "size")
    groups = narrow.groupBy("sha1", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"))
    groups = groups.where("low < refers_to").drop("low")
    return narrow.join(groups, ["sha1", "size"]).where("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct()


def chunk_rows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows with ``payload`` cut into rows of at most ``chunk`` bytes; a revisit has one empty chunk."""
    size = F.when(F.col("record_type") == "revisit", 0).otherwise(F.length("payload"))
    chunks = F.greatest(F.lit(1), F.ceil(size / chunk)).cast("int")
    at = rows.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    piece = F.substring(F.col("payload"), F.col("chunk") * chunk + 1, F.lit(chunk))
    return at.withColumn("bytes", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(piece)).drop("payload")


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows to archives in ``folder``; returns the manifest (file, records, file_bytes).

    The chunks of a record must follow each other in order within a partition.
    """
    rows = chunks.select("page_id", "url", "record_type", "refers_to", "sha1", "size", "chunks", "chunk", "bytes")
    return stage(rows.mapInArrow(_writer(folder), "file string, records long, file_bytes long"))


def write_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, payload: Column | None = None, min_bytes: int = 0) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html); returns the manifest.

    Null html is an empty payload. Rows with the id and payload of a response are responses as well; a null
    page_id is a response without key. An empty table writes no archive. Other columns are not looked at.
    """
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")) if payload is None else payload
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.length("payload").cast("long")})
    at = rows.join(revisits(rows, min_bytes), ["page_id", "sha1"], "left")
    at = at.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    return write_archives(chunk_rows(at), folder)


class _Stream:
    """The bytes of an archive, member after member, read in buffers."""

    def __init__(self, source):
        self.source, self.gz, self.raw, self.data = source, None, b"", b""

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(_BUFFER)
                if not self.raw:
                    return False
            if self.gz is None:
                self.gz = zlib.decompressobj(31)
            new = self.gz.decompress(self.raw, _BUFFER)
            self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if self.gz.eof:
                self.gz = None
            if new:
                self.data += new
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.data.find(mark)) < 0:
            if not self.more():
                if self.data:
                    raise ValueError("archive ends within a record")
                return None
        out, self.data = self.data[:at], self.data[at + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        while not self.data:
            if not self.more():
                raise ValueError("archive ends within a record")
        out, self.data = self.data[:most], self.data[most:]
        return out


def _exactly(stream: _Stream, n: int) -> Iterator[bytes]:
    while n:
        part = stream.take(n)
        n -= len(part)
        yield part


def _records(stream: _Stream, chunk: int) -> Iterator[tuple]:
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no record where one should begin")
        field = dict(x.split(": ", 1) for x in lines[1:])
        left = int(field["Content-Length"])
        left -= len(stream.until(b"\r\n\r\n")) + 4  # the HTTP header
        key, to = (int(field[k]) if k in field else None for k in ("X-Record-Key", "X-Refers-To-Key"))
        claimed = field["WARC-Payload-Digest"].removeprefix("sha1:")
        sha, so_far, number, held = hashlib.sha1(), 0, 0, b""
        total = left
        parts = _exactly(stream, left)
        while True:
            while len(held) < chunk and (new := next(parts, None)) is not None:
                held += new
            piece, held = held[:chunk], held[chunk:]
            sha.update(piece)
            so_far += len(piece)
            last = so_far == total
            digest = base64.b32encode(sha.digest()).decode()
            full = (None, None)
            if last:
                revisit = field["WARC-Type"] == "revisit"
                if not revisit and digest != claimed:
                    raise ValueError(f"payload of {field['WARC-Record-ID']} does not have its digest")
                full = (int(field["X-Payload-Length"]), claimed) if revisit else (so_far, digest)
            yield (field["WARC-Record-ID"], number, key, field["WARC-Type"], to, piece, so_far, digest, last, *full)
            number += 1
            if last:
                break
        if b"".join(_exactly(stream, 4)) != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")


def _reader(chunk: int):
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for files in batches:
            for name in files.column("file").to_pylist():
                fs, path = _open(name)
                with fs.open_input_stream(path) as source:
                    for row in _records(_Stream(source), chunk):
                        rows.append(row)
                        held += len(row[5]) + 200
                        if held > _BUFFER:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def read_archives(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in the manifest.

    ``so_far`` and ``digest_so_far`` cover the payload up to and with the chunk; the last chunk of a record also has
    the length and digest of the full payload (of a revisit, as its header gives them). A digest that differs from
    the header's is an error.
    """
    files = manifest.select("file")
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    n = max(cores, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "file").mapInArrow(_reader(chunk), CHUNKS)


def by_page(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    d AS (SELECT page_id, t, max(page_id) OVER (PARTITION BY t) AS top FROM p),
    s AS (SELECT page_id, top, strlen(t) AS n, unhex(sha1(t)) AS b FROM d),
    x AS (SELECT *, list_aggregate(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 (substr(bits, i + 1, 5)::BIT::INT) + 1, 1)), 'string_agg', '') AS b32
          FROM (SELECT *, b::BIT::VARCHAR AS bits FROM s))
    SELECT page_id, n AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id < top THEN top END AS refers_to FROM x"""
