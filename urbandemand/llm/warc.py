"""WARC archives as a chunked record table.

A record's payload is rows of (record_id, chunk_no), never one value: the
writer takes them as they come, hashes and compresses each and closes the
record behind the last, and the reader gives them back from a stream, each
with the digest and the bytes of the payload so far. Neither holds a record.
Records of equal payloads are one response, that of the largest page_id, and
revisits that refer to it.

Archives are gzip files with a member a record. Tasks write to names of their
own; only files of tasks that the job took are moved in, so that tasks may be
run again or twice at once. The folder must be of a kind that pyarrow opens
(file, hdfs, s3, gs), and all machines must see it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.numbering import joined_to
from .common import dropped, scratch, shared_dir, stored

#: Bytes of a payload in one row.
CHUNK_BYTES = 256 << 10
#: Payloads of fewer bytes are stored each time.
MIN_BYTES = 0
#: An archive that has grown to this is closed and another one begun.
ARCHIVE_BYTES = 1 << 30
#: Records carry a date; the pages have none.
DATE = "2024-01-01T00:00:00Z"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"
_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 4096
_READ_BYTES = 256 << 10
_HEAD_BYTES = 1 << 20

CHUNKS = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("is_last", pa.bool_()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary()),
    ]
)
_CHUNKS_SQL = "record_id string, record_type string, target_uri string, page_id long, refers_to long, chunk_no long, is_last boolean, payload_bytes long, payload_digest string, data binary"


def base32(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


class CorruptArchive(ValueError):
    """An archive that is cut off, or whose payload isn't what its header says."""


@dataclass
class _Done(WriterCommitMessage):
    names: list[str]


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Writer(DataSourceArrowWriter):
    """Rows of (head, chunk_no, n_chunks, digest, data), a record's one after the other, into archives."""

    def __init__(self, folder: str, archive_bytes: int) -> None:
        self.folder, self.archive_bytes = folder, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _at(self.folder)
        names: list[str] = []
        out = pack = sha = None
        for b in iterator:
            columns = [b.column(c) for c in ("head", "chunk_no", "n_chunks", "digest", "data")]
            for i in range(b.num_rows):
                head, chunk, n, digest, data = (c[i].as_py() for c in columns)
                if chunk == 0:
                    if out is not None and out.tell() >= self.archive_bytes:
                        out.close()
                        out = None
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        system.create_dir(f"{root}/_staging", recursive=True)
                        out = system.open_output_stream(f"{root}/_staging/{names[-1]}", compression=None)
                    pack, sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1(usedforsecurity=False)
                    out.write(pack.compress(head.encode()))
                sha.update(data)
                out.write(pack.compress(data))
                if chunk == n - 1:
                    if digest is not None and base32(sha.digest()) != digest:
                        raise CorruptArchive(f"the payload of a record is not the one that was hashed: {head[:200]!r}")
                    out.write(pack.compress(_END) + pack.flush())
        if out is not None:
            out.close()
        return _Done(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _at(self.folder)
        system.create_dir(root, recursive=True)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{root}/_staging/{name}", f"{root}/{name}")
        self._cleared(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._cleared(*_at(self.folder))

    def _cleared(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_staging").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_staging")


class _Unzipped:
    """The bytes of a file of gzip members, as many as are asked for at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.member = stream, b"", None
        self.held, self.at = b"", 0

    def _more(self) -> bytes:
        """The next bytes, _READ_BYTES at most; none at the file's end."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(_READ_BYTES)
                if not self.raw:
                    if self.member is not None:
                        raise CorruptArchive("the archive ends within a record")
                    return b""
            if self.member is None:
                self.member = zlib.decompressobj(31)
            try:
                got = self.member.decompress(self.raw, _READ_BYTES)
            except zlib.error as e:
                raise CorruptArchive(str(e)) from e
            self.raw = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = None
            if got:
                return got

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at == len(self.held):
                self.held, self.at = self._more(), 0
                if not self.held:
                    raise CorruptArchive("the archive ends within a record")
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def head(self) -> bytes:
        """Up to and without an empty line; nothing at the file's end."""
        while (end := self.held.find(_END, self.at)) < 0:
            rest = self.held[self.at :]
            more = self._more()
            if not more and rest or len(rest) > _HEAD_BYTES:
                raise CorruptArchive("a header has no end")
            self.held, self.at = rest + more, 0
            if not more:
                return b""
        out = self.held[self.at : end]
        self.at = end + len(_END)
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise CorruptArchive(f"no record begins with {lines[0][:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def records(stream, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """Chunk rows (see ``CHUNKS``) of one archive."""
    source = _Unzipped(stream)
    while head := source.head():
        f = _fields(head)
        number = lambda key: int(f[key]) if key in f else None  # noqa: B023, E731
        left, told = int(f["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
        known = (f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page"))
        left -= len(source.head()) + len(_END)  # of HTTP; what follows it is the payload
        sha, size, chunk = hashlib.sha1(usedforsecurity=False), 0, 0
        while True:
            part = source.exactly(min(left, chunk_bytes))
            left -= len(part)
            size += len(part)
            sha.update(part)
            digest = base32(sha.digest())
            if not left:
                if known[1] == "revisit":
                    size, digest = number("x-payload-length"), told
                elif digest != told:
                    raise CorruptArchive(f"the payload of {known[0]} is not the one its header names")
            yield *known, chunk, not left, size, digest, part if with_data else None
            if not left:
                break
            chunk += 1
        if source.exactly(len(_END)) != _END:
            raise CorruptArchive(f"{known[0]} is longer than its header says")


class _Reader(DataSourceReader):
    def __init__(self, folder: str, chunk_bytes: int, with_data: bool) -> None:
        self.folder, self.chunk_bytes, self.with_data = folder, chunk_bytes, with_data

    def partitions(self) -> list[InputPartition]:
        system, root = _at(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=False))
        return [InputPartition(x.base_name) for x in sorted(found, key=lambda x: x.base_name) if x.is_file and x.base_name.endswith(".warc.gz")] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, root = _at(self.folder)
        rows: list[tuple] = []
        held = 0
        with system.open_input_stream(f"{root}/{partition.value}", compression=None) as stream:
            for row in records(stream, self.chunk_bytes, self.with_data):
                rows.append(row)
                held += len(row[-1] or b"")
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)


class WarcSource(DataSource):
    """``warc``: chunk rows from and to a folder of archives. Options: path, chunk_bytes, data, archive_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _CHUNKS_SQL

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("chunk_bytes", CHUNK_BYTES)), self.options.get("data", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def chunk_rows(rows: DataFrame, payload: str, chunk_bytes: int, kept: list[str]) -> DataFrame:
    """``kept`` with chunk_no, n_chunks and data; a row's chunks follow each other, an empty payload has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / F.lit(chunk_bytes))).cast("long")
    at = rows.select(*kept, payload, n.alias("n_chunks"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_no"))
    return at.select(*kept, "chunk_no", "n_chunks", F.substring(payload, (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)).alias("data"))


_HASHED = pa.schema([("page_id", pa.int64()), ("sha", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string())])


def payload_digests(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``page_id, sha, payload_bytes, digest`` of rows (page_id, sha, payload), from their chunks."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha1(usedforsecurity=False), 0
        for b in batches:
            done = []
            data = b.column(4)
            for i, (page, key, chunk, n) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
                part = data[i].as_py()
                if chunk == 0:
                    sha, size = hashlib.sha1(usedforsecurity=False), 0
                sha.update(part)
                size += len(part)
                if chunk == n - 1:
                    done.append({"page_id": page, "sha": key, "payload_bytes": size, "digest": base32(sha.digest())})
            yield pa.RecordBatch.from_pylist(done, schema=_HASHED)

    return chunk_rows(rows, "payload", chunk_bytes, ["page_id", "sha"]).mapInArrow(hashed, "page_id long, sha string, payload_bytes long, digest string")


def _head(is_response: Column) -> Column:
    """A record's header and the head of its HTTP block."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    ident = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    only = lambda value: F.when(~is_response, value)
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    block = F.lit(len(_HTTP)) + F.when(is_response, F.col("payload_bytes")).otherwise(0)
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(is_response, "response").otherwise("revisit")), line("WARC-Record-ID", ident(F.col("page_id"))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri),
        line("WARC-Profile", only(F.lit(_PROFILE))), line("WARC-Refers-To", only(ident(F.col("keep_id")))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Page-Id", F.col("page_id").cast("string")), line("X-Refers-To-Page", only(F.col("keep_id").cast("string"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit("\r\n" + _HTTP),
    )


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record for each row of ``pages`` (page_id, url, html), into archives in ``folder``.

    Payloads are html in UTF-8; null is empty. Of records with equal payloads
    of at least ``min_bytes`` bytes those of the largest page_id are responses
    (all of them, where rows repeat it), the others revisits; a null page_id is the
    smallest. A null url leaves out the target; blanks and control signs in it become %20.
    Without rows there is no archive.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    with scratch():
        told = stored(payload_digests(rows.select("page_id", "sha", "payload"), chunk_bytes).distinct(), "digests")
        largest = told.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keep_id"))
        told = stored(told.join(largest.hint("merge"), "sha", "left"), "told")
        is_response = F.col("keep_id").eqNullSafe(F.col("page_id")) | (F.col("payload_bytes") < min_bytes)
        one = joined_to(rows, told, ["page_id", "sha"])
        kept = one.select(_head(is_response).alias("head"), F.when(is_response, F.col("digest")).alias("digest"), F.when(is_response, F.col("payload")).otherwise(F.lit(b"")).alias("payload"))
        chunks = chunk_rows(kept, "payload", chunk_bytes, ["head", "digest"])
        head = F.when(F.col("chunk_no") == 0, F.col("head"))
        chunks.select(head.alias("head"), "chunk_no", "n_chunks", "digest", "data").write.format("warc").mode("append").option("archive_bytes", archive_bytes).save(folder)


def read_chunks(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """Chunk rows of all archives in a folder; payload_bytes and payload_digest are those of the payload up to the chunk's end.

    Of a revisit, whose payload isn't in the archives, they are those of the
    payload that it stands for. Without ``data`` the bytes stay where they were read.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("chunk_bytes", chunk_bytes).option("data", str(data).lower()).load(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: record_id, record_type, target_uri, page_id, refers_to, payload_bytes, payload_digest."""
    return read_chunks(spark, folder, data=False).filter("is_last").drop("chunk_no", "is_last", "data")


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``pages`` written to archives and read back, per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, folder, min_bytes, chunk_bytes)
    with scratch() as keep:
        found = read_records(spark, folder)
        out = keep(stored(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records"))
    found._stored_path = folder
    dropped(found)
    return out
