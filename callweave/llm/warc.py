"""WARC 1.1 archives as chunked record tables.

An archive is a table of rows (seq, chunk_no, last, data); the data of its rows, ordered by seq and
chunk_no, are the bytes of a WARC file. Spark cuts payloads into chunks of CHUNK bytes, and tasks see
only chunks: writing carries a digest along those of a record, whose head is known with the last of
them and stored as its row number 0; reading carries a digest along again. So no task holds a
record. Records of one chunk are one row and are read where they lie; only those of several are
brought together by sequence number.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch, only, stored

CHUNK = 64 << 10
#: Bytes of chunks in an Arrow batch.
BATCH = 4 << 20
#: Equal payloads of fewer bytes are all stored.
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "seq long, chunk_no int, last boolean, data binary"
RECORD = "page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, url string"


def record_urn(page_id, digest: str) -> str:
    h = hashlib.md5(f"{page_id}/{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _coded(text: str) -> str:
    """A text as a header may hold it: blanks, control characters and percent signs by their numbers."""
    return "".join(c if c > " " and c != "%" else f"%{ord(c):02X}" for c in text)


def _decoded(coded: str | None) -> str | None:
    return coded if coded is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), coded)


def record_head(page_id, url: str | None, digest: str, n_bytes: int, response_id) -> bytes:
    """Headers of a record and of the HTTP message in it; ``response_id``: the page that holds the payload of a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url is not None else None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response_id is None else 'revisit'}",
        f"WARC-Record-ID: {record_urn(page_id, digest)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if uri is not None else []),
        *([f"X-Page-ID: {_coded(str(page_id))}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if response_id is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(response_id, digest)}", f"X-Refers-To-Page-ID: {_coded(str(response_id))}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (n_bytes if response_id is None else 0)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http


class RecordReader:
    """Reads one record from its chunks, in order, with a running digest of the payload."""

    def __init__(self):
        self.head: dict[str, str] = {}
        self.http: dict[str, str] | None = None
        self.held, self.left, self.n_bytes, self.sha1 = b"", 0, 0, hashlib.sha1()

    @staticmethod
    def _fields(block: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])

    def feed(self, data: bytes) -> None:
        view = memoryview(data)
        if self.http is None:
            self.held += data
            parts = self.held.split(b"\r\n\r\n", 2)
            if len(parts) < 3:
                return
            if not parts[0].startswith(b"WARC/1.1\r\n"):
                raise ValueError("no WARC record")
            self.head, self.http = self._fields(parts[0]), self._fields(parts[1])
            start = len(parts[0]) + len(parts[1]) + 8
            self.left = int(self.head["Content-Length"]) - len(parts[1]) - 4
            view, self.held = memoryview(self.held)[start:], b""
        own = view[: self.left]
        self.sha1.update(own)
        self.n_bytes += len(own)
        self.left -= len(own)
        self.held += bytes(view[len(own) :])

    def close(self) -> tuple[str | None, int, str, str, str | None, str | None]:
        """(page id, payload bytes, SHA-1 in hex, type, page id of the response, URI); broken records raise."""
        if self.http is None or self.left or self.held != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short or too long")
        said = base64.b32decode(self.head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(self.http["Content-Length"])
        revisit = self.head["WARC-Type"] == "revisit"
        if not revisit and (self.sha1.hexdigest() != said or self.n_bytes != size):
            raise ValueError("a payload differs from its digest")
        return _decoded(self.head.get("X-Page-ID")), size, said, self.head["WARC-Type"], _decoded(self.head.get("X-Refers-To-Page-ID")), self.head.get("WARC-Target-URI")


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], data: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about BATCH bytes in field ``data`` of the rows."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[data]) + 64
        if size >= BATCH:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def digested(chunks: DataFrame, id_type: str) -> DataFrame:
    """Payload chunks with ``seq``, and the facts of each record (id, url, size, digest) on its row number 0.

    ``chunks``: id, url, n_bytes, chunk_no (from 0, in order), last, part. A record of one chunk has it
    on row 0; those of several have their chunks on the rows from 1 on.
    """
    names = ["seq", "chunk_no", "last", "part", "id", "url", "n_bytes", "digest"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), None, pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            context = TaskContext.get()
            seq, sha1 = (context.partitionId() if context else 0) << 40, None
            for batch in chain([head], batches):
                columns = [batch.column(c) for c in ("id", "url", "n_bytes", "chunk_no", "last", "part")]
                for ident, url, n, k, last, part in zip(*columns, strict=True):
                    part, k, last = part.as_py(), k.as_py(), last.as_py()
                    sha1 = sha1 if k else hashlib.sha1()
                    sha1.update(part)
                    facts = (ident.as_py(), url.as_py(), n.as_py(), sha1.hexdigest()) if last else (None, None, None, None)
                    if last and not k:
                        yield (seq, 0, True, part, *facts)
                    else:
                        yield (seq, k + 1, last, part, None, None, None, None)
                        if last:
                            yield (seq, 0, False, b"", *facts)
                    seq += last

        head = next(batches, None)
        if head is not None:
            yield from _batches(rows(), names, [t or head.schema.field("id").type for t in kinds], 3)

    return chunks.mapInArrow(run, f"seq long, chunk_no int, last boolean, part binary, id {id_type}, url string, n_bytes long, digest string")


def write_archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The chunked record table of ``df``, stored in the shared folder.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, that with the largest id is the
    response (repeated rows of it too) and the others revisit it; so do rows with a null id, if any
    other has one. Null payloads are empty, null urls have no URI. Payloads meet only their own
    sequence number: which of them are copies is decided by digests and ids alone.
    """
    scratch = Scratch(df.sparkSession)
    source = only(df, id=id_col, url=url_col, html=payload_col)
    payload = source.select("id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    sized = payload.select("*", F.octet_length("payload").cast("long").alias("n_bytes"))
    last = F.greatest(F.ceil(F.col("n_bytes") / CHUNK).cast("int") - 1, F.lit(0))
    each = sized.select("id", "url", "payload", "n_bytes", last.alias("to"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    chunks = each.select("id", "url", "n_bytes", "chunk_no", (F.col("chunk_no") == F.col("to")).alias("last"), F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)).alias("part"))
    kept = scratch.stored(digested(chunks, source.schema["id"].dataType.simpleString()), "payloads")

    large = kept.where((F.col("chunk_no") == 0) & (F.col("n_bytes") >= LEAST_REVISIT)).select("seq", "id", "digest")
    copies = large.groupBy("digest").agg(F.max("id").alias("response_id"), F.count("*").alias("n")).where("n > 1 and response_id is not null")
    # Stored, so that their size is known: Spark broadcasts them below its threshold, else joins by shuffles.
    known = scratch.stored(copies.select("digest", "response_id"), "responses")
    again = large.join(known, "digest").where(~F.col("id").eqNullSafe(F.col("response_id")))
    revisits = scratch.stored(again.select("seq", "response_id"), "revisits")
    rows = kept.join(revisits, "seq", "left").where("chunk_no = 0 or response_id is null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(c) for c in ("seq", "chunk_no", "last", "part", "id", "url", "n_bytes", "digest", "response_id")]
                for row in zip(*columns, strict=True):
                    seq, k, last, part, ident, url, n, digest, response = (x.as_py() for x in row)
                    revisit = response is not None
                    last = last or revisit
                    head = record_head(ident, url, digest, n, response) if not k else b""
                    yield seq, k, last, head + (b"" if revisit else part) + (b"\r\n\r\n" if last else b"")

        yield from _batches(rows_of(), ["seq", "chunk_no", "last", "data"], [pa.int64(), pa.int32(), pa.bool_(), pa.binary()], 3)

    archive = stored(rows.mapInArrow(run, ARCHIVE), "archive")
    scratch.drop()
    return archive


def read_archive(archive: DataFrame, id_type: str = "long") -> DataFrame:
    """One row for each record (see RECORD), from its chunks; payloads that don't match their digest raise."""
    names = [x.split()[0] for x in RECORD.format(kind="string").split(", ")]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for c, n in zip(columns, names, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, expected, reader = None, 0, None
        for batch in batches:
            done = []
            for at, chunk_no, last, data in zip(*(batch.column(c) for c in ("seq", "chunk_no", "last", "data")), strict=True):
                at, chunk_no = at.as_py(), chunk_no.as_py()
                if reader is None:
                    seq, expected, reader = at, 0, RecordReader()
                if (at, chunk_no) != (seq, expected):
                    raise ValueError(f"record {seq}: chunk {expected} is missing")
                reader.feed(data.as_py())
                expected += 1
                if last.as_py():
                    done.append(reader.close())
                    reader = None
            yield rows_of(done)
        if reader is not None:
            raise ValueError(f"record {seq} has no last chunk")

    kinds = RECORD.format(kind="string")
    single = archive.where("last and chunk_no = 0").mapInArrow(run, kinds)
    several = archive.where("not (last and chunk_no = 0)").repartition("seq").sortWithinPartitions("seq", "chunk_no").mapInArrow(run, kinds)
    return single.unionByName(several).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``df`` as records and read them back: a row for each of its rows (see ``write_archive``).

    Null ids and repeated rows have records of their own; an empty table gives no rows; other
    columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    out = read_archive(write_archive(df, id_col, url_col, payload_col), kind)
    return out.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
