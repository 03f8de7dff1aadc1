"""WARC archives: writing whole-file gzip streams, and a normaliser that makes each record a member of its own.

A whole-file stream can only be read from its start. The normaliser inflates it once, in pieces, writes every
record as its own gzip member, and a sidecar index beside it with each member's offset, length, type and id; a reader
then inflates any record alone. Memory is a piece of a record, whatever a record's or a file's size.

Files are written under a name of the attempt's own, and only the names in a finished task's manifest are read on,
so a task that runs twice or dies leaves nothing half-done in the result. Any file system that pyarrow opens will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.shared import materialise, remove, shared_folder
from sessionlake.session import ship

PIECE = 1 << 20
GZIP = 16 + zlib.MAX_WBITS
#: Payloads of so many bytes or more are written once.
LEAST_REVISIT = 1000
#: A file is full from so many bytes of records on, before compression.
ARCHIVE_BYTES = 1 << 32
DATE = "2024-01-01T00:00:00Z"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


# ---- Writing


def _sha1(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_head(page_id: int | None, url: str | None, digest: str, payload_bytes: int, refers_to: int | None) -> bytes:
    """A record up to its payload. A revisit's block is the response's HTTP head alone, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"] if url else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_sha1(digest)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        f"Content-Length: {len(http) + (0 if revisit else payload_bytes)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


#: Digests are told apart by so many numbers, the most that is broadcast of them.
NUMBERS = 1 << 20


def maybe_repeated(pages: DataFrame, again: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The pages whose payload surely isn't among the repeated ones, and the others."""
    number = F.pmod(F.xxhash64("payload_digest", F.lit(3)), F.lit(NUMBERS))
    marks = F.broadcast(again.select(number.alias("mark")).distinct())
    here = (number == F.col("mark")) & (F.col("payload_bytes") >= least_bytes)
    return pages.join(marks, here, "left_anti"), pages.join(marks, here, "left_semi")


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to. Of equal payloads of at least least_bytes the greatest page_id is written, others refer to it.

    Digests are aggregated before the shuffle. Pages whose digest has a number that no repeated one has stay where they are; payloads of
    the others alone are shuffled, to a join that Spark can split where one payload is most pages'.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    again = pages.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    folder = shared_folder(pages.sparkSession)
    again = materialise(again, f"{folder}/repeated")
    alone, others = maybe_repeated(pages, again, least_bytes)
    joined = others.join(again, ["payload_digest", "payload_bytes"], "left").unionByName(alone.withColumn("first", F.lit(None).cast("long")))
    refers = F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", refers.alias("refers_to"))


MANIFEST = "path string, records long"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Whole-file gzip WARC archives below folder; gives their manifest, path and records. A task writes a file, or more where one is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        made: list[tuple[str, int]] = []
        out = pack = None
        size = records = 0

        def close() -> None:
            out.write(pack.flush())
            out.close()
            made.append((f"{folder}/{name}-{len(made)}.warc.gz", records))

        for batch in batches:
            for page_id, url, payload, n, digest, refers_to in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns)), strict=True):
                if out is None:
                    out, pack, size, records = fs.open_output_stream(f"{top}/{name}-{len(made)}.warc.gz", compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0
                for part in (record_head(page_id, url, digest, n, refers_to), payload.as_buffer() if payload.is_valid else b"", b"\r\n\r\n"):
                    out.write(pack.compress(part))
                    size += len(part)
                records += 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made]), pa.array([r for _, r in made])], names=["path", "records"])

    ship(records.sparkSession)
    return records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, MANIFEST)


# ---- Reading


class Inflated:
    """The inflated bytes of a gzip file of one member or many, read on in pieces."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.raw = source, zlib.decompressobj(GZIP), b"", b""

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(PIECE)
                if not self.raw:
                    return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(GZIP)
            got = self.inflate.decompress(self.raw, PIECE)
            self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
            if got:
                self.held += got
                return True

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        at = 0
        while (end := self.held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.held) - 3)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the stream ends within a record's head")
                return None
        out, self.held = self.held[: end + 4], self.held[end + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the stream ends within a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def normalise_stream(source, write: Callable[[bytes], object], index: Callable[[bytes], object]) -> int:
    """Rewrites each record of a gzip stream as a member of its own and its place as an index line: offset, length, type, id. Gives their number."""
    stream, offset, n = Inflated(source), 0, 0
    while (head := stream.head()) is not None:
        head = head.lstrip(b"\r\n")
        got = fields(head)
        pack, length = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
        write(part := pack.compress(head))
        length += len(part)
        for piece in stream.take(int(got["content-length"]) + 4):
            write(part := pack.compress(piece))
            length += len(part)
        write(part := pack.flush())
        length += len(part)
        index(f"{offset}\t{length}\t{got['warc-type']}\t{got['warc-record-id']}\n".encode())
        offset += length
        n += 1
    return n


def _file_a_task(manifest: DataFrame, *columns: str) -> DataFrame:
    """The manifest's files, each in a partition of its own: the few bytes of a path say nothing of its file's size."""
    return manifest.select(*columns).repartitionByRange(max(1, manifest.count()), "path")


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """path, index_path, records of each archive of the manifest, rewritten below folder; a task a file. The manifest is a written one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs_out, top = file_system(folder)
        fs_out.create_dir(top, recursive=True)
        for batch in batches:
            made = []
            for path in batch.column(0).to_pylist():
                fs_in, at = file_system(path)
                name = f"{path.rpartition('/')[2].removesuffix('.warc.gz')}-{uuid.uuid4().hex}"
                with fs_in.open_input_stream(at, compression=None) as source, fs_out.open_output_stream(f"{top}/{name}.warc.gz", compression=None) as out, fs_out.open_output_stream(f"{top}/{name}.idx", compression=None) as index:
                    made.append((f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx", normalise_stream(source, out.write, index.write)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made]) for k in range(3)], names=["path", "index_path", "records"])

    ship(manifest.sparkSession)
    return _file_a_task(manifest, "path").mapInArrow(run, "path string, index_path string, records long")


def read_member(source, offset: int, length: int) -> Iterator[bytes]:
    """The inflated pieces of one member of a seekable file."""
    source.seek(offset)
    inflate = zlib.decompressobj(GZIP)
    while length:
        raw = source.read(min(PIECE, length))
        length -= len(raw)
        while raw:
            yield inflate.decompress(raw, PIECE)
            raw = inflate.unconsumed_tail
    yield inflate.flush()


def _number(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None


def read_record(pieces: Iterator[bytes]) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's size and digest come from its payload, and must be as its head says."""
    held = b""
    while held.count(b"\r\n\r\n") < 2:
        held += next(pieces)
    head, http, rest = held.split(b"\r\n\r\n", 2)
    got, size = fields(head), int(fields(http)["content-length"])
    said = base64.b32decode(got["warc-payload-digest"].removeprefix("sha1:")).hex()
    if got["warc-type"] == "response":
        sha, left = hashlib.sha1(), size
        while left:
            rest = rest or next(pieces)
            sha.update(rest[:left])
            left -= len(rest[:left])
            rest = rest[len(rest) :]
        if sha.hexdigest() != said:
            raise ValueError(f"the payload of {got['warc-record-id']} isn't what its digest says")
    return _number(got["warc-record-id"]), size, said, got["warc-type"], _number(got.get("warc-refers-to"))


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of normalised archives, each read alone at the place its index gives; a task a file. The manifest is a written one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, index_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                (fs, at), (fs_index, index_at) = file_system(path), file_system(index_path)
                with fs.open_input_file(at) as source, fs_index.open_input_stream(index_at, compression=None) as index:
                    for line in _lines(index):
                        offset, length, *_ = line.split(b"\t")
                        rows.append(read_record(read_member(source, int(offset), int(length))))
                        if len(rows) >= 4096:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    ship(manifest.sparkSession)
    return _file_a_task(manifest, "path", "index_path").mapInArrow(run, RECORDS)


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while raw := stream.read(PIECE):
        *lines, held = (held + raw).split(b"\n")
        yield from lines
    if held:
        yield held


def round_trip(pages: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html), normalises the archives, and reads them back.

    A null html is an empty payload; null ids and urls stay null. Rows that repeat an id and payload are all
    responses where that id is the payload's greatest. An empty table makes no archive and gives no rows. Other
    columns don't matter.
    """
    folder = shared_folder(pages.sparkSession)
    whole = materialise(write_archives(with_revisits(pages, least_bytes), f"{folder}/whole"), f"{folder}/whole-manifest")
    apart = materialise(normalise_archives(whole, f"{folder}/members"), f"{folder}/members-manifest")
    remove(pages.sparkSession, f"{folder}/whole")
    return read_archives(apart)


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


OP3_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= {LEAST_REVISIT}
"""
