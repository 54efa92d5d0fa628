"""WARC archives: a writer that leaves out repeated payloads, and a sequential reader.

Each record is one gzip member. The reader decompresses piece by piece, takes a block by its Content-Length, and checks
block and payload against their digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.shared import partitions, stored

#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1000
ROTATE = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
READ = 1 << 16


class BadRecord(ValueError):
    """An archive that is cut off, not framed as its headers say, or differs from its digests."""


def _sha1(b: bytes) -> str:
    return hashlib.sha1(b, usedforsecurity=False).hexdigest()


def _agrees(said: str | None, own: str) -> bool:
    """Whether a digest field, hexadecimal or base 32, is that of the bytes; one that isn't there or isn't SHA-1 says nothing."""
    algorithm, _, digest = (said or "").partition(":")
    return algorithm.lower() != "sha1" or digest in (own, base64.b32encode(bytes.fromhex(own)).decode())


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member; a revisit (refers_to) holds the HTTP headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload or b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%")}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(read) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed piece by piece; ``read(n)`` gives at most n bytes."""
    z, out, rest = None, [], b""
    while True:
        piece = rest or read(READ)
        rest = b""
        if not piece:
            if z is not None:
                raise BadRecord("the archive ends within a record")
            return
        if z is None:
            z, out = zlib.decompressobj(31), []
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            raise BadRecord(f"not a gzip member: {e}") from e
        if z.eof:
            rest = z.unused_data
            z = None
            yield b"".join(out)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with names in lower case, block) of a record."""
    end = member.find(b"\r\n\r\n")
    if end < 0 or not member.startswith(b"WARC/"):
        raise BadRecord("no WARC header")
    lines = member[:end].decode().split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if "content-length" not in headers:
        raise BadRecord("no Content-Length")
    start, size = end + 4, int(headers["content-length"])
    block = member[start : start + size]
    if len(block) != size or member[start + size :] != b"\r\n\r\n":
        raise BadRecord("the block isn't as long as Content-Length says")
    if not _agrees(headers.get("warc-block-digest"), _sha1(block)):
        raise BadRecord("the block differs from its digest")
    return headers, block


def page(headers: dict[str, str], block: bytes) -> tuple[int | None, int | None, str, str, int | None, bytes | None] | None:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a response or revisit, the payload checked
    where it is there; None for records of other types, such as warcinfo, request and metadata.

    Records of other writers may lack what the format doesn't ask for: an id that is no page's is null, a response without a
    payload digest has it worked out, one without an HTTP length has that of its payload, a revisit without them has null and ''.
    """
    kind = headers.get("warc-type")
    if not kind:
        raise BadRecord("the record has no type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    size = int(said[1]) if said else len(payload) if kind == "response" else None
    own = _sha1(payload) if kind == "response" else ""
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or not _agrees(headers.get("warc-payload-digest"), own)):
        raise BadRecord("the payload differs from its digest")
    page_id = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", headers.get(name, ""))) else None
    return page_id("warc-record-id"), size, own or digest, kind, page_id("warc-refers-to") if kind == "revisit" else None, payload if kind == "response" else None


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in ``folder`` and returns (path, records), one row an archive.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, that with the largest page_id is a response, others
    revisit it; pages that are the same in both are responses each. Null html is an empty payload; a null page_id is a
    response and stands for no other. Extra columns are left out. Only archives named in the result count: a task that is
    run again writes a file of its own. Equal payloads are found on (digest, page_id) alone, counted before they are
    shuffled; a digest that is very frequent can be split in the join.
    """
    payload = F.coalesce("html", F.lit(""))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    first = whole.where(F.col("page_id").isNotNull() & (F.col("size") >= LEAST_REVISIT)).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original")
    refers = F.when((F.col("size") >= LEAST_REVISIT) & (F.col("original") > F.col("page_id")), F.col("original"))
    # payloads that are always written whole take no part in the join, however often they occur
    large = (F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull()
    joined = whole.where(large).join(first, "digest", "left").select(*whole.columns, "original")
    rows = joined.union(whole.where(~large).withColumn("original", F.lit(None).cast("long"))).select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "size", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        task, k, out, size, n, done = TaskContext.get(), 0, None, 0, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, length, digest, to = (c[i].as_py() for c in batch.columns)
                if out is None:
                    name = f"{top}/{task.partitionId():05d}-{task.taskAttemptId()}-{k:03d}.warc.gz"
                    out, size, n, k = fs.open_output_stream(name, compression=None), 0, 0, k + 1
                body = record(page_id, url, None if html is None else html.encode(), length, digest, to)
                out.write(body)
                size, n = size + len(body), n + 1
                if size >= ROTATE:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0].rsplit("/", 1)[1] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["name", "records"])

    written = stored(rows.mapInArrow(write, "name string, records long"))
    return written.select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"), "records")


def read_warc(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every response and revisit in the archives (path); records of other types are passed over.

    An archive is read by one task from front to back. A damaged archive raises BadRecord.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)][: len(names)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for m in members(stream.read):
                        if (got := page(*parse(m))) is None:
                            continue
                        rows.append(got)
                        size += len(m) if with_payload else 256
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    return archives.select("path").repartition(4 * partitions(spark), "path").mapInArrow(read, kind)
