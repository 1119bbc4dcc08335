"""WARC archives: a writer that makes them from a table, and a sequential reader.

*Reader.* One pass over the bytes of an archive, as they come: each gzip member is one record, inflated piece by piece
(zlib), whose header is read up to the empty line and whose block is framed by Content-Length. Payload digests are
verified. At no time is more than one record held. The reader raises DamagedRecord for a member that breaks off,
lengths that disagree, a missing version line or a wrong digest.

*Writer.* Of rows with equal payloads, the one with the smallest page_id is written as a response, the others as
revisits that name it and carry only the HTTP header (with the payload's length) and digest. Whether a row revisits
another is found by one aggregate over (digest, length), whose minima are combined before the shuffle, and a join that
adaptive execution may split. Each task writes its records one by one into archives of about ``ARCHIVE`` bytes in the
shared folder; a retried task writes new files, and only those that the stored manifest names are read.

Defined cases: null html is an empty payload; payloads of at least ``least`` bytes (0: also empty ones) can be
revisited. Rows that repeat a page_id and payload are all responses if that page_id is the smallest. A null page_id
counts as larger than all others; where only such rows share a payload, all are responses. A null url is written as
``urn:page:<page_id>``. Other columns are not read. An empty table makes no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, columns_of, shared_dir, slices, stored

ARCHIVE = 64 << 20
CHUNK = 1 << 16
MAX_TASKS = 20_000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


class DamagedRecord(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str | None = None) -> bytes:
    """One gzip member: a response, or a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(x for x in (url or f"urn:page:{page_id}") if x not in "\r\n")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + squeeze.flush()


def members(file: BinaryIO, chunk: int = CHUNK) -> Iterator[bytes]:
    """The inflated gzip members of a file, one after the other."""
    inflate, held = zlib.decompressobj(31), []
    begun = False
    data = file.read(chunk)
    while data:
        begun = True
        try:
            held.append(inflate.decompress(data))
        except zlib.error as e:
            raise DamagedRecord(str(e)) from e
        if inflate.eof:
            yield b"".join(held)
            data, held, begun = inflate.unused_data, [], False
            inflate = zlib.decompressobj(31)
            data = data or file.read(chunk)
        else:
            data = file.read(chunk)
    if begun:
        raise DamagedRecord("the last member breaks off")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record; framing and digests are checked."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not gap or not first.startswith("WARC/"):
        raise DamagedRecord("no version line or end of the header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise DamagedRecord("no Content-Length") from e
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or len(block) != n:
        raise DamagedRecord("the block is not as long as Content-Length says")
    want = fields.get("warc-block-digest")
    if want and want != f"sha1:{digest(block)}":
        raise DamagedRecord("the block's digest differs")
    return fields, block


def read(file: BinaryIO) -> Iterator[dict]:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes and payload_digest."""
    for member in members(file):
        fields, block = parse(member)
        http, _, payload = block.partition(b"\r\n\r\n")
        n = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        revisit = fields.get("warc-type") == "revisit"
        if not revisit and (digest(payload) != named or len(payload) != n):
            raise DamagedRecord("the payload's digest or length differs")
        to = fields.get("warc-refers-to", "")
        yield {"page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"),
               "refers_to": int(to.removeprefix("<urn:page:").removesuffix(">")) if to else None, "payload": None if revisit else payload, "payload_bytes": n, "payload_digest": named}


def _open(uri: str):
    files, path = fs.FileSystem.from_uri(uri)
    return files, path


def _write(top: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(top)
        out, name, size, n, done = None, "", 0, 0, []
        for batch in slices(batches, "html"):
            for page_id, url, html, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id, url, (html or "").encode(), to)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE:
                    out.close()
                    done.append((f"{top}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{top}/{name}", size, n))
        yield batch_of({"archive": ([x[0] for x in done], pa.string()), "bytes": ([x[1] for x in done], pa.int64()), "records": ([x[2] for x in done], pa.int64())})
    return run


def written(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes archives of pages (page_id, url, html) and returns their stored manifest: archive, bytes, records."""
    spark = pages.sparkSession
    top = folder or shared_dir(spark)
    if "://" not in top and not top.startswith("file:"):
        top = f"file://{top}"
    top = top.replace("file:///", "file:/").replace("file:/", "file:///")
    pages = columns_of(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    body = pages.withColumn("n", F.coalesce(F.octet_length("html"), F.lit(0))).withColumn("sha", F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))))
    first = body.where(F.col("n") >= least).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    files, path = _open(top)
    files.create_dir(path, recursive=True)
    marked = body.join(first, ["sha", "n"], "left").select("page_id", "url", "html", F.expr("if(page_id is null or first < page_id, first, null)").alias("refers_to"))
    return stored(marked.mapInArrow(_write(top), "archive string, bytes long, records long"))


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                files, path = _open(uri)
                with files.open_input_stream(path, compression=None) as file:
                    held, size = [], 0
                    for x in read(file):
                        if not with_payload:
                            x.pop("payload")
                        held.append(x)
                        size += 200 + len(x.get("payload") or b"")
                        if size > 4 << 20:
                            yield _rows(held, with_payload)
                            held, size = [], 0
                    if held:
                        yield _rows(held, with_payload)
    return run


def _rows(held: list[dict], with_payload: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    if with_payload:
        kinds["payload"] = pa.binary()
    return batch_of({k: ([x[k] for x in held], t) for k, t in kinds.items()})


def records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that a manifest names, read one archive to a task or a few."""
    tasks = min(MAX_TASKS, max(1, manifest.count()))  # a given number is not merged again
    one = manifest.select("archive").repartition(tasks, "archive")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return one.mapInArrow(_read(with_payload), schema)
