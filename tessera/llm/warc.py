"""WARC archives: a writer with revisit records and a sequential reader.

Every record is a gzip member of its own. The reader feeds bytes to zlib
piece by piece, frames each record by its Content-Length, and checks block
and payload digests; a record that breaks a rule raises WarcError. A task
writes files under names of its own, and only files in the manifest of
successful tasks count, so tasks may fail and run again.

Ids are whole numbers. Null payloads are empty, null ids give records without an id, repeated rows
give a record each, other columns are ignored, and an empty table gives an
empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import filesystem, run_dir, text_of, written

#: Archives are closed beyond this size; bytes read at once.
FILE_BYTES, READ_BYTES = 64 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    """A record that isn't as it has to be."""


def b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def member(kind: str, record: str, uri: str, payload: bytes, digest: str, length: int, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit has no payload; digest and length are those of the full one."""
    block = HTTP if kind == "revisit" else HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: {digest}", f"WARC-Payload-Length: {length}",
        f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated bytes of each gzip member of a stream."""
    z, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            try:
                parts.append(z.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            chunk = b""
            if z.eof:
                yield b"".join(parts)
                chunk, z, parts = z.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise WarcError("the archive ends inside a record")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, framed by its Content-Length."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    if rest[n:] != b"\r\n\r\n" or n > len(rest):
        raise WarcError(f"the record isn't {n} bytes long")
    return fields, rest[:n]


def verified(fields: dict[str, str], block: bytes) -> bytes:
    """The payload, after the digests are found right."""
    if b32(hashlib.sha1(block).digest()) != fields.get("warc-block-digest"):
        raise WarcError(f"block digest of {fields.get('warc-record-id')}")
    _, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("no end of the HTTP header")
    if fields["warc-type"] == "response" and (b32(hashlib.sha1(payload).digest()) != fields.get("warc-payload-digest") or len(payload) != int(fields["warc-payload-length"])):
        raise WarcError(f"payload digest of {fields.get('warc-record-id')}")
    return payload


def read_archive(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an archive."""
    for record in members(chunks):
        fields, block = parsed(record)
        yield fields, verified(fields, block)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html: str = "html", url: str = "url", min_revisit: int = 1000) -> DataFrame:
    """Writes the archives into `folder`/archives; returns their manifest (path, records, bytes).

    Of equal payloads of at least `min_revisit` bytes, the one with the
    largest id is the response that the others revisit.
    """
    payload = F.encode(text_of(html), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), (F.col(url) if url in pages.columns else F.lit("")).alias("uri"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    big = F.octet_length("payload") >= min_revisit
    owners = rows.where(big).groupBy("digest").agg(F.max("id").alias("owner"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # a row for each payload that occurs twice or more on the right; the skew of a hot payload on the left is Spark's to split
    decided = rows.where(big).join(owners, "digest", "left").withColumn("owner", F.when(F.col("id") != F.col("owner"), F.col("owner")))
    # smaller ones are written where they lie
    decided = decided.unionByName(rows.where(~big).withColumn("owner", F.lit(None).cast("long")))
    archives = f"{folder}/archives"

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, path = filesystem(archives)
        fs.create_dir(path, recursive=True)
        out, size, n, done = None, 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for b in batches:
            for pid, uri, body, digest, owner in zip(*(b.column(c).to_pylist() for c in ("id", "uri", "payload", "digest", "owner")), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                kind = "response" if owner is None else "revisit"
                uri = "".join(str(uri or "").split())
                made = member(kind, f"urn:page:{'' if pid is None else pid}", uri, body, b32(digest), len(body), None if owner is None else f"urn:page:{owner}")
                out.write(made)
                size, n = size + len(made), n + 1
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([{"name": f, "records": k, "bytes": s} for f, k, s in done], schema=pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    made = decided.select("id", "uri", "payload", "digest", "owner").mapInArrow(write, "name string, records long, bytes long")
    # a row for each archive, in one file however many tasks there were: a file costs an executor several processes on a local store
    return written(made.repartition(1), f"{folder}/manifest").withColumn("path", F.concat(F.lit(archives + "/"), "name"))


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest (lower-case hex), record_type, refers_to, uri, and the payload if asked for."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = lambda urn: int(x) if (x := urn.strip("<>").removeprefix("urn:page:")) else None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string())] + [("payload", pa.binary())] * with_payload)
        for b in batches:
            for path, count in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                fs, at = filesystem(path)
                rows, seen = [], 0
                with fs.open_input_stream(at, compression=None) as f:
                    for fields, payload in read_archive(iter(lambda: f.read(READ_BYTES), b"")):
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        row = {"page_id": number(fields["warc-record-id"]), "payload_bytes": int(fields["warc-payload-length"]), "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "uri": fields.get("warc-target-uri", "")}
                        rows.append(row | {"payload": payload} if with_payload else row)
                        seen += 1
                        if len(rows) == 512:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if seen != count:
                    raise WarcError(f"{path} has {seen} records instead of {count}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string" + ", payload binary" * with_payload
    files = manifest.select("path", "records").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return files.mapInArrow(read, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", html: str = "html", url: str = "url", min_revisit: int = 1000) -> DataFrame:
    """Writes the archives to a fresh shared folder and reads them back."""
    folder = run_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, id_col, html, url, min_revisit)).withColumnRenamed("page_id", id_col)
