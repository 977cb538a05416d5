"""WARC archives that are read through an index: offset, length, URL and digest of each record.

Archives are gzip files with one member per record, so that any record can be read alone. Writing yields
the index; reading takes the index rows of the wanted records, sorts them by place, and fetches neighbours
with one range request. Files lie in a folder that pyarrow's file systems reach from every executor. Each
write attempt makes files of its own names, and only those of the attempt that succeeded are in the index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm._common import materialise, shared_dir, table

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 1000
#: Digests of repeated payloads up to this many are broadcast, at about 100 bytes each; more are joined by shuffling.
BROADCAST_DIGESTS = 500_000
#: Bytes of archive that one task reads, about.
TASK_BYTES = 64 << 20
#: A file ends after ROLL bytes. One range request spans gaps of up to GAP bytes and SPAN bytes in all, or one record.
ROLL, GAP, SPAN = 1 << 30, 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_urn(urn: str | None) -> int | None:
    at = urn[len("<urn:page:") : -1] if urn else "none"
    return None if at == "none" else int(at)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP headers alone, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "urn:none" if url is None else "%75rn:none" if url == "urn:none" else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; a response's payload must match its digest and lengths."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    uri = fields["WARC-Target-URI"]
    url = None if uri == "urn:none" else uri.replace("%75rn:none", "urn:none").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": _from_urn(fields["WARC-Record-ID"]), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _from_urn(fields.get("WARC-Refers-To")), "payload": payload}


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record per row of pages to archives in folder; returns their index.

    Of equal payloads of min_revisit bytes or more, the row with the largest id is the response and the
    others revisit it; rows that repeat that id and payload are all responses. A null html is an empty
    payload; a null id is the smallest, and only null ids share its response. No rows give no archives.
    Only digests and ids are counted per payload. Up to BROADCAST_DIGESTS repeated digests are broadcast, so that
    no payload is shuffled. Beyond that the payloads are joined by digest, those too small to be revisited dealt
    out by a hash of their rows instead; the join has one row per repeated digest on its right, so that a payload with very
    many copies is split by adaptive execution.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("payload"), F.unhex(F.sha1(html)).alias("digest"))
    small = F.octet_length("payload") < min_revisit
    copies = source.where(~small).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("again"), "first")
    copies = materialise(spark, copies, "copies")
    if copies.count() <= BROADCAST_DIGESTS:
        rows = source.join(F.broadcast(copies), (F.col("digest") == F.col("again")) & ~small, "left")
    else:
        key = F.when(small, F.unhex(F.hex(F.xxhash64("page_id", "url", "digest")))).otherwise(F.col("digest"))
        rows = source.withColumn("key", key).join(copies, F.col("key") == F.col("again"), "left")
    rows = rows.select("page_id", "url", "payload", F.lower(F.hex("digest")).alias("digest"), "first", (F.col("again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        out = name = None
        at = 0
        try:
            for b in batches:
                found = []
                for page_id, url, data, digest, first, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        system.create_dir(root)
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = system.open_output_stream(f"{root}/{name}", compression=None), 0
                    deflate = zlib.compressobj(4, wbits=31)
                    member = deflate.compress(record(page_id, url, data, digest, first, revisit)) + deflate.flush()
                    out.write(member)
                    found.append((name, at, len(member), page_id, url, digest, "revisit" if revisit else "response"))
                    at += len(member)
                    if at >= ROLL:
                        out.close()
                        out = None
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], k) for j, k in enumerate(kinds)], names=["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return materialise(spark, rows.mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records that the index rows name, with their payload (null in revisits) if asked for.

    Rows are sorted by file and offset across tasks, one for each TASK_BYTES that they name and one for each
    core at least; within a task neighbours are fetched together. Rows named twice are read twice; a null id or
    url was written as such and is null again. No rows give no rows.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    placed = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name = source = None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())

        def fetch(file: str, run: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal name, source
            if file != name:
                name, source = file, system.open_input_file(f"{root}/{file}")
            start = run[0][0]
            data = source.read_at(run[-1][0] + run[-1][1] - start, start)
            found = [parse_record(zlib.decompress(data[o - start : o - start + n], wbits=31)) for o, n in run]
            cols = [pa.array([r[c] for r in found], k) for c, k in zip(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"), kinds, strict=True)]
            if payload:
                cols.append(pa.array([None if r["record_type"] == "revisit" else r["payload"] for r in found], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload])

        file, run = None, []
        for b in batches:
            for f, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if run and (f != file or o - sum(run[-1]) > GAP or o + n - run[0][0] > SPAN):
                    yield fetch(file, run)
                    run = []
                file = f
                run.append((o, n))
        if run:
            yield fetch(file, run)

    return placed.mapInArrow(read, RECORD + (", payload binary" if payload else ""))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `pages` written to archives and read back through their index."""
    folder = shared_dir(spark) + "/archives"
    index = write_archives(spark, table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM m"""
